"""Files of any store that Arrow opens (local paths, file:, hdfs:, s3:, gs: ...): listing, reading, whole writes."""

from __future__ import annotations

import os
import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the path inside it, and what to put before inner paths to name them from outside."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path), ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: path.rindex(inner)]


def files_in(path: str, ending: str = "bam") -> list[str]:
    """The file itself, or all files below a folder with that ending, whatever its case, sorted."""
    store, inner, outside = store_of(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return [outside + inner]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(outside + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending))


def open_file(path: str):
    """A file to read at any place."""
    store, inner, _ = store_of(path)
    return store.open_input_file(inner)


def size_of(path: str) -> int:
    store, inner, _ = store_of(path)
    return store.get_file_info(inner).size


@contextmanager
def whole_file(folder: str, name: str):
    """A stream to a file that is there whole once the block ends without an error, or not at all;
    a task that runs again replaces it by the same."""
    store, inner, _ = store_of(folder)
    store.create_dir(inner, recursive=True)
    part = posixpath.join(inner, f"_{name}.{uuid.uuid4().hex}")
    try:
        with store.open_output_stream(part) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, posixpath.join(inner, name))
