"""Writing one binary class file (version 2) and the text reports."""

from __future__ import annotations

import posixpath
import shutil
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import check_keys
from ..sources.files import store_of, whole_file
from ..tables import shared_folder

STEP = 1 << 20  # numbers that are held at once where a part is read or a gap is filled
MOST = (1 << 31) - 1  # the format counts entries and rows in 32 bits
PART = "first_major bigint, first_minor bigint, last_major bigint, count bigint, name string"


@dataclass(frozen=True)
class _Part:
    """A sorted slice of a matrix: the row numbers it begins and ends with, its entries, and its files."""

    first: int
    last: int
    count: int
    name: str


def _steps(low: int, high: int):
    for k in range(low, high, STEP):
        yield k, min(k + STEP, high)


def _slices(folder: str):
    """Writes a sorted range of (major, minor, value) as three files: indices, data, and how many of
    the range's entries come before each row after its first, up to its last."""

    def task(batches):
        store, inner, _ = store_of(folder)
        name = uuid.uuid4().hex  # a task that runs again writes files of its own
        first, at, minor, count = None, 0, -1, 0
        at_path = lambda kind: posixpath.join(inner, f"{name}.{kind}")
        with store.open_output_stream(at_path("indices")) as indices, store.open_output_stream(at_path("data")) as data, store.open_output_stream(at_path("starts")) as starts:
            for batch in batches:
                if not batch.num_rows:
                    continue
                majors, minors, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                if first is None:
                    first, at = (int(majors[0]), int(minors[0])), int(majors[0])
                elif (at, minor) == (majors[0], minors[0]) and count:
                    raise ValueError(f"two entries at {at}, {minor}")
                twice = np.flatnonzero((majors[1:] == majors[:-1]) & (minors[1:] == minors[:-1]))
                if len(twice):
                    raise ValueError(f"two entries at {majors[twice[0]]}, {minors[twice[0]]}")
                for low, high in _steps(at + 1, int(majors[-1]) + 1):
                    starts.write((count + np.searchsorted(majors, np.arange(low, high))).astype("<i4").tobytes())
                indices.write(minors.astype("<i4").tobytes())
                data.write(values.astype("<i4").tobytes())
                at, minor, count = int(majors[-1]), int(minors[-1]), count + batch.num_rows
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"first_major": first[0], "first_minor": first[1], "last_major": at, "count": count, "name": name}])

    return task


def _sliced(rows: DataFrame, columns: tuple[str, str, str], sizes: tuple[int, int], folder: str) -> list[_Part]:
    """The parts of a matrix in order: a row each for ranges of Spark's sort, so a heavy row is in several."""
    cells = rows.select(*[F.col(c).cast("long").alias(c) for c in columns])
    inside = [F.col(c).between(0, most) for c, most in zip(columns, (sizes[0] - 1, sizes[1] - 1, MOST), strict=True)]
    wrong = F.raise_error(F.concat(F.lit(f"outside a matrix of {sizes[0]} x {sizes[1]}: "), F.to_json(F.struct(*columns)))).cast("long")
    checked = F.when(F.coalesce(inside[0] & inside[1] & inside[2], F.lit(False)), F.col(columns[0])).otherwise(wrong)
    cells = cells.select(checked.alias(columns[0]), *columns[1:])
    done = cells.repartitionByRange(*columns[:2]).sortWithinPartitions(*columns[:2]).mapInArrow(_slices(folder), PART).collect()  # a row per task
    parts = [_Part(r.first_major, r.last_major, r["count"], r.name) for r in sorted(done, key=lambda r: (r.first_major, r.first_minor))]
    if sum(p.count for p in parts) > MOST or sizes[0] > MOST:
        raise ValueError(f"a class file holds at most {MOST} entries and rows")
    return parts


def _joined(out, store, inner: str, parts: list[_Part], size: int) -> None:
    """indptr length, entries, indptr, indices, data; row starts become those of the whole matrix by
    adding the entries of the parts before."""
    total = sum(p.count for p in parts)
    out.write(struct.pack("<ii", size + 1, total))

    def fill(low: int, high: int, value: int) -> None:
        for a, b in _steps(low, high):
            out.write(np.full(b - a, value, "<i4").tobytes())

    at = before = 0  # the next row whose start is due, the entries of the parts so far
    for p in parts:
        fill(at, p.first + 1, before)
        at = max(at, p.first + 1)
        with store.open_input_stream(posixpath.join(inner, f"{p.name}.starts")) as f:
            while chunk := f.read(4 * STEP):
                out.write((np.frombuffer(chunk, "<i4") + np.int32(before)).tobytes())
        at, before = max(at, p.last + 1), before + p.count
    fill(at, size + 1, total)
    for kind in ("indices", "data"):
        for p in parts:
            with store.open_input_stream(posixpath.join(inner, f"{p.name}.{kind}")) as f:
                shutil.copyfileobj(f, out, 4 * STEP)


def write_ec(path: str, tables: dict[str, DataFrame], classes: int) -> None:
    """Write the tables that read_ec gives; ordinals are dense, `classes` is their number.

    Each matrix is sorted in ranges, and the task that holds a range writes its slices of
    the file to the shared folder.  Joining them is copying bytes: nothing but names and a
    row for each slice comes to the driver, and the file appears whole or not at all, in
    any store that Arrow opens.  A row or column outside its dimension, a negative or null
    value, a value or a count above 2^31 - 1 and a cell that occurs twice are errors.
    """
    names = lambda t, i, c: [r[c] for r in tables[t].orderBy(i).collect()]  # noqa: E731  dimension tables
    text = lambda s: struct.pack("<i", len(b := s.encode())) + b
    haplotypes, targets, samples = names("haplotypes", "hap_idx", "hap"), names("targets", "target_idx", "target"), names("samples", "sample_idx", "sample")
    lengths = {(r.target_idx, r.hap_idx): int(r.length) for r in tables["lengths"].collect()}
    spark = tables["a"].sparkSession
    folder = f"{shared_folder(spark)}/slices-{uuid.uuid4().hex}"
    store, inner, _ = store_of(folder)
    store.create_dir(inner, recursive=True)
    try:
        a = _sliced(tables["a"], ("ec_id", "target_idx", "mask"), (classes, len(targets)), folder)
        n = _sliced(tables["n"], ("sample_idx", "ec_id", "n"), (len(samples), classes), folder)
        where, name = posixpath.split(path)
        with whole_file(where or ".", name) as out:
            out.write(struct.pack("<ii", 2, len(haplotypes)) + b"".join(map(text, haplotypes)) + struct.pack("<i", len(targets)))
            for t, target in enumerate(targets):
                out.write(text(target) + struct.pack(f"<{len(haplotypes)}i", *[lengths.get((t, h), 0) for h in range(len(haplotypes))]))
            out.write(struct.pack("<i", len(samples)) + b"".join(map(text, samples)))
            _joined(out, store, inner, a, classes)
            _joined(out, store, inner, n, len(samples))
    finally:
        store.delete_dir(inner)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A profile as a folder of Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_tsv(report: DataFrame, path: str) -> None:
    report.write.csv(path, sep="\t", header=True)


def write_samples(samples: DataFrame, path: str) -> None:
    """A sample table (sample_id, file) as read_samples reads it."""
    samples.select("sample_id", "file").coalesce(1).write.csv(path, sep="\t")  # a row per input file


def write_viewer(path: str, totals: DataFrame, edges: DataFrame, genes: DataFrame, samples: DataFrame) -> None:
    """The viewer's four tables, after a check that no key occurs twice."""
    check_keys(totals, ["sample_id", "gene_id"])
    check_keys(edges, ["sample_id", "gene_id_1", "gene_id_2"])
    check_keys(genes, ["gene_id"])
    check_keys(samples, ["sample_id"])
    write_tables({"gene_count_totals": totals, "gene_edge": edges, "gene_info": genes, "sample": samples}, path)


VIEWER = ("gene_count_totals", "gene_edge", "gene_info", "sample")


def read_viewer(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables that write_viewer wrote."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in VIEWER}


def write_read_samples(reads: DataFrame, sample_id: str, path: str) -> None:
    """Append (read_id, sample_id) of one sample's reads (read_id, ...) to a table."""
    reads.select("read_id", F.lit(sample_id).alias("sample_id")).write.mode("append").parquet(path)
