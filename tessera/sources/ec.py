"""Binary class files, versions 1 and 2: `format("tessera_ec").option("table", ...)`.

Tables: haplotypes (hap_idx, hap), targets (target_idx, target), lengths
(target_idx, hap_idx, length), samples (sample_idx, sample), a (ec_id,
target_idx, mask), n (ec_id, sample_idx, n).  The matrices are read in ranges
of rows, each by its own task; only names are read when planning.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_file

SCHEMAS = {
    "haplotypes": "hap_idx bigint, hap string",
    "targets": "target_idx bigint, target string",
    "lengths": "target_idx bigint, hap_idx bigint, length bigint",
    "samples": "sample_idx bigint, sample string",
    "a": "ec_id bigint, target_idx bigint, mask bigint",
    "n": "ec_id bigint, sample_idx bigint, n bigint",
}
RANGE_ROWS = 1 << 20


@dataclass
class _Layout:
    version: int
    haplotypes: list[str]
    targets: list[str]
    lengths: list[list[int]]
    samples: list[str]
    a: tuple[int, int, int]  # offset of indptr, its length, nonzeros
    n: tuple[int, int, int]  # the same; for version 1 offset of counts, number of classes, 0


def _ints(f, n: int) -> list[int]:
    return np.frombuffer(f.read(4 * n), "<i4").tolist()


@dataclass
class _Numbers:
    """Numbers of a file, each read when it is asked for, so that a search reads few of them."""

    file: object
    offset: int
    size: int

    def __len__(self):
        return self.size

    def __getitem__(self, k: int) -> int:
        return int(_at(self.file, self.offset + 4 * k, 1)[0])


def _at(f, offset: int, n: int) -> np.ndarray:
    f.seek(offset)
    return np.frombuffer(f.read(4 * n), "<i4")


def _text(f) -> str:
    return f.read(_ints(f, 1)[0]).decode()


def layout(path: str) -> _Layout:
    with open_file(path) as f:
        version = _ints(f, 1)[0]
        if version not in (1, 2):
            raise ValueError(f"class files of version {version} can't be read")
        haplotypes = [_text(f) for _ in range(_ints(f, 1)[0])]
        targets, lengths = [], []
        for _ in range(_ints(f, 1)[0]):
            targets.append(_text(f))
            lengths.append(_ints(f, len(haplotypes)))
        samples = [_text(f) for _ in range(_ints(f, 1)[0])] if version == 2 else [os.path.basename(path)]
        size, nnz = _ints(f, 2)
        a = (f.tell(), size, nnz)
        f.seek(4 * (size + 2 * nnz), os.SEEK_CUR)
        if version == 1:
            count = _ints(f, 1)[0]
            return _Layout(version, haplotypes, targets, lengths, samples, a, (f.tell(), count, 0))
        size, nnz = _ints(f, 2)
        return _Layout(version, haplotypes, targets, lengths, samples, a, (f.tell(), size, nnz))


class EcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "a")

    def partitions(self):
        if self.table not in ("a", "n"):
            return [InputPartition((0, 0))]
        at = layout(self.path)
        nnz = at.a[2] if self.table == "a" else at.n[2] or at.n[1]
        return [InputPartition((k, min(k + RANGE_ROWS, nnz))) for k in range(0, nnz, RANGE_ROWS)]

    def read(self, partition):
        at = layout(self.path)
        if self.table == "haplotypes":
            yield from enumerate(at.haplotypes)
        elif self.table == "targets":
            yield from enumerate(at.targets)
        elif self.table == "lengths":
            yield from ((t, h, v) for t, row in enumerate(at.lengths) for h, v in enumerate(row))
        elif self.table == "samples":
            yield from enumerate(at.samples)
        else:
            yield self._entries(at, *partition.value)

    def _entries(self, at: _Layout, low: int, high: int):
        offset, size, nnz = at.a if self.table == "a" else at.n
        whole = lambda x: pa.array(np.asarray(x, np.int64))
        with open_file(self.path) as f:
            if self.table == "n" and at.version == 1:
                counts = _at(f, offset + 4 * low, high - low)
                return pa.RecordBatch.from_arrays([whole(np.arange(low, high)), whole(np.zeros(high - low)), whole(counts)], ["ec_id", "sample_idx", "n"])
            starts = _Numbers(f, offset, size)
            first = bisect_right(starts, low) - 1
            last = bisect_left(starts, high)
            major = np.searchsorted(_at(f, offset + 4 * first, last - first + 1), np.arange(low, high), side="right") - 1 + first
            minor = _at(f, offset + 4 * (size + low), high - low)
            data = _at(f, offset + 4 * (size + nnz + low), high - low)
        if self.table == "a":  # rows are classes
            return pa.RecordBatch.from_arrays([whole(major), whole(minor), whole(data)], ["ec_id", "target_idx", "mask"])
        return pa.RecordBatch.from_arrays([whole(minor), whole(major), whole(data)], ["ec_id", "sample_idx", "n"])


class EcSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_ec"

    def schema(self):
        return SCHEMAS[self.options.get("table", "a")]

    def reader(self, schema):
        return EcReader(self.options)


def read_ec(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a class file."""
    spark.dataSource.register(EcSource)
    return {t: spark.read.format("tessera_ec").option("table", t).load(path) for t in SCHEMAS}
