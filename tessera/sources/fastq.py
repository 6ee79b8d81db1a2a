"""Block-compressed FASTQ files, read in exact ranges as alignment files are.

A quality line may begin with @ and look like a name, so a range's first record is
only guessed by lines that fit together, and counts once the range before ends there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bam import BLOCK_MAGIC, SPLIT, Stream, first_block, record_ranges
from .files import open_file

SCHEMA = "file string, ord bigint, read_id string, sequence string, quality string"
FIT = 4  # records in a row that make a guess


def is_blocked(path: str) -> bool:
    """Whether a file is compressed in blocks, and not plain text or a single stream."""
    with open_file(path) as f:
        head = f.read(16)
    return head[:4] == BLOCK_MAGIC and head[12:14] == b"BC"


def _record(stream: Stream) -> tuple[bytes, bytes, bytes] | None:
    """Name, sequence and quality of the next record; null behind the last."""
    name = stream.line()
    if not name and stream.offset() is None:
        return None
    sequence, plus, quality = stream.line(), stream.line(), stream.line()
    if name[:1] != b"@" or plus[:1] != b"+" or len(sequence) != len(quality):
        raise ValueError(f"no record before {stream.offset()}")
    return name[1:].split(b" ", 1)[0], sequence, quality


class Fastq:
    ending = "gz"

    @staticmethod
    def first(path: str) -> int | None:
        return Stream(path).offset()

    @staticmethod
    def guess(path: str, cut: int) -> int | None:
        with open_file(path) as f:
            block = first_block(f, cut)
        if block is None:
            return None
        lines = Stream(path, block)
        lines.line()  # it may have begun before
        for _ in range(4):
            here = lines.offset()
            if here is None:
                return None
            trial = Stream(path, here >> 16, here & 0xFFFF)
            try:
                for _ in range(FIT):
                    if _record(trial) is None:
                        break
                return here
            except ValueError:
                lines.line()
        return None

    @staticmethod
    def walk(path: str, start: int, end: int | None) -> tuple[int | None, int, bytes | None]:
        stream, count, name = Stream(path, start >> 16, start & 0xFFFF), 0, None
        while (here := stream.offset()) is not None and (end is None or here >> 16 < end):
            found = _record(stream)
            if found is None:
                return None, count, name
            count, name = count + 1, found[0]
        return here, count, name


def _read_task(batches):
    for batch in batches:
        for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
            stream, rows = Stream(file, start >> 16, start & 0xFFFF), []
            while (here := stream.offset()) is not None and (stop < 0 or here < stop) and (found := _record(stream)):
                rows.append((file, here, *(x.decode() for x in found)))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def read_blocked_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, ord, read_id, sequence, quality) of a block-compressed file, or of every *.gz below a
    folder; a range of about `split` compressed bytes is a task.  Names end at their first space."""
    ranges = record_ranges(spark, path, split, Fastq).where("records > 0").select("file", "start", "stop")
    return ranges.repartition(max(1, ranges.count())).mapInArrow(_read_task, SCHEMA)
