"""Splitting an alignment file into several, whole reads each."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.bam import BLOCK_MAGIC, END_BLOCK, Stream, by_name, header_bytes, record_ranges
from ..sources.files import size_of, whole_file
from ..tables import written

PLAIN = 65_280  # bytes that a block holds before compression, as writers of the format choose it
#: Fixed values of the format: what stands between a block's first bytes and its size.
BLOCK_HEAD = BLOCK_MAGIC + bytes.fromhex("0000000000ff0600424302 00".replace(" ", ""))


def block_of(data: bytes, level: int = 6) -> bytes:
    """`data` (64 KB at most) as one compressed block; stored as it is if it doesn't shrink."""
    for how in (level, 0):
        c = zlib.compressobj(how, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        if len(body) + 25 < 1 << 16:
            break
    return BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockWriter:
    """Cuts a stream of bytes into blocks; `close` writes what is left and the end block."""

    def __init__(self, out):
        self.out, self.waiting, self.size = out, [], 0

    def write(self, data: bytes) -> None:
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= PLAIN:
            whole = b"".join(self.waiting)
            full = self.size // PLAIN * PLAIN
            for k in range(0, full, PLAIN):
                self.out.write(block_of(whole[k : k + PLAIN]))
            self.waiting, self.size = [whole[full:]], self.size - full

    def close(self) -> None:
        if self.size:
            self.out.write(block_of(b"".join(self.waiting)))
        self.out.write(END_BLOCK)


def _copy_task(out: str, prefix: str):
    def task(batches):
        for batch in batches:
            for path, number, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "start", "stop")), strict=True):
                name, count = f"{prefix}_{number}.bam", 0
                with whole_file(out, name) as f:
                    blocks = BlockWriter(f)
                    blocks.write(header_bytes(path))
                    stream = None if start < 0 else Stream(path, start >> 16, start & 0xFFFF)
                    while stream and (here := stream.offset()) is not None and (stop < 0 or here < stop):
                        size = stream.size_of_record()
                        blocks.write(struct.pack("<i", size) + stream.take(size))
                        count += 1
                    blocks.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["name", "records"])

    return task


def split_bam(spark: SparkSession, path: str, parts: int, out: str, prefix: str = "part") -> DataFrame:
    """Write the records of the file `path` as about `parts` files `<prefix>_<number>.bam` in
    the folder `out`, in order and with its header; all of a read's neighbouring records stay
    together.  Returns (name, records) of what was written.

    Each part is copied by a task of its own and appears whole or not at all; a file with
    fewer blocks than parts leaves some parts without records.
    """
    ranges = by_name(record_ranges(spark, path, max(1, -(-size_of(path) // parts))))
    return written(ranges.repartition(parts).mapInArrow(_copy_task(out, prefix), "name string, records bigint"), "parts")
