"""Alignment files: a data source (`format("tessera_bam")`) and a reader in exact ranges.

`read_bam` cuts files at byte offsets.  A range holds the records whose first byte lies
in a block that begins inside it.  Where its first record starts is guessed by a task
from the bytes alone; the same task goes on to the first record behind the range, so
that each range also says where the next must start.  A guess counts only if the range
before, itself right, ends there; the others are read again from that place until all
agree.  So a record is read once, whatever its length and the ranges.

`ord` is the virtual offset of the record: its block's place in the file and its own in
the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bits import haplotype_of, read_name, target_of
from ..tables import discard, written
from .files import files_in, open_file, size_of

SCHEMA = "file string, ord bigint, qname string, flag int, tid int, pos int, mate_tid int, mate_pos int"
#: Fixed values of the format: the start of a block and the empty block at a file's end.
BLOCK_MAGIC = bytes.fromhex("1f8b0804")
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_MOST = 1 << 16  # bytes of a block, compressed or not
#: Bytes looked at for a guess, and records that must follow each other in them.
LOOK_AHEAD, CHAIN = 1 << 18, 8
SPLIT, ROWS = 64 << 20, 10_000
_RECORD = struct.Struct("<iiiBBHHHiiii")  # length, reference, place, length of name, ..., bases, mate's reference and place, span


def check_file(path: str) -> None:
    with open_file(path) as f:
        head = f.read(18)
        f.seek(max(0, f.size() - len(END_BLOCK)))
        tail = f.read()
    if head[:4] != BLOCK_MAGIC or tail != END_BLOCK:
        raise ValueError(f"{path} is no complete block-compressed file")


def blocks(f, at: int = 0):
    """(offset, whole length, start of the data, length of the data) of each block from `at` on, without inflating."""
    while head := f.read(12):
        extra = f.read(struct.unpack("<H", head[10:12])[0])
        size, k = None, 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if head[:4] != BLOCK_MAGIC or size is None:
            raise ValueError(f"no block at {at}")
        start = 12 + len(extra)
        yield at, size, at + start, size - start - 8
        at += size
        f.seek(at)


def first_block(f, at: int) -> int | None:
    """Place of the first block that begins at `at` or behind it; null behind the last.

    Bytes that look like a block's start count only if the block inflates to its checksum.
    """
    f.seek(at)
    data, k = f.read(2 * BLOCK_MOST), -1
    while (k := data.find(BLOCK_MAGIC, k + 1)) >= 0 and k < BLOCK_MOST:
        try:
            _, size, start, length = next(blocks(f_at(f, at + k), at + k))
            f.seek(start)
            body, (crc, plain) = f.read(length), struct.unpack("<II", f.read(8))
            inflated = zlib.decompress(body, -15)
        except (ValueError, struct.error, zlib.error):
            continue
        if zlib.crc32(inflated) == crc and len(inflated) == plain:
            return at + k
    return None


def f_at(f, at: int):
    f.seek(at)
    return f


class Stream:
    """The inflated bytes of a file from some block on, with the virtual offset of the next."""

    def __init__(self, path: str, at: int = 0, within: int = 0):
        self.f = open_file(path)
        self.walk, self.data, self.at = blocks(f_at(self.f, at), at), b"", 0
        self.starts: list[tuple[int, int]] = []  # (place in data, block's offset) of the blocks held
        self.skip(within)

    def more(self) -> bool:
        """Inflate the next block; False at the file's end."""
        block = next(self.walk, None)
        if block is None:
            return False
        here = self.f.tell()
        more = zlib.decompress(f_at(self.f, block[2]).read(block[3]), -15)
        self.f.seek(here)
        cut = self.at
        last = max((x for x in self.starts if x[0] <= cut), default=None)
        self.starts = [(p - cut, o) for p, o in self.starts if p > cut or (p, o) == last] + [(len(self.data) - cut, block[0])]
        self.data, self.at = self.data[cut:] + more, 0
        return True

    def offset(self) -> int | None:
        """Virtual offset of the next byte; null at the end."""
        while self.at >= len(self.data):
            if not self.more():
                return None
        place, block = max(x for x in self.starts if x[0] <= self.at)
        return block << 16 | self.at - place

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left of them."""
        out, need = [], n
        while need:
            if self.at >= len(self.data) and not self.more():
                break
            out.append(self.data[self.at : self.at + need])
            self.at += len(out[-1])
            need -= len(out[-1])
        return b"".join(out)

    def skip(self, n: int) -> int:
        """Pass over n bytes without keeping them; how many there were too few."""
        while n > 0 and (self.at < len(self.data) or self.more()):
            step = min(n, len(self.data) - self.at)
            self.at += step
            n -= step
        return n

    def line(self) -> bytes:
        """The next line without its end; empty at the file's end."""
        out = []
        while self.at < len(self.data) or self.more():
            k = self.data.find(b"\n", self.at)
            out.append(self.data[self.at : k if k >= 0 else len(self.data)])
            self.at += len(out[-1]) + (k >= 0)
            if k >= 0:
                break
        return b"".join(out).removesuffix(b"\r")

    def size_of_record(self) -> int:
        raw = self.take(4)
        if len(raw) < 4 or (size := struct.unpack("<i", raw)[0]) < 32:
            raise ValueError(f"no record before {self.offset()}")
        return size


def _header(stream: Stream) -> list[tuple[str, int]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("no alignment file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", stream.take(4))[0]))
    return out


def header_bytes(path: str) -> bytes:
    """The header as it stands, before the first record."""
    stream = Stream(path)
    out = [stream.take(8)]
    out.append(stream.take(struct.unpack("<i", out[-1][4:])[0]))
    out.append(stream.take(4))
    for _ in range(struct.unpack("<i", out[-1])[0]):
        out.append(stream.take(4))
        out.append(stream.take(struct.unpack("<i", out[-1])[0] + 4))
    return b"".join(out)


def guess_record(path: str, cut: int, references: int) -> int | None:
    """A likely virtual offset of the first record that starts in a block at `cut` or behind it.

    A record may reach into the block, so places in it are tried in order: one is
    likely if plausible records follow each other from it.  Null where none is in reach.
    """
    with open_file(path) as f:
        block = first_block(f, cut)
    if block is None:
        return None
    stream = Stream(path, block)
    while len(stream.data) < LOOK_AHEAD and stream.more():
        pass
    for at in range(len(stream.data)):
        if _chain(stream.data, at, references):
            stream.at = at
            return stream.offset()
    return None


def _chain(data: bytes, at: int, references: int) -> bool:
    for _ in range(CHAIN):
        if at + _RECORD.size > len(data):
            return at == len(data) or at + _RECORD.size > len(data) >= LOOK_AHEAD
        size, tid, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = _RECORD.unpack_from(data, at)
        if not (-1 <= tid < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name and bases >= 0 and size >= 32 + name + 4 * ops + (bases + 1) // 2 + bases):
            return False
        end = at + 36 + name
        if end <= len(data) and (data[end - 1] or b"\0" in data[at + 36 : end - 1]):
            return False
        at += 4 + size
    return True


def _name(head: bytes) -> bytes:
    """The name in the first bytes of a record's body, cut at its first space unless that comes first."""
    name = head[32 : 31 + head[8]]
    space = name.find(b" ")
    return name[:space] if space > 0 else name


def walk(path: str, start: int, end: int | None) -> tuple[int | None, int, bytes | None]:
    """From the record at `start`: the first record that starts in a block at `end` or
    behind it (null at the file's end), the number of records before it, the last one's name."""
    stream, count, name = Stream(path, start >> 16, start & 0xFFFF), 0, None
    while (here := stream.offset()) is not None and (end is None or here >> 16 < end):
        size = stream.size_of_record()
        head = stream.take(min(size, 32 + 255))
        if len(head) < min(size, 32 + 255) or stream.skip(size - len(head)):
            raise ValueError(f"{path} ends inside a record")
        count, name = count + 1, _name(head)
    return here, count, name


RANGE = "file string, number int, cut bigint, end bigint, start bigint, stop bigint, records bigint, last_name binary"


class Bam:
    """How alignment records are found: where the first one is, a guess behind a place, and a walk."""

    ending, walk = "bam", staticmethod(walk)

    @staticmethod
    def first(path: str) -> int | None:
        head = Stream(path)
        _header(head)
        return head.offset()

    @staticmethod
    def guess(path: str, cut: int) -> int | None:
        return guess_record(path, cut, len(_header(Stream(path))))


def _walk_task(guess: bool, form):
    """Adds stop, records and last_name; `start` is guessed, the end of the header or the place given.
    -1 is the file's end."""

    def one(path, number, cut, end, start):
        if guess:
            first = form.first(path)
            start = (-1 if first is None else first) if not number else form.guess(path, cut)
            if first is not None and number and first >> 16 >= cut:
                start = first  # the header reaches behind the cut
        if start is None:
            return path, number, cut, end, None, None, None, None
        stop, count, name = (None, 0, None) if start < 0 else form.walk(path, start, end)
        return path, number, cut, end, start, -1 if stop is None else stop, count, name

    def task(batches):
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "cut", "end", "start")), strict=True):
                try:
                    row = one(*values)
                except (ValueError, struct.error, zlib.error):
                    if not values[1]:
                        raise
                    row = (*values[:4], None, None, None, None)  # the start was wrong
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in RANGE.split(", ")])

    return task


def record_ranges(spark: SparkSession, path: str, split: int = SPLIT, form=Bam) -> DataFrame:
    """(file, number, cut, end, start, stop, records, last_name): ranges of about `split`
    compressed bytes and the virtual offsets at which their records start and stop (-1:
    the file's end), all checked.  A record that fills whole ranges leaves them empty.

    Each round walks all ranges that don't start where the one before ends; the first
    such range of a file is right after it, mostly all are after the first round.
    """
    cuts = []
    for file in files_in(path, form.ending):
        check_file(file)
        size = size_of(file)
        cuts += [(file, k, at, at + split if at + split < size else None, None) for k, at in enumerate(range(0, size, split))]
    columns = "file string, number int, cut bigint, end bigint, start bigint"
    plan = spark.createDataFrame(cuts, columns)
    ranges = written(plan.repartition(max(1, len(cuts))).mapInArrow(_walk_task(True, form), RANGE), "ranges")
    w = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    reached = 0
    while True:
        # where the ranges before stop: the last known one counts if it is the neighbour or reaches up to here
        before = F.last(F.when(F.col("stop").isNotNull(), F.struct("number", "stop")), ignorenulls=True).over(w)
        told = ranges.withColumn("_b", before).withColumn(
            "_at", F.when(F.col("number") == 0, F.col("start")).when((F.col("_b.number") == F.col("number") - 1) | (F.col("_b.stop") < 0) | (F.shiftright("_b.stop", 16) >= F.col("cut")), F.col("_b.stop"))
        )
        wrong = F.coalesce(F.col("_at") != F.col("start"), F.lit(False)) | F.col("stop").isNull()
        told = written(told.withColumn("wrong", wrong), "told")
        again = told.where("wrong")
        right, count = told.groupBy("file").agg(F.count("*").alias("n"), F.min(F.when(F.col("wrong"), F.col("number"))).alias("first"), F.count_if("wrong").alias("wrong")).agg(F.sum(F.coalesce("first", "n")), F.sum("wrong")).first()
        if not count:
            discard(told)
            return ranges
        if right <= reached:
            raise ValueError(f"a file in {path} ends inside a record or holds bytes that are none")
        reached = right
        todo = again.where("_at is not null").select("file", "number", "cut", "end", F.col("_at").alias("start"))
        waiting = again.where("_at is null").select(*ranges.columns)
        walked = todo.repartition(count).mapInArrow(_walk_task(False, form), RANGE)
        new = written(told.where("not wrong").select(*ranges.columns).unionByName(walked).unionByName(waiting), "ranges")
        discard(told)
        discard(ranges)
        ranges = new


def by_name(ranges: DataFrame) -> DataFrame:
    """The same ranges moved on to the next change of names, so that no read lies in two;
    names count up to their first space."""
    w = Window.partitionBy("file").orderBy("number")
    last = F.last(F.when(F.col("records") > 0, F.col("last_name")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def task(batches):
        for batch in batches:
            for file, number, start, name in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "start", "_last")), strict=True):
                while start >= 0 and name is not None:
                    stream = Stream(file, start >> 16, start & 0xFFFF)
                    while (here := stream.offset()) is not None:
                        size = stream.size_of_record()
                        head = stream.take(min(size, 32 + 255))
                        if _name(head) != name:
                            break
                        stream.skip(size - len(head))
                    start = -1 if here is None else here
                    break
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int32()), pa.array([start], pa.int64())], ["file", "number", "start"])

    moved = ranges.withColumn("_last", last).select("file", "number", "start", "_last").mapInArrow(task, "file string, number int, start bigint")
    return moved.withColumn("stop", F.lead("start", 1, -1).over(w))


def records(stream: Stream, stop: int, rows: int):
    """Up to `rows` records before `stop`: their bytes, places in them, and virtual offsets."""
    bodies, ords, places, at = [], [], [], 0
    while len(ords) < rows and (here := stream.offset()) is not None and (stop < 0 or here < stop):
        size = stream.size_of_record()
        body = stream.take(size)
        if len(body) < size:
            raise ValueError("the file ends inside a record")
        bodies.append(body)
        ords.append(here)
        places.append(at)
        at += size
    return (b"".join(bodies), places, ords) if ords else None


def _batch(path, data, places, ords):
    """Fixed fields are gathered at all records' places at once; names are cut out of the same bytes."""
    raw, at = np.frombuffer(data, np.uint8), np.array(places)
    field = lambda offset, kind: raw[(at + offset)[:, None] + np.arange(np.dtype(kind).itemsize)].copy().view(kind).ravel()
    size = raw[at + 8].astype(np.int64) - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(ends[-1]) + np.repeat(at + 32 - ends[:-1], size)
    names = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw[index].tobytes()))
    columns = [pa.array([path] * len(at)), pa.array(ords, pa.int64()), names, pa.array(field(14, "<u2").astype(np.int32)), *[pa.array(field(k, "<i4")) for k in (0, 4, 20, 24)]]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])



def rows_of(path: str, start: int, stop: int, rows: int = ROWS):
    """The records from `start` on and before `stop` as record batches."""
    if start < 0:
        return
    stream = Stream(path, start >> 16, start & 0xFFFF)
    while batch := records(stream, stop, rows):
        yield _batch(path, *batch)


class BamReader(DataSourceReader):
    """A file is a partition; read_bam cuts files."""

    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("batch", ROWS))

    def partitions(self):
        return [InputPartition(file) for file in files_in(self.path)]

    def read(self, partition):
        check_file(partition.value)
        head = Stream(partition.value)
        _header(head)
        start = head.offset()
        yield from rows_of(partition.value, -1 if start is None else start, -1, self.rows)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def _read_task(batches):
    for batch in batches:
        for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
            yield from rows_of(file, start, stop)


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of a file, or of every *.bam below a folder, names up to their first space.

    Files of more than `split` bytes are read in ranges, each by a task; finding the
    ranges is a job of its own that inflates such files once.
    """
    if any(size_of(file) > split for file in files_in(path)):
        ranges = record_ranges(spark, path, split).where("records > 0").select("file", "start", "stop")
        rows = ranges.repartition(max(1, ranges.count())).mapInArrow(_read_task, SCHEMA)
    else:
        spark.dataSource.register(BamSource)
        rows = spark.read.format("tessera_bam").load(path)
    return rows.withColumn("qname", read_name(F.col("qname")))


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, ref_name, length, target, hap) from the header of the first file."""
    header = _header(Stream(files_in(path)[0]))
    refs = spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(header)], "tid int, ref_name string, length int")
    return refs.select("*", target_of(F.col("ref_name")).alias("target"), haplotype_of(F.col("ref_name")).alias("hap"))
