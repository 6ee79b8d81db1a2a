"""Bytes that belong to a passage of at least `least` bytes which also starts elsewhere.

A suffix array of the whole corpus fits no task, so equal passages are first brought
together.  Every passage of `least` bytes holds a core: that run of `core` bytes in it
whose hash is least (all of them where several tie).  Equal passages hold equal cores at
equal places, so cores that occur once can't belong to a repeated passage, and two
occurrences of a core can share only passages inside its surroundings, `slack` bytes to
either side.  Surroundings that are equal as a whole are one string with a count.
What differs around one core is sorted in a suffix array, where neighbours tell the
longest agreement: a position's passage repeats if it shares `least` bytes with either.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, prefix_sums, spans, text_slices
from .runs import keyed_runs
from .store import broadcast_if_small, discard, distilled, fields, fresh_path, materialize, numbered, partitions
from .suffix_groups import neighbour_lcps, suffix_array

LEAST = 400
#: Distinct surroundings of one core that a task sorts together (less than 1 MB); more are split by a longer core.
GROUP = 4096
#: Strings with more occurrences are told by a broadcast list, so theirs aren't brought together.
OFTEN = 4096
#: Symbols sorted at once; a group is never cut.
SORTED = 1 << 15
PIECE = 1 << 22  # bytes of a long text that are hashed at once
NEVER = 1 << 40
SPANS = "spans array<struct<begin: long, end: long>>"
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SEPARATOR, CORES = 256, 257  # symbols above those of bytes


def core_of(least: int) -> tuple[int, int]:
    """(length of a core, slack around it)"""
    core = max(1, least * 3 // 4)
    return core, least - core


def _running(values: np.ndarray, width: int, over, fill) -> np.ndarray:
    """over(values[i : i + width]) for every i, from extremes of blocks to the right and to the left."""
    n = len(values)
    padded = np.full((-(-n // width) + 1) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = over.accumulate(blocks, axis=1).ravel()
    right = over.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return over(right[:n], left[width - 1 : width - 1 + n])


def cores(offsets: np.ndarray, data: np.ndarray, least: int, begins: tuple[int, int] | None = None):
    """For texts data[offsets[k]:offsets[k + 1]]: (text, place in it, hash of the core, hash of
    its surroundings) of the cores of all passages of `least` bytes (that start in `begins`)."""
    core, slack = core_of(least)
    size, width, none = len(data), slack + 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    end = np.repeat(offsets[1:], np.diff(offsets))
    sums, place = prefix_sums(data), np.arange(size)
    hashes = np.full(size, none)
    inside = np.flatnonzero(place + core <= end)
    hashes[inside] = np.minimum(spans(sums, inside, inside + core), none - np.uint64(1))
    passages = place + least <= end
    if begins is not None:
        passages &= (place >= begins[0]) & (place < begins[1])
    smallest = np.where(passages, _running(hashes, width, np.minimum, none), np.uint64(0))
    # a core has the least hash of some passage over it: the largest of these passages' least hashes
    before = np.concatenate([np.zeros(slack, np.uint64), smallest])
    at = np.flatnonzero((hashes == _running(before, width, np.maximum, np.uint64(0))[:size]) & (hashes != none))
    text = np.searchsorted(offsets, at, side="right") - 1
    low, high = np.maximum(at - slack, offsets[text]), np.minimum(at + core + slack, offsets[text + 1])
    around = mix(spans(sums, low, high) ^ mix((at - low).astype(np.uint64) * np.uint64(least + 1) + (high - at).astype(np.uint64)))
    return text, at - offsets[text], hashes[at], around


def long_cores(data: np.ndarray, least: int, piece: int):
    """As `cores` for one text, `piece` starts of passages at a time."""
    _, slack = core_of(least)
    known = np.empty(0, np.int64)  # cores that the piece before has found, too
    for first in range(0, max(1, len(data) - least + 1), piece):
        low, high = max(0, first - slack), min(len(data), first + piece + least + slack)
        text, at, key, around = cores(np.array([0, high - low]), data[low:high], least, (first - low, first + piece - low))
        new = ~np.isin(at + low, known)
        known = at + low
        yield text[new], (at + low)[new], key[new], around[new]


def _cores_task(least: int):
    def task(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, offsets, data in text_slices(batch.column("text")):
                if len(data) < least:
                    continue
                for text, at, key, around in [cores(offsets, data, least)] if len(data) <= PIECE else long_cores(data, least, PIECE):
                    columns = [rows[first + text], at.astype(np.int32), key.view(np.int64), around.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "core", "around"])

    return task


def _surroundings_task(least: int):
    core, slack = core_of(least)

    def task(batches):
        for batch in batches:
            out: list[tuple] = []
            rows, texts, wanted = (batch.column(c) for c in ("row", "text", "wanted"))
            for row, text, places in zip(rows.to_pylist(), texts.cast(pa.binary()).to_pylist(), wanted.to_pylist(), strict=True):
                for p in places:
                    at, end = p["at"], p["at"] + core
                    out.append((row, at, p["core"], p["n"], text[max(0, at - slack) : at], text[end : end + slack]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "at", "core", "n", "before", "behind"])

    return task


def _split_large(groups: DataFrame, slack: int, most: int) -> DataFrame:
    """Surroundings (row, at, core, n, before, behind) with `room`, the bytes that a passage
    has beyond the core, and `size`, the core's length beyond the first one.

    A group of more than `most` members becomes two with half the room: passages that
    start in the farther half of `before` all hold its nearer half, the others hold the
    nearer half of `behind`, and these bytes make the cores longer.  In the end there is no
    room, and a group holds equal passages.
    """
    groups = groups.withColumns({"room": F.lit(slack), "size": F.lit(0)})
    done = None
    while True:
        counts = groups.where("room > 0").groupBy("core").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("core")
        counts = materialize(counts, "large_groups")
        if counts.isEmpty():
            return groups if done is None else done.unionByName(groups)
        large = broadcast_if_small(counts, 16)
        small = groups.join(large, "core", "left_anti")
        done = small if done is None else done.unionByName(small)
        big = groups.join(large, "core").withColumn("near", F.expr("room div 2"))
        # passages that reach at least near + 1 bytes back: the core takes near + 1 more bytes at its front
        take = F.col("near") + 1
        back = big.where(F.length("before") >= take).select(
            "row", (F.col("at") - take).alias("at"), F.xxhash64("core", F.expr("substring(before, length(before) - near, near + 1)"), F.lit(1)).alias("core"), "n",
            F.expr("substring(before, 1, length(before) - near - 1)").alias("before"), F.expr("substring(behind, 1, room - near - 1)").alias("behind"), (F.col("room") - take).alias("room"), (F.col("size") + take).alias("size"),
        )
        # the others reach back near bytes at most, so room - near or more bytes forth
        forth = big.where(F.expr("length(behind) >= room - near")).select(
            "row", "at", F.xxhash64("core", F.expr("substring(behind, 1, room - near)"), F.lit(2)).alias("core"), "n",
            F.expr("substring(before, greatest(1, length(before) - near + 1), near)").alias("before"), F.expr("substring(behind, room - near + 1)").alias("behind"), F.col("near").alias("room"), (F.col("size") + F.col("room") - F.col("near")).alias("size"),
        )
        longer = materialize(back.unionByName(forth), "longer_cores")
        # most surroundings differ soon: what is alone under its longer core shares no passage any more
        shared = materialize(longer.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core"), "shared_cores")
        groups = longer.join(broadcast_if_small(shared, 16), "core", "left_semi")


def _shared(strings: list[bytes]) -> int:
    return len(os.path.commonprefix([min(strings), max(strings)]))


class _Sorter:
    """Collects groups and sorts them together once there are enough symbols."""

    def __init__(self, least: int):
        self.least, self.symbols, self.needs, self.members, self.size, self.groups = least, [], [], [], 0, 0

    def add(self, rows: list[int], at: list[int], counts: list[int], before: list[bytes], behind: list[bytes], room: int) -> None:
        """One group; what all of its members share next to the core counts as part of the core's symbol."""
        if len(rows) < 2 or min(counts) > 1:
            return
        back, forth = _shared([b[::-1] for b in before]), _shared(behind)
        symbol = np.array([CORES + self.groups], np.int64)
        self.groups += 1
        for row, place, n, left, right in zip(rows, at, counts, before, behind, strict=True):
            x = np.arange(len(left), back, -1)  # bytes that a passage reaches back
            need = x - back + 1 + np.maximum(0, room - x - forth)
            need[room - x > len(right)] = NEVER
            parts = [np.frombuffer(left[: len(left) - back], np.uint8), symbol, np.frombuffer(right[forth:], np.uint8), [SEPARATOR]]
            self.members.append((row, place, n, self.size, len(left), back, forth, len(right), room))
            self.symbols += parts
            self.needs += [need, np.full(1 + len(right) - forth + 1, NEVER)]
            self.size += len(x) + 2 + len(right) - forth

    def repeated(self) -> list[tuple[int, int, int]]:
        """(row, begin, end) of bytes in repeated passages, of the members that stand for one place."""
        out: list[tuple[int, int, int]] = []
        if not self.size:
            return out
        symbols, needs = np.concatenate(self.symbols).astype(np.int64), np.concatenate(self.needs)
        best = neighbour_lcps(symbols, np.array(suffix_array(symbols.tolist())))
        enough = best >= needs
        for row, place, n, begin, left, back, forth, right, room in self.members:
            if n > 1:
                continue
            far = np.flatnonzero(enough[begin : begin + left - back])
            reach = (left - far).tolist()  # bytes reached back by passages that begin before the symbol
            # those that begin inside the symbol: as far forth as its best neighbour agrees
            agreed = min(forth + int(best[begin + left - back]) - 1, right)
            reach += range(min(back, left, room), max(0, room - agreed) - 1, -1)
            reach = np.array(reach, np.int64)
            if not len(reach):
                continue
            cuts = np.flatnonzero(np.diff(reach) != -1) + 1
            for part in np.split(reach, cuts):
                out.append((row, place - int(part[0]), place - int(part[-1]) + self.least))
        self.__init__(self.least)
        return out


def _sort_task(least: int):
    def flush(sorter):
        columns = list(zip(*sorter.repeated(), strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "begin", "end"])

    def task(batches):
        sorter = _Sorter(least)
        for table, bounds in keyed_runs(batches, ["core", "room"]):
            columns = [table.column(c).to_pylist() for c in ("row", "at", "n", "before", "behind")]
            rooms = table.column("room").to_pylist()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sorter.add(*(c[a:b] for c in columns), rooms[a])
                if sorter.size > SORTED:
                    yield flush(sorter)
        yield flush(sorter)

    return task


def merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that overlapping or touching pieces cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _merge_task(batches):
    for batch in batches:
        runs = [[{"begin": a, "end": b} for a, b in merged([(p["begin"], p["end"]) for p in pieces])] for pieces in batch.column("pieces").to_pylist()]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(runs, kind)], ["row", "spans"])


def _twice(marks: DataFrame, strings: DataFrame, often: int = OFTEN) -> DataFrame:
    """The rows of `marks` whose surroundings are among the `strings` that occur twice or more.

    One string's marks would all meet in one task of a join by string.  Strings of over
    `often` marks, or over a millionth of all, are 1,000,000 at most: they are broadcast.
    """
    key, often = ["core", "around"], max(often, marks.count() // 1_000_000)
    repeated = strings.where("n > 1")
    hot = repeated.where(F.col("n") > often).select(key)
    if hot.isEmpty():
        return marks.join(repeated.select(key), key, "left_semi")
    rest = marks.join(F.broadcast(hot), key, "left_anti").join(repeated.where(F.col("n") <= often).select(key), key, "left_semi")
    return marks.join(F.broadcast(hot), key, "left_semi").unionByName(rest)


def repeated_spans(texts: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """(row, spans) of a written table (row, text): the maximal runs (begin, end) of bytes in
    passages of `least` bytes that also start elsewhere, for the rows that hold any.

    Cores are told apart by 64-bit hashes, surroundings that are equal as a whole by 64
    bits more; where they differ their bytes are compared.
    """
    spark, (core, slack) = texts.sparkSession, core_of(least)
    all_cores = materialize(texts.select("row", "text").mapInArrow(_cores_task(least), "row long, at int, core long, around long"), "cores", path := fresh_path(spark, "cores"))
    common = materialize(all_cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "common_cores")
    marks = materialize(all_cores.join(broadcast_if_small(common, 16), "core", "left_semi"), "marks")
    discard(spark, path)
    strings = materialize(marks.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one")), "surroundings")
    # cores all of whose surroundings occur twice or more have nothing to sort
    open_cores = materialize(strings.groupBy("core").agg(F.min("n").alias("least"), F.count("*").alias("n")).where("least = 1 and n > 1").select("core"), "open_cores")
    open_strings = strings.join(broadcast_if_small(open_cores, 16), "core", "left_semi").select("core", "n", "one.row", "one.at")
    wanted = materialize(open_strings.groupBy("row").agg(F.collect_list(F.struct("at", "core", "n")).alias("wanted")), "wanted")  # no more than a text has cores
    read = texts.select("row", "text").join(broadcast_if_small(wanted, 32, "wanted", 24), "row")
    groups = materialize(read.mapInArrow(_surroundings_task(least), "row long, at long, core long, n long, before binary, behind binary"), "groups")
    split = _split_large(groups, slack, group)
    ordered = split.where("room > 0").repartition(partitions(spark), "core").sortWithinPartitions("core", "room")
    found = ordered.mapInArrow(_sort_task(least), "row long, begin long, end long")
    # without room all members of a group are equal passages
    alone = split.where("room = 0")
    equal = alone.join(alone.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core"), "core", "left_semi").where("n = 1")
    # members of strings that occur twice repeat as a whole, as far as the text reaches
    whole = _twice(marks, strings).select("row", F.greatest(F.lit(0), F.col("at") - slack).cast("long").alias("begin"), (F.col("at") + core + slack).cast("long").alias("end"))
    pieces = found.unionByName(equal.select("row", F.col("at").alias("begin"), (F.col("at") + least).alias("end"))).unionByName(whole)
    return pieces.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("pieces")).mapInArrow(_merge_task, f"row long, {SPANS}")


def _without(text: bytes, spans) -> tuple[int, list[bytes]]:
    """The number of removed runs and what stays between them."""
    kept, at = [], 0
    for s in spans or []:
        kept.append(text[at : s["begin"]])
        at = s["end"]
    return len(spans or []), [*kept, text[at:]]


def _digest_task(batches):
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            runs, kept = _without(text, spans)
            kept = b"".join(kept)
            out.append((doc_id, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])


def _spans(texts: DataFrame, least: int, group: int) -> DataFrame:
    """repeated_spans, written; what it wrote on its way is deleted."""
    return broadcast_if_small(distilled(texts.sparkSession, lambda: repeated_spans(texts, least, group), "repeated_spans"), 32, "spans", 32)


def passage_dedup(docs: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of a text's UTF-8 is removed if a string of `least` bytes that covers it also
    starts anywhere else, in the same text or another; all strings are judged on the
    input.  n_spans counts the maximal removed runs, kept_sha256 is of the remaining bytes
    one after another.  Null and empty texts have no bytes; repeated rows are separate
    documents, so their texts remove each other; doc_ids may be null or repeat; other
    columns are ignored; an empty table gives none.
    """
    texts = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts", codec="zstd")
    return texts.join(_spans(texts, least, group), "row", "left").select("doc_id", "text", "spans").mapInArrow(_digest_task, COLUMNS)


def drop_passages(docs: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """`docs` without the bytes that passage_dedup removes; of a character that is cut the rest
    goes, too.  Texts without such bytes and all other columns stay as they are."""
    rows = numbered(docs)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        both = zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)
        return pa.array(["".join(k.decode(errors="ignore") for k in _without(t, s)[1]) for t, s in both], pa.string())

    joined = rows.join(_spans(fields(rows), least, group), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text").cast("string")).otherwise(cut(F.coalesce(F.col("doc.text").cast("string"), F.lit("")), F.col("spans")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
