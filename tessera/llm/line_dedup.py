"""Line dedup by a segment-partition edit join.

A line that may have k edits is cut into k + 1 segments, of which any line within
k edits keeps one whole.  Lines meet in buckets of equal (length, segment number,
segment), the longer line probing with its substrings of fitting place and
length, and are verified there by banded bit-parallel edit distance.  Buckets of
many lines are split by a second round of segments over the rest of the lines.
Only verified links make classes; no candidate pair is ever a row.  Inside a
class a line goes only for one that stays and that it is near to.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs
from .components import connected_components
from .edit_distance import allowed, probes, rest_pieces, rest_probes, segments, within
from .hashing import mix, powers
from .runs import keyed_runs
from .store import broadcast_if_small, fields, materialize, numbered, partitions, unnumbered

SPACES = " \t\n\x0b\x0c\r"
#: Edits allowed at most, and the characters of the shorter line that allow one edit.
EDITS, PER_EDIT = 2, 10
#: Lines of a bucket that are compared at once; bins of the character counts that sift pairs first; pairs verified at once.
BUCKET_ROWS, BINS, WAVE = 512, 32, 8192
SLICE_CHARS = 1 << 20


def _lines(text: str | None):
    """(number, stripped line) of the lines that hold a word."""
    for i, line in enumerate((text or "").split("\n")):
        if line := line.strip(SPACES):
            yield i, line


def _list(batches):
    for batch in batches:
        row, doc, raw, line, digest = [], [], [], [], []
        for r, d, h, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = [(i, hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()) for i, x in _lines(text)] or [(-1, None)]
            row += [r] * len(found)
            doc += [d] * len(found)
            raw += [h] * len(found)
            line += [x[0] for x in found]
            digest += [x[1] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((row, pa.int64()), (doc, pa.int64()), (raw, pa.int64()), (line, pa.int32()), (digest, pa.binary()))], ["row", "doc_id", "raw", "line", "digest"])


@lru_cache(maxsize=20_000)
def _places(length: int, edits: int, per: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The substrings a line is joined on, as (other length, segment, its start, size, place here);
    their starts, ends and codes of (length, segment), and which are the line's own segments."""
    every = []
    for other, i, at, size in sorted(set(probes(length, edits, per))):
        every.append((other, i, segments(other, allowed(other, edits, per) + 1)[i][0], size, at))
    code = mix(np.array([other * 64 + i + 1 for other, i, *_ in every], np.uint64))
    own = np.array([other == length and start == at for other, _, start, _, at in every], bool)
    return every, np.array([p[4] for p in every], int), np.array([p[4] + p[3] for p in every], int), code, own


def _sums(lines: list[str]) -> np.ndarray:
    """A row of hash prefix sums for each of some lines of equal length."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(lines), -1)
    out = np.zeros((len(lines), chars.shape[1] + 1), np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers(chars.shape[1])[0], axis=1, out=out[:, 1:])
    return out


def _cut(sums: np.ndarray, start, end) -> np.ndarray:
    return mix((sums[:, end] - sums[:, start]) * powers(sums.shape[1])[1][start])


def _by_length(lines: list[str], edits: int, per: int):
    """(length, positions) of lines of equal length that may have edits, a slice at a time."""
    groups: dict[int, list[int]] = defaultdict(list)
    for p, line in enumerate(lines):
        if allowed(len(line), edits, per):
            groups[len(line)].append(p)
    for length, at in groups.items():
        step = max(1, SLICE_CHARS // length)
        for k in range(0, len(at), step):
            yield length, at[k : k + step]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(edits: int, per: int):
    """(near, own, probes): the 64-bit hash of a line, the keys of its segments and of its other substrings."""

    def task(batches):
        seen: set[int] = set()
        for batch in batches:
            lines: list[str] = []
            names: list[int] = []
            for text in batch.column(0).to_pylist():
                for _, line in _lines(text):
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if h in seen:  # copies within a task would only give the same rows again
                        continue
                    seen.add(h)
                    lines.append(line)
                    names.append(_signed(h))
            if len(seen) > 500_000:
                seen.clear()
            for length, at in _by_length(lines, edits, per):
                _, start, end, code, own = _places(length, edits, per)
                keys = (_cut(_sums([lines[p] for p in at]), start, end) ^ code).view(np.int64)
                parts = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k.shape[1]), pa.array(np.ascontiguousarray(k).ravel())) for k in (keys[:, own], keys[:, ~own])]
                yield pa.RecordBatch.from_arrays([pa.array([names[p] for p in at], pa.int64()), *parts], ["near", "own", "probes"])

    return task


def _split(edits: int, per: int):
    """For lines (key, id, text) of large buckets: keys of the pieces of their rest."""

    def task(batches):
        for batch in batches:
            key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            lines = batch.column("text").to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for length, at in _by_length(lines, edits, per):
                places, start, end, code, own = _places(length, edits, per)
                sums, at = _sums([lines[p] for p in at]), np.array(at)
                hit = (_cut(sums, start, end) ^ code).view(np.int64) == key[at][:, None]
                for c in np.flatnonzero(hit.any(axis=0)):
                    other, _, begin, size, here = places[c]
                    rows = np.flatnonzero(hit[:, c])
                    k = allowed(other, edits, per)
                    mine = {(j, a, n) for j, (a, n) in enumerate(rest_pieces(other, begin, size, k))} if own[c] else set()
                    for j, a, n in mine | set(rest_probes(length, other, begin, size, here, k)):
                        new = _cut(sums[rows], a, a + n) ^ mix(key[at[rows]].view(np.uint64) + np.uint64(j + 1))
                        out.append((new.view(np.int64), ids[at[rows]], (j, a, n) in mine))
            if out:
                columns = np.concatenate([x for x, _, _ in out]), np.concatenate([x for _, x, _ in out]), np.repeat([x for _, _, x in out], [len(x) for x, _, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "own"])

    return task


def _bins(lines: list[str]) -> np.ndarray:
    """How many characters of each line fall in each bin; an edit changes two counts at most, by one each."""
    sizes = np.array([len(x) for x in lines])
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    bin_ = (chars * np.uint32(2654435761)) >> np.uint32(27)
    return np.bincount(np.repeat(np.arange(len(lines)) * BINS, sizes) + bin_, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)


def _sifted(bounds: np.ndarray, own: np.ndarray, side: np.ndarray, lines: list[str], edits: int, per: int):
    """Pairs of rows of one run that may be within the allowed edits, by lengths and character counts."""
    size, counts = np.array([len(x) for x in lines]), _bins(lines)
    end = np.repeat(bounds[1:], np.diff(bounds))
    left = np.arange(len(lines))
    step = 1
    while len(left := left[end[left] - left > step]):
        right = left + step
        k = np.minimum(edits, np.minimum(size[left], size[right]) // per)
        # side: -1 in a block of one chunk, else the chunk of a block of two
        ok = (own[left] | own[right]) & (np.abs(size[left] - size[right]) <= k) & (k > 0) & ((side[left] < 0) | (side[left] != side[right]))
        l, r, k = left[ok], right[ok], k[ok]
        near = np.abs(counts[l] - counts[r]).sum(axis=1) <= 2 * k
        if near.any():
            yield l[near], r[near], k[near]
        step += 1


def _pairs(batches, edits: int, per: int):
    """(table, lines, ids, node, left, right, most) of runs of (key, i, j): the pairs of places that may be near, each once, as places of lines; `node` numbers the ids."""
    for table, bounds in keyed_runs(batches, ["key", "i", "j"]):
        lines = table.column("text").to_pylist()
        ids, node = np.unique(table.column("id").to_numpy(), return_inverse=True)
        cross = table.column("i").to_numpy() != table.column("j").to_numpy()
        side = np.where(cross, table.column("side").to_numpy(), -1)
        found = list(_sifted(np.asarray(bounds), table.column("own").to_numpy(zero_copy_only=False), side, lines, edits, per))
        left, right, most = (np.concatenate([f[x] for f in found]) if found else np.empty(0, int) for x in range(3))
        pair = np.minimum(node[left], node[right]) * len(ids) + np.maximum(node[left], node[right])
        _, once = np.unique(pair, return_index=True)
        once = once[node[left[once]] != node[right[once]]]
        yield table, lines, ids, node, left[once], right[once], most[once]


def _near(lines: list[str], left: np.ndarray, right: np.ndarray, most: np.ndarray, edits: int) -> np.ndarray:
    return within([(lines[a], lines[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)], edits) <= most


def _verify(edits: int, per: int):
    """A spanning forest of the links that the runs of (key, i, j) hold."""

    def task(batches):
        for _, lines, ids, node, left, right, most in _pairs(batches, edits, per):
            root = np.arange(len(ids))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            u, v = [], []
            while len(left):
                l, r, k = left[:WAVE], right[:WAVE], most[:WAVE]
                close = _near(lines, l, r, k, edits)
                for a, b in zip(node[l[close]].tolist(), node[r[close]].tolist(), strict=True):
                    x, y = find(a), find(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        u.append(ids[a])
                        v.append(ids[b])
                left, right, most = left[WAVE:], right[WAVE:], most[WAVE:]
                if len(left):  # what is linked already needn't be compared
                    while not (flat := root[root]).tolist() == root.tolist():
                        root[:] = flat
                    open_ = root[node[left]] != root[node[right]]
                    left, right, most = left[open_], right[open_], most[open_]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return task


def _least(edits: int, per: int):
    """For lines of the runs of (key, i, j), the least rank among the lines near to them that rank before them.

    Pairs are taken by the rank of the lesser line, so a line that has its least needs no more comparisons.
    """

    def task(batches):
        for table, lines, ids, node, left, right, most in _pairs(batches, edits, per):
            rank, kept = table.column("rank").to_numpy(), table.column("kept").to_numpy(zero_copy_only=False)
            swap = rank[left] > rank[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            order = np.argsort(rank[left], kind="stable")
            left, right, most = (x[order][~kept[right[order]]] for x in (left, right, most))
            least: dict[int, int] = {}
            known = np.zeros(len(ids), bool)
            while len(left):
                l, r = left[:WAVE], right[:WAVE]
                close = _near(lines, l, r, most[:WAVE], edits)
                for a, b in zip(rank[l[close]].tolist(), node[r[close]].tolist(), strict=True):
                    least.setdefault(b, a)
                known[list(least)] = True
                left, right, most = left[WAVE:], right[WAVE:], most[WAVE:]
                open_ = ~known[node[right]]
                left, right, most = left[open_], right[open_], most[open_]
            yield pa.RecordBatch.from_arrays([pa.array(ids[list(least)], pa.int64()), pa.array(list(least.values()), pa.int64())], ["id", "least"])

    return task


def _apart(edits: int, per: int):
    """The ids of lines (id, text, head) that aren't near to the head of their class."""

    def task(batches):
        for batch in batches:
            ids, lines, heads = batch.column("id").to_numpy(), batch.column("text").to_pylist(), batch.column("head").to_pylist()
            most = np.array([allowed(min(len(a), len(b)), edits, per) for a, b in zip(lines, heads, strict=True)], int)
            far = within(list(zip(lines, heads, strict=True)), edits) > most if len(ids) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64())], ["id"])

    return task


def _line_column(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _met(entries: DataFrame, sizes: DataFrame | None, members: DataFrame, task, schema: str) -> DataFrame:
    """What `task` finds in the buckets of the entries (key, id, own) of `members` (id, text, ...); `sizes` (key, n) cuts large buckets into blocks of pairs."""
    n = partitions(entries.sparkSession)
    if sizes is None:
        rows = entries.select("key", "id", "own", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    else:
        rows = block_pairs(entries.join(sizes, "key"), "id", F.ceil(F.col("n") / BUCKET_ROWS)).select("key", "id", "own", "i", "j", "side")
    rows = rows.join(members.drop("near", "digest"), "id").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(task, schema)


def _candidates(docs: DataFrame, edits: int, per: int) -> tuple[DataFrame, DataFrame]:
    """Lines that share a key with another, (id, near, digest, text), and their (key, id, own)."""
    keyed = materialize(docs.select("text").mapInArrow(_keys(edits, per), "near long, own array<long>, probes array<long>"), "keys")
    keys = keyed.select("near", F.explode("own").alias("key"), F.lit(True).alias("own")).unionByName(keyed.select("near", F.explode("probes").alias("key"), F.lit(False).alias("own")))
    shared = keys.groupBy("key").agg(F.min("near").alias("a"), F.max("near").alias("b"), F.max(F.col("own").cast("int")).alias("o")).where("a < b and o = 1")
    shared = materialize(shared.select("key"), "shared")
    met = materialize(keys.join(broadcast_if_small(shared, 16), "key").groupBy("key", "near").agg(F.max(F.col("own").cast("int")).alias("own")), "met")
    nears = materialize(met.select("near").distinct(), "nears")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text")).select(_line_column(F.col("text")).alias("text")).where(F.char_length("text") >= per)
    lines = lines.select("text", F.xxhash64("text").alias("near")).join(broadcast_if_small(nears, 16), "near")
    lines = lines.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).dropDuplicates(["digest"])
    members = materialize(lines.select(F.monotonically_increasing_id().alias("id"), "near", "digest", "text"), "members")
    entries = met.join(members.select("near", "id"), "near").select("key", "id", (F.col("own") == 1).alias("own"))
    return members, materialize(entries, "entries")


def _links(members: DataFrame, entries: DataFrame, edits: int, per: int, task=_verify, schema: str = "u long, v long") -> DataFrame:
    work = task(edits, per)
    over = materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("key"), "over")
    if over.isEmpty():
        return _met(entries, None, members, work, schema)
    large = broadcast_if_small(over, 16)
    small = _met(entries.join(large, "key", "left_anti"), None, members, work, schema)
    pieces = entries.join(large, "key").join(members.select("id", "text"), "id").select("key", "id", "text").mapInArrow(_split(edits, per), "key long, id long, own boolean")
    pieces = materialize(pieces.groupBy("key", "id").agg(F.max(F.col("own").cast("int")).alias("own")), "pieces")
    sizes = pieces.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("o")).where("n > 1 and o = 1").select("key", "n")
    return small.unionByName(_met(pieces.withColumn("own", F.col("own") == 1), sizes, members, work, schema))


def _settled(members: DataFrame, entries: DataFrame, far: DataFrame, edits: int, per: int) -> DataFrame:
    """(id, keep_id) of the lines in `far` (id): each is near to its keep_id, which stays.

    Lines are taken by a rank that is a hash: one stays if no line before it that is
    near stays, otherwise the first such line keeps its place.  In a round a line is
    decided once the first undecided line near to it is; as ranks are random, the
    rounds grow with the logarithm of the lines.
    """
    rank = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    few = broadcast_if_small(far, 8)
    active = materialize(members.join(few, "id").select("id", "text", rank.alias("rank"), F.lit(False).alias("kept")), "active")
    entries = materialize(entries.join(few, "id"), "own")
    done: list[DataFrame] = []
    while True:
        ids = broadcast_if_small(active.select("id"), 8)
        least = _links(active, entries.join(ids, "id", "left_semi"), edits, per, _least, "id long, least long").groupBy("id").agg(F.min("least").alias("least"))
        first = active.select(F.col("rank").alias("least"), F.col("id").alias("keep_id"), F.col("kept").alias("stays"))
        new = active.join(least, "id", "left").join(first, "least", "left")
        new = materialize(new.select("id", "text", "rank", F.col("least").isNull().alias("kept"), F.when(F.col("stays"), F.col("keep_id")).alias("keep_id")), "active")
        done.append(new.where("keep_id is not null").select("id", "keep_id"))
        active = new.where("keep_id is null").drop("keep_id")
        if active.where("not kept").isEmpty():
            return reduce(DataFrame.unionByName, done, active.select("id", F.col("id").alias("keep_id")))


def _found(rows: DataFrame, edits: int, per: int) -> DataFrame:
    """The columns of find_repeated_lines, with the row number, for rows (row, doc_id, text)."""
    own = rows.withColumn("raw", F.xxhash64(F.coalesce("text", F.lit("")))).select("row", "doc_id", "raw", "text")
    lines = materialize(own.mapInArrow(_list, "row long, doc_id long, raw long, line int, digest binary"), "lines")
    members, entries = _candidates(own, edits, per)
    classes = connected_components(materialize(_links(members, entries, edits, per), "links")).withColumnsRenamed({"node": "id", "component": "class"})
    classes = materialize(classes.join(members.select("id", "digest"), "id").select("id", "digest", "class"), "classes")

    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "row", "line")
    first = materialize(lines.where("line >= 0").groupBy("digest").agg(F.min(where).alias("first"), F.count("*").alias("n")), "first")
    classed = materialize(first.join(broadcast_if_small(classes, 56), "digest"), "classed")
    heads = classed.groupBy("class").agg(F.min(F.struct("first", "digest", "id")).alias("head"))
    classed = materialize(classed.join(heads, "class").select("id", "digest", "first", "head"), "headed")
    texts = members.select("id", "text")
    mine = classed.where(F.col("id") != F.col("head.id")).select("id", F.col("head.id").alias("_h")).join(texts, "id")
    theirs = texts.join(classed.select(F.col("head.id").alias("id")).distinct(), "id").select(F.col("id").alias("_h"), F.col("text").alias("head"))
    far = materialize(mine.join(theirs, "_h").select("id", "text", "head").mapInArrow(_apart(edits, per), "id long"), "far")
    kept = classed.select("id", "digest", F.col("head.first").alias("keep"), F.col("head.id").alias("keep_id"))
    if not far.isEmpty():
        settled = materialize(_settled(members, entries, far, edits, per), "settled")
        places = classed.select(F.col("id").alias("keep_id"), F.col("first").alias("keep"))
        other = settled.join(places, "keep_id").join(classed.select("id", "digest"), "id").select("id", "digest", "keep", "keep_id")
        kept = kept.join(broadcast_if_small(far, 8), "id", "left_anti").unionByName(other)
    kept = kept.select("digest", "keep", (F.col("id") != F.col("keep_id")).alias("near"))
    plain = first.where("n > 1").join(broadcast_if_small(classes.select("digest"), 32), "digest", "left_anti").select("digest", F.col("first").alias("keep"), F.lit(False).alias("near"))
    keepers = materialize(kept.unionByName(plain), "keepers")

    placed = lines.join(broadcast_if_small(keepers, 160), "digest", "left")
    dropped = F.col("keep").isNotNull() & ~((F.col("keep.row") == F.col("row")) & (F.col("keep.line") == F.col("line")))
    entry = F.struct(F.col("line"), F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))
    return placed.groupBy("row", "doc_id").agg(
        F.sum((F.col("line") >= 0).cast("long")).alias("n_lines"),
        F.sum(F.coalesce(dropped, F.lit(False)).cast("long")).alias("n_dropped"),
        F.sum(F.coalesce(dropped & F.col("near"), F.lit(False)).cast("long")).alias("n_near"),
        F.sort_array(F.collect_list(F.when(dropped, entry))).alias("dropped"),
    )


def find_repeated_lines(docs: DataFrame, edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, n_near, dropped.

    A line is a \\n-separated part of a text without the space characters around
    it, if anything is left.  Two lines are linked when their edit distance (code
    points) is at most `edits` and at most one for every `per` characters of the
    shorter one; lines of fewer than `per` characters therefore only when equal.
    Of each connected class of lines the first stays, by doc_id (null last), then
    a hash of the text, the row and the line number, and the lines linked to it go.
    The rest of the class is taken in the order of a hash of the lines: one that is
    linked to a line of this rest that stays goes for the first such line, the others
    stay.  So whatever goes is linked to (or equal to) a line that stays.  Of equal lines
    only the first occurrence can stay.  `dropped` lists (line, keep_doc, keep_line) by
    line number, where keep_doc and keep_line name the occurrence that stays; n_near
    counts the dropped lines that differ from it.  Null, empty and wordless texts
    have no lines.  Rows are told apart by themselves, so a doc_id may repeat or be
    null; other columns are ignored.
    """
    return _found(unnumbered(docs), edits, per).drop("row")


def dedup_lines(docs: DataFrame, edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """`docs` with the lines that find_repeated_lines drops taken out of the texts, row by row; columns as they were."""
    rows = numbered(docs)
    found = materialize(_found(fields(rows), edits, per).where("n_dropped > 0").select("row", F.transform("dropped", lambda d: d["line"]).alias("gone")), "found")
    parts = fields(rows).join(broadcast_if_small(found.select("row"), 16), "row").select("row", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    left = parts.join(found.select("row", F.explode("gone").alias("line")), ["row", "line"], "left_anti")
    joined = left.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", "part"))).alias("parts"))  # the lines of one document
    texts = found.select("row").join(joined, "row", "left").select("row", F.coalesce(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), F.lit("")).alias("new"))
    return rows.join(texts, "row", "left").select(F.col("doc").withField("text", F.coalesce("new", F.col("doc.text"))).alias("doc")).select("doc.*")


def candidate_pairs(lines: list[str], edits: int, per: int = 1) -> set[tuple[int, int]]:
    """Positions of lines that share a segment at a fitting place, the smaller first: what the buckets bring together."""
    index: dict[tuple, list[int]] = defaultdict(list)
    for p, line in enumerate(lines):
        for i, (a, n) in enumerate(segments(len(line), allowed(len(line), edits, per) + 1)):
            index[len(line), i, line[a : a + n]].append(p)
    out = set()
    for p, line in enumerate(lines):
        for other, i, a, n in probes(len(line), edits, per):
            for q in index.get((other, i, line[a : a + n]), ()):
                if q != p:
                    out.add((min(p, q), max(p, q)))
    return out
