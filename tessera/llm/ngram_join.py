"""N-gram Jaccard join with Bayesian candidate pruning.

Candidates share a band of MinHash values.  Their values are then compared a
step at a time; with a uniform prior on the similarity, the posterior
probability of reaching the threshold t after m matches in n values is
P(Binomial(n + 1, t) <= m), and a pair is dropped when that falls below the
tolerance.  What is left is verified on the whole shingle sets.

No pair is ever a row: tasks hold blocks of bounded size and emit, for each
block, the number of links of every document and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs
from .components import connected_components, spanning
from .hashing import mix, shingle_sets
from .runs import keyed_runs
from .store import broadcast_if_small, distilled, fields, materialize, numbered, partitions, unnumbered, without

HASHES, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 shares none with probability 5e-8
STEPS = (16, 32, 64, 96, 128)
TOLERANCE = 1e-6
BUCKET_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1024, 256, 8 << 20

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = (_seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
ADDENDS = (_seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step, the fewest matches that a pair needs to go on."""
    out = {}
    for n in STEPS:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512] * FACTORS + ADDENDS).min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    out = np.tile(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), (len(parts), 1))
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def survivors(one: np.ndarray, many: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the signatures in `many` that Bayesian pruning leaves as partners of `one`."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), np.int32)
    before = 0
    for n in STEPS:
        matches = matches + (many[alive, before:n] == one[before:n]).sum(axis=1)
        keep = matches >= least[n]
        alive, matches, before = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def _signatures(batches):
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("row", "doc_id", "content")],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([minhash(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ],
            ["row", "doc_id", "content", "n_shingles", "same", "signature"],
        )


def _bands(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        keys = bands(_matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["bucket", "node"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _forest(least: dict[int, int]):
    """Within each bucket, a spanning forest of the pairs that pruning leaves."""

    def task(batches):
        for table, bounds in keyed_runs(batches, ["bucket", "i", "j"]):
            ids, sig = table.column("node").to_numpy(), _matrix(table.column("signature"))
            u: list[int] = []
            v: list[int] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rest = np.arange(a, b)
                while len(rest) > 1:  # search by breadth: what is reached need not be compared again
                    queue, rest = [rest[0]], rest[1:]
                    while queue and len(rest):
                        at = queue.pop()
                        found = survivors(sig[at], sig[rest], least)
                        if len(found):
                            near = rest[found]
                            queue += near.tolist()
                            u += [int(ids[at])] * len(near)
                            v += ids[near].tolist()
                            rest = np.delete(rest, found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return task


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], ["node", "shingles"])


def links_in_block(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, cross: bool, threshold: float, least: dict[int, int]):
    """Verified links between positions of a block; of a cross block, only those between its sides."""
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, right = [], []
    for a in range(len(sets) - 1):
        near = a + 1 + survivors(sig[a], sig[a + 1 :], least)
        near = near[side[near] != side[a]] if cross else near
        if not len(near):
            continue
        mark[codes[starts[a] : ends[a]]] = True
        if size[near].sum() * 4 < len(codes):
            both = np.array([mark[codes[starts[b] : ends[b]]].sum() for b in near])
        else:
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)[near]
        mark[codes[starts[a] : ends[a]]] = False
        near = near[both >= threshold * (size[a] + size[near] - both) - 1e-9]
        left += [a] * len(near)
        right += near.tolist()
    return left, right


def _verify(threshold: float, least: dict[int, int]):
    """u = v rows carry link counts, the others a spanning forest of the links."""

    def task(batches):
        for table, bounds in keyed_runs(batches, ["component", "i", "j"]):
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                ids = part.column("node").to_pylist()
                if len(ids) < 2:
                    continue
                cross = part.column("i")[0].as_py() != part.column("j")[0].as_py()
                sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
                left, right = links_in_block(sets, _matrix(part.column("signature")), part.column("side").to_numpy(), cross, threshold, least)
                counts = np.bincount(np.array(left + right, int), minlength=len(ids)).tolist()
                forest = spanning(len(ids), left, right)
                for x, y, n in [(i, i, n) for i, n in zip(ids, counts, strict=True) if n] + [(ids[x], ids[y], 0) for x, y in forest]:
                    out[0].append(x)
                    out[1].append(y)
                    out[2].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v", "n"])

    return task


def content(text: str = "text") -> Column:
    """128 bits of the text as it is."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classified(rows: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, content, n_copies, n_links, node, component, class_id and class_key of rows (row, doc_id, text).

    A set of shingles is one node, whatever rows hold it; `node` is the least of
    those rows and `component` null where nothing is linked.
    """
    n = partitions(rows.sparkSession)
    least = least_matches(threshold)
    text = rows.withColumn("content", content())
    signed = text.mapInArrow(_signatures, "row long, doc_id long, content binary, n_shingles long, same binary, signature binary")
    signed = materialize(signed, "signatures")
    groups = materialize(signed.where("n_shingles > 0").groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "copies")
    reps = signed.withColumnRenamed("row", "node").join(groups.select("node"), "node", "left_semi").select("node", "content", "signature")
    reps = materialize(reps, "representatives")

    buckets = reps.select("node", "signature").mapInArrow(_bands, "bucket long, node long")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = block_pairs(buckets.join(sizes, "bucket"), "node", F.ceil(F.col("size") / BUCKET_ROWS)).drop("size", "side")
    buckets = buckets.join(reps.select("node", "signature"), "node").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    candidates = materialize(connected_components(buckets.mapInArrow(_forest(least), "u long, v long")), "candidates")

    # one text of each candidate set: those with the same content are one row each after the join
    near = materialize(candidates.join(reps.select("node", "content"), "node"), "near")
    sets = text.select("content", "text").join(broadcast_if_small(near.select("content", "node"), 48), "content").dropDuplicates(["node"])
    sets = sets.select("node", "text").mapInArrow(_sets, "node long, shingles binary")
    members = materialize(sets.join(candidates, "node").join(reps.select("node", "signature"), "node"), "members")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).alias("chunks"))
    chunked = block_pairs(members.join(sizes, "component"), "node", F.col("chunks")).drop("chunks")
    chunked = chunked.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = materialize(chunked.mapInArrow(_verify(threshold, least), "u long, v long, n long"), "links")

    classes = materialize(connected_components(links.where("u <> v").select("u", "v")), "classes")
    counts = links.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    heads = groups.join(classes, "node").groupBy("component").agg(F.min("least").alias("class_id"), F.min("same").alias("class_key"))
    linked = classes.join(heads, "component").join(counts, "node", "left")
    known = groups.join(linked, "node", "left").withColumnRenamed("same", "_same")
    # wordless rows are alone, so their common empty set is no key of the join
    out = signed.select("row", "doc_id", "content", F.when(F.col("n_shingles") > 0, F.col("same")).alias("same")).join(known, F.col("same") == F.col("_same"), "left")
    alone = F.col("node").isNull()
    return out.select(
        "row", "doc_id", "content", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "component",
        F.when(alone, F.col("doc_id")).when(F.col("component").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.lower(F.hex(F.coalesce("class_key", "same"))).alias("class_key"),
    )


def ngram_join(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, class_id, n_links, n_copies, class_key.

    Two documents are linked when the Jaccard similarity of their sets of
    five-word shingles is at least `threshold`; a text of one to four words is
    one shingle.  Copies (equal sets) are joined once: n_copies counts the
    rows with the same set, n_links the *different* sets linked to it.
    class_id is the smallest doc_id of the connected class (null when none of its
    rows has one), class_key the smallest set hash of the class in hex: it tells
    classes apart where doc_ids repeat or are null.  A null, empty or wordless text
    is a class of its own, without links and with a null class_key.  Shingles are
    compared by 64-bit hashes, sets by 128-bit ones, never by doc_id.  Every row
    gives a row; other columns are ignored; the result doesn't depend on the
    order or partitioning of the rows.
    """
    return _classified(unnumbered(docs), threshold).select("doc_id", "class_id", "n_links", "n_copies", "class_key")


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` without those that are near copies of another that stays.

    Of every class of ngram_join the row with the smallest doc_id stays (null
    loses; ties by a hash of the text), and just one of rows that repeat each
    other whole.  Wordless rows all stay; columns are unchanged.
    """
    rows = numbered(docs)

    def dropped() -> DataFrame:
        found = _classified(fields(rows), threshold).where("n_copies > 1 or component is not null")
        found = materialize(found.select("row", "doc_id", "content", F.coalesce("component", "node").alias("class")), "classified")
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "content", "row")
        kept = found.groupBy("class").agg(F.min_by("row", first).alias("row"))
        return found.select("row").join(kept.select("row"), "row", "left_anti")

    return without(rows, distilled(docs.sparkSession, dropped, "dropped"))


def oracle_sql(threshold: float = 0.8) -> str:
    """The same, all but class_key, of a table whose doc_ids are unique: exact Jaccard of every two sets that share a shingle."""
    return rf"""with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from w where len(w) > 0),
c as (select s, min(doc_id) as node, count(*) as n_copies, len(s) as n from s group by s),
t as (select node, n, unnest(s) as shingle from c),
l as (select a.node as u, b.node as v from t a join t b on a.shingle = b.shingle and a.node <> b.node group by a.node, b.node, a.n, b.n having count(*) >= {threshold} * (a.n + b.n - count(*)) - 1e-9),
r(node, seen) as (select node, node from c union select r.node, l.v from r join l on r.seen = l.u),
k as (select node, min(seen) as class_id from r group by node),
d as (select u as node, count(*) as n_links from l group by u)
select w.doc_id, coalesce(k.class_id, w.doc_id) as class_id, coalesce(d.n_links, 0) as n_links, coalesce(c.n_copies, 1) as n_copies
from w left join s on w.doc_id = s.doc_id left join c on s.s = c.s left join k on c.node = k.node left join d on c.node = d.node"""
