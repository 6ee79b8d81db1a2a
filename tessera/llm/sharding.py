"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, materialize

BITS = 60
STEP = 12  # bits looked at in each further round, for what is still too large


def _weighed(docs: DataFrame) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("bytes"))


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For cells (cell = first `high` bits, bytes, n): depth, the least number of bits from
    `low` on at which the bucket around the cell fits; null when it doesn't at `high`."""
    at = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = at.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = at.select("cell", "depth", "bucket").join(sums.where(F.col("shard_bytes") <= limit), ["depth", "bucket"])
    first = fits.groupBy("cell").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_docs"), "depth").alias("s"))
    return cells.select("cell").join(first, "cell", "left").select("cell", "s.*")


def shard(docs: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, shard, depth, shard_bytes, shard_docs.

    A directory over the first bits of a hash of doc_id starts as one bucket;
    a bucket of more than `limit` bytes of text splits on the next bit, others
    stay.  `shard` is the bucket's bits as a string of 0 and 1 (empty: no split).
    A bucket that no bit can split (one document above the limit, or rows that
    repeat a doc_id) stays whole at BITS bits; its shard_bytes exceed the limit.
    Null text weighs nothing, a null doc_id is a key like any other, and other
    columns are ignored.

    One pass sums the bytes per cell of a directory some bits deeper than the
    average needs; buckets are read off those sums.  Only documents of cells
    that are still too large are looked at again, STEP bits deeper each time.
    """
    rows = materialize(_weighed(docs), "weighed")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(2, ceil(log2(max(1, total / limit))) + 4))
    done, left = None, rows
    while True:
        placed = left.withColumn("cell", F.expr(f"shiftright(key, {BITS - high})"))
        cells = materialize(placed.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "cells")
        found = materialize(_split(cells, low, high, limit), "directory")
        over = found.where("depth is null").select("cell")
        if high == BITS:  # nothing more to split by
            whole = cells.join(over, "cell").select("cell", F.lit(BITS).alias("depth"), F.col("cell").alias("bucket"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"))
            found = found.where("depth is not null").unionByName(whole)
        out = placed.join(broadcast_if_small(found, 48).where("depth is not null"), "cell").select(
            "doc_id", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0"))).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs"
        )
        done = out if done is None else done.unionByName(out)
        if high == BITS or over.isEmpty():
            return done
        left = materialize(placed.join(broadcast_if_small(materialize(over, "over"), 8), "cell", "left_semi").drop("cell"), "left")
        low, high = high + 1, min(BITS, high + STEP)


def write_shards(docs: DataFrame, path: str, limit: int = 256 << 20) -> None:
    """Write the rows of `docs` as Parquet, one folder `shard=s<bits>` per shard.

    Rows that repeat a doc_id, or have none, go to one shard.  Where `docs` has a
    column of that name, underscores are put before the folder's.
    """
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    placed = shard(docs, limit).select(F.col("doc_id").alias("_id"), F.concat(F.lit("s"), "shard").alias("_place")).dropDuplicates(["_id"])
    placed = rows.join(placed, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("_id"))).select("doc.*", F.col("_place").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)


def oracle_sql(table: str = "documents", limit: int = 256 << 20, deepest: int = 24) -> str:
    """The same rows as shard, for DuckDB.  Keys whose bucket doesn't fit at `deepest` bits are looked at again at every depth."""

    def sums(n: str, keys: str, depths: str) -> str:
        return f"""a{n} as (select key, d, (key >> ({BITS} - d)) as bucket, bytes, n from {keys}, range({depths}) t(d)),
s{n} as (select d, bucket, sum(bytes)::bigint as shard_bytes, sum(n)::bigint as shard_docs from a{n} group by d, bucket),
f{n} as (select a.key, min(a.d) as d from a{n} a join s{n} using (d, bucket) where shard_bytes <= {limit} group by a.key)"""

    return f"""with w as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key, strlen(coalesce(text, '')) as bytes from {table}),
c as (select key, sum(bytes) as bytes, count(*) as n from w group by key),
{sums("1", "c", f"0, {deepest + 1}")},
r as (select * from c where key not in (select key from f1)),
{sums("2", "r", f"{deepest + 1}, {BITS + 1}")},
k as (select key, coalesce(f1.d, f2.d, {BITS}) as d from c left join f1 using (key) left join f2 using (key)),
s as (select * from s1 union all select * from s2)
select w.doc_id, case when k.d = 0 then '' else lpad(bin(s.bucket), k.d::int, '0') end as shard, k.d::int as depth, shard_bytes, shard_docs
from w join k using (key) join s on s.d = k.d and s.bucket = (w.key >> ({BITS} - k.d))"""
