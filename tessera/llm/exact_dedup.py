"""Exact dedup by 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, materialize

#: What normalisation deletes: the characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(docs: DataFrame, hashed, *more: Column) -> DataFrame:
    """doc_id, norm, points, raw (a hash of the text as it is), h and the columns `more`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), normalized(text).alias("norm"), F.char_length(text).alias("points"), F.xxhash64(text).alias("raw"))
    return base.withColumn("h", hashed(F.col("norm")))


def _repeated(hashes: DataFrame) -> DataFrame:
    """The hashes (h) that occur twice or more, to be joined with."""
    return broadcast_if_small(materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated"), 16)


def _rank(*ties: Column) -> Column:
    """The order in which the rows of a group are preferred: the greatest stays."""
    return F.struct("points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), "raw", *ties)


def exact_dedup(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting space characters; null counts
    as empty, and all empty texts are one group.  Of a group the row with the
    most code points stays, of those the smallest doc_id (null loses against any
    other); rows that tie in both are told apart by a hash of the original text
    and then by their place in the input, so that just one row of a group is kept.
    Other columns are ignored; an empty table gives none.

    Whole texts are shuffled only for documents whose hash occurs twice; there
    the text itself is the grouping key, so Spark compares its bytes, and
    map-side combining keeps one text per group and task.
    """
    keyed = _keyed(docs, hashed, F.monotonically_increasing_id().alias("row"))
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    digests = materialize(keyed.select("row", "doc_id", "points", "raw", "h", digest), "digests")
    repeated = _repeated(digests)
    # Whole texts of repeated hashes are the grouping key: their bytes are compared.
    sized = keyed.join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("group_size")).select("h", digest, "group_size")
    best = digests.join(repeated, "h", "left_semi").groupBy("h", "text_sha256").agg(F.max_by(F.struct("doc_id", "row"), _rank(F.bitwise_not("row"))).alias("keep"))
    groups = materialize(sized.join(best, ["h", "text_sha256"]), "groups")
    # Texts that differ in their bytes but share the hash are separate rows of
    # `groups`; the digest that each row carries anyway tells its own apart.
    joined = digests.join(broadcast_if_small(groups, 160), ["h", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, columns unchanged.

    Rows whose hash is alone pass as they are; of the others the winner of each
    group of equal bytes comes out of the aggregation with all its columns (rows
    that agree in all exact_dedup looks at are told apart by a hash of the whole
    row).  So repeated or null doc_ids neither save a copy nor take other rows along.
    """
    keyed = _keyed(docs, hashed, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    repeated = _repeated(keyed.select("h"))
    alone = keyed.join(repeated, "h", "left_anti").select("doc")
    best = keyed.join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.max_by("doc", _rank(F.xxhash64(F.to_json("doc")))).alias("doc"))
    return alone.unionByName(best.select("doc")).select("doc.*")
