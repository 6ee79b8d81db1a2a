"""Classes told apart by fingerprints of what they hold instead of text keys.

A fingerprint is the exclusive or of two 64-bit hashes over distinct members, with
their number: it doesn't depend on their order and needs buffers of fixed size only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dealt, discard, written

PRINT = ["p1", "p2", "k"]
SEEDS = (17, 71)
AXES = ["target", "hap"]


def lanes(*columns: str) -> list[Column]:
    """Two independent hashes of a row."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in SEEDS]


def _folded(*more: Column) -> list[Column]:
    return [F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"), F.count("*").alias("k"), *more]


def read_prints(alignments: DataFrame, read: list[str], locus: str = "tid", order: Column | None = None) -> DataFrame:
    """One row per read: the fingerprint of its distinct loci and, if asked, its least `order` as `first`.

    Hashes are shuffled once, by read; no names are.
    """
    h1, h2 = lanes(locus)
    own = alignments.select(*read, h1.alias("h1"), h2.alias("h2"), (F.lit(None) if order is None else order).alias("first"))
    once = own.repartition(*read).groupBy(*read, "h1", "h2").agg(F.min("first").alias("first"))
    rows = once.groupBy(*read).agg(*_folded(F.min("first").alias("first")))
    return rows.drop("first") if order is None else rows


def print_counts(prints: DataFrame, read: list[str], by: list[str] = ()) -> DataFrame:
    """Reads per fingerprint (and `by`): n, and `witness`, one of these reads."""
    return prints.groupBy(*PRINT, *by).agg(F.count("*").alias("n"), F.min(F.struct(*read)).alias("witness"))


def print_names(counts: DataFrame, alignments: DataFrame, read: list[str], locus: str = "tid") -> DataFrame:
    """(fingerprint, ec_key): the loci of each class as text in string order, joined by commas,
    made from a single read of it."""
    witness = counts.groupBy(*PRINT).agg(F.min("witness").alias("w")).select(*PRINT, *[F.col(f"w.{c}").alias(c) for c in read])
    loci = alignments.select(*read, F.col(locus).cast("string").alias("_l")).join(witness, read)
    return loci.groupBy(*PRINT).agg(F.array_join(F.sort_array(F.collect_set("_l")), ",").alias("ec_key"))


def count_by_prints(alignments: DataFrame, read: list[str], locus: str = "tid", by: list[str] = ()) -> DataFrame:
    """(ec_key, by..., n) as count_classes of read_sets gives, for any number of loci; `by` is among `read`."""
    counts = print_counts(read_prints(alignments, read, locus), read, by)
    return counts.join(print_names(counts, alignments, read, locus), PRINT).select("ec_key", *by, "n")


def same_classes(a: DataFrame, n: DataFrame, hashed=lanes) -> DataFrame:
    """(ec_id, first): for each class of incidence or counts the least one with the very same rows.

    Classes without rows are one.  Classes with equal fingerprints are compared row by
    row with the least of them; what differs after all is grouped by its rows themselves.
    """
    cells = a.where("v <> 0").select("ec_id", *AXES, "v")
    hashes = [F.when(F.col("v") != 0, h).otherwise(0) for h in hashed(*AXES, "v")]
    none = n.select("ec_id", *[F.lit(0).cast("long").alias(c) for c in PRINT])
    own = a.select("ec_id", *[h.alias(c) for h, c in zip(hashes, PRINT)], (F.coalesce("v", F.lit(0)) != 0).cast("long").alias("k"))
    every = own.unionByName(none).groupBy("ec_id").agg(F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2"), F.sum("k").alias("k"))
    least = every.groupBy(*PRINT).agg(F.min("ec_id").alias("first"))
    found = written(every.join(least, PRINT).select("ec_id", "first", "k"), "classes")
    others = found.where("ec_id <> first")
    theirs = cells.select(F.col("ec_id").alias("first"), *AXES, F.col("v").alias("_v"))
    equal = others.join(cells, "ec_id").join(theirs, ["first", *AXES]).where("v = _v").groupBy("ec_id").agg(F.count("*").alias("_equal"))
    unlike = written(others.where("k > 0").join(equal, "ec_id", "left").where(F.coalesce("_equal", F.lit(0)) != F.col("k")).select("ec_id"), "unlike")
    if unlike.isEmpty():
        discard(unlike)
        return found.select("ec_id", "first")
    # different rows under one fingerprint: every class under it by its rows
    shared = found.join(found.join(unlike, "ec_id").select("first").distinct(), "first", "left_semi")
    rows = shared.select("ec_id").join(cells, "ec_id").groupBy("ec_id").agg(F.array_sort(F.collect_list(F.struct(*AXES, "v"))).alias("_rows"))
    again = rows.join(rows.groupBy("_rows").agg(F.min("ec_id").alias("first")), "_rows").select("ec_id", "first")
    empty = shared.where("k = 0").join(shared.where("k = 0").agg(F.min("ec_id").alias("_e"))).select("ec_id", F.col("_e").alias("first"))
    return found.join(shared.select("ec_id"), "ec_id", "left_anti").select("ec_id", "first").unionByName(again).unionByName(empty)


def recollapse(a: DataFrame, n: DataFrame, hashed=lanes) -> tuple[DataFrame, DataFrame]:
    """Incidence and counts (ec_id, sample, n) with classes that have become alike, by masking or
    bundling, made one again under the least of their numbers; classes left empty stay, as one."""
    same = written(same_classes(a, n, hashed), "same")
    kept = a.where("v <> 0").join(same.where("ec_id = first").select("ec_id"), "ec_id", "left_semi")
    counts = n.join(same, "ec_id").groupBy(F.col("first").alias("ec_id"), "sample").agg(F.sum("n").alias("n"))
    return kept, counts


def escaped(name: Column) -> Column:
    """A name in which a backslash stands before every backslash, colon and comma."""
    return F.regexp_replace(name, r"([\\:,])", r"\\$1")


def named_keys(a: DataFrame) -> DataFrame:
    """(ec_id, ec_key): each class as its sorted target:haplotype names, escaped and joined by commas."""
    name = F.concat_ws(":", escaped(F.col("target")), escaped(F.col("hap")))
    return a.where("v <> 0").groupBy("ec_id").agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("ec_key"))


def merged(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Incidence and counts of several files as one: classes are the same if their targets and
    haplotypes have the same names.  A class is known by its first file and its number there:
    the file from bit 48 on."""
    number = F.col("ec_id").cast("long")
    fits = F.when(number.between(0, (1 << 48) - 1), number).otherwise(F.raise_error(F.concat(F.lit("no class number below 2^48: "), F.coalesce(number.cast("string"), F.lit("null")))).cast("long"))
    own = lambda df, k: df.withColumn("ec_id", fits + F.lit(k << 48))
    a = reduce(DataFrame.unionByName, [own(a, k).select("ec_id", *AXES, "v") for k, (a, _) in enumerate(parts)])
    n = reduce(DataFrame.unionByName, [own(n, k).select("ec_id", "sample", "n") for k, (_, n) in enumerate(parts)])
    a, n = written(a, "merged_rows"), written(n, "merged_counts")
    a, n = (dealt(df, df.count(), "ec_id") for df in (a, n))
    return recollapse(a, n)
