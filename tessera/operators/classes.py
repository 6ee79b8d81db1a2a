"""Collapsing alignments into equivalence classes of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import mask_of
from ..tables import written


def valid_alignments(alignments: DataFrame) -> DataFrame:
    """Mapped alignments; of pairs only the first read of a proper pair on one reference."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b))
    paired_ok = (bit(128) == 0) & (bit(2) != 0) & (F.col("tid") == F.col("mate_tid")) & (F.col("mate_pos") >= 0)
    return alignments.where((bit(4) == 0) & ((bit(1) == 0) | paired_ok))


def number_runs(rows: DataFrame, key: str, order: str, group: list[str]) -> DataFrame:
    """Adds `run`: consecutive rows of a group with an equal key share a number (from 0)."""
    w = Window.partitionBy(*group).orderBy(order)
    change = (F.coalesce(F.col(key) != F.lag(key).over(w), F.lit(False))).cast("int")
    return rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def number_long_runs(rows: DataFrame, key: str, order: str, group: list[str], span: int) -> DataFrame:
    """As number_runs, for groups of any size and a whole-number `order`.

    The order is cut into stretches of `span`; runs are numbered inside stretches by
    a window each, and a small table of the stretches (first and last key, changes)
    says how many runs there were before and whether one goes on over a border.
    """
    part = rows.withColumn("_s", F.floor(F.col(order) / span))
    w = Window.partitionBy(*group, "_s").orderBy(order)
    change = F.coalesce(F.col(key) != F.lag(key).over(w), F.lit(False)).cast("long")
    part = part.withColumn("_c", change).withColumn("_in", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = part.groupBy(*group, "_s").agg(F.min_by(key, order).alias("_a"), F.max_by(key, order).alias("_z"), F.sum("_c").alias("_n"))
    v = Window.partitionBy(*group).orderBy("_s")
    begins = F.coalesce(F.col("_a") != F.lag("_z").over(v), F.lit(False)).cast("long")
    before = F.coalesce(F.sum("_n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_b", begins).withColumn("_base", before + F.sum("_b").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return part.join(ends.select(*group, "_s", "_base"), [*group, "_s"]).withColumn("run", F.col("_base") + F.col("_in")).drop("_s", "_c", "_in", "_base")


def number_any_runs(rows: DataFrame, key: str, order: str, group: list[str], span: int, most: int = 1 << 20) -> DataFrame:
    """number_runs while the largest group, counted first, has at most `most` rows, else number_long_runs."""
    largest = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return number_runs(rows, key, order, group) if largest <= most else number_long_runs(rows, key, order, group, span)


def read_sets(alignments: DataFrame, read: list[str], locus: str = "tid") -> DataFrame:
    """One row per read: `ec_key`, its distinct loci as text in string order, joined by commas.

    Reads are told apart by `read`; pass a run number among it when adjacency of
    names defines a read.  The set of one read is bounded by the loci it hits.
    """
    return alignments.groupBy(*read).agg(F.array_join(F.sort_array(F.collect_set(F.col(locus).cast("string"))), ",").alias("ec_key"))


def read_masks(alignments: DataFrame, read: list[str], index: Column) -> DataFrame:
    """One row per read: `mask`, a bit per locus by its `index` (0 to 62).

    For at most 63 loci a number takes the place of the set, so that the
    aggregation stays in fixed-size buffers; name_masks gives the text keys.
    """
    return alignments.groupBy(*read).agg(F.bit_or(mask_of(index)).alias("mask"))


def name_masks(counts: DataFrame, loci: list[str]) -> DataFrame:
    """Counted masks with `ec_key` in place of the mask; loci by index, their names ordered as text in the key."""
    order = sorted(range(len(loci)), key=lambda i: loci[i].encode())
    names = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(loci[i])) for i in order])
    return counts.select(F.array_join(F.array_compact(names), ",").alias("ec_key"), *[c for c in counts.columns if c != "mask"])


def total_count(counts: DataFrame) -> DataFrame:
    """All reads that were counted, one row."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def count_classes(sets: DataFrame, by: list[str] = (), key: str = "ec_key") -> DataFrame:
    """Reads per class, and per `by` (cell, sample) if given; `n`."""
    return sets.groupBy(key, *by).agg(F.count("*").alias("n"))


def keep_cells(counts: DataFrame, minimum: int, cell: str = "cell") -> DataFrame:
    """Counts of the cells with at least `minimum` reads (at least 1); classes left without any go."""
    cells = counts.groupBy(cell).agg(F.sum("n").alias("total")).where(F.col("total") >= max(1, minimum))
    return counts.join(cells.select(cell), cell, "left_semi")


def drop_trailing_read(alignments: DataFrame) -> DataFrame:
    """Compatibility: without the last read name of each file."""
    last = alignments.groupBy("file").agg(F.max_by("qname", "ord").alias("_last"))
    return alignments.join(last, "file").where(F.col("qname") != F.col("_last")).drop("_last")


def dense_index(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Ordinals from 0 of the keys by their smallest `order`: first seen first.

    The keys are sorted in ranges and written with their place: range and row in it.
    A count per range says how many come before, so no task sees all keys.
    """
    first = rows.groupBy(key).agg(F.min(order).alias("_o")).orderBy("_o", key)
    placed = written(first.select(key, F.monotonically_increasing_id().alias("_m")), "ordinals").withColumn("_r", F.shiftright("_m", 33))
    sizes = placed.groupBy("_r").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    return placed.join(F.broadcast(before), "_r").select(key, (F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def renumbered(counts: DataFrame, key: str = "ec_key", name: str = "ec_id") -> DataFrame:
    """Counts with dense class numbers in the order of the keys, as after cells were dropped."""
    index = dense_index(counts.select(key, F.col(key).alias("_k")), key, "_k", name)
    return counts.join(index, key)
