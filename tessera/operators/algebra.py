"""Sparse algebra over incidence tables (ec_id, target, hap, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ["ec_id", "target", "hap"]


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*AXES).agg(F.sum("v").alias("v")).where("v <> 0")


def _spread(b: DataFrame, haplotypes: DataFrame | None) -> DataFrame:
    """A two-dimensional operand (ec_id, target, v) applies to every haplotype."""
    if "hap" in b.columns:
        return b.select(*AXES, "v")
    if haplotypes is None:
        raise ValueError("a two-dimensional operand needs the haplotypes")
    names = haplotypes.agg(F.collect_set("hap").alias("haps"))  # one row of a handful
    return b.select("ec_id", "target", "v").join(F.broadcast(names)).select("ec_id", "target", F.explode("haps").alias("hap"), "v")


def add(a: DataFrame, b: DataFrame, haplotypes: DataFrame | None = None) -> DataFrame:
    return _summed(a.select(*AXES, "v").unionByName(_spread(b, haplotypes)))


def subtract(a: DataFrame, b: DataFrame, haplotypes: DataFrame | None = None) -> DataFrame:
    return _summed(a.select(*AXES, "v").unionByName(_spread(b, haplotypes).withColumn("v", -F.col("v"))))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise product with a table over any of the axes: its value column `v`
    applies wherever its axis columns match; coordinates that it lacks vanish."""
    on = [c for c in AXES if c in b.columns]
    if not on:
        raise ValueError("the operand has none of the axes")
    return a.join(b.select(*on, F.col("v").alias("_v")), on).select(*AXES, (F.col("v") * F.col("_v")).alias("v")).where("v <> 0")


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.select(*AXES, (F.col("v") * F.lit(factor)).alias("v")).where("v <> 0")


def matmul(a: DataFrame, m: DataFrame) -> DataFrame:
    """Product with a matrix (target, to, v): `to` becomes the target axis."""
    out = a.join(m.select("target", "to", F.col("v").alias("_v")), "target")
    return out.groupBy("ec_id", F.col("to").alias("target"), "hap").agg(F.sum(F.col("v") * F.col("_v")).alias("v")).where("v <> 0")


def reset(a: DataFrame) -> DataFrame:
    return a.where("v <> 0").select(*AXES, F.lit(1.0).alias("v"))


def cross_section(a: DataFrame, axis: str, value) -> DataFrame:
    return a.where(F.col(axis) == F.lit(value)).select(*[c for c in AXES if c != axis], "v")


def add_value(a: DataFrame, cells: DataFrame) -> DataFrame:
    return add(a, cells)


def set_value(a: DataFrame, cells: DataFrame) -> DataFrame:
    return a.join(cells, AXES, "left_anti").select(*AXES, "v").unionByName(cells.select(*AXES, "v")).where("v <> 0")


def combine(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """The classes of both, those of the second renumbered from `offset`; none are merged."""
    return a.select(*AXES, "v").unionByName(b.select((F.col("ec_id") + offset).alias("ec_id"), "target", "hap", "v"))


def combine_rows(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Counts or names by class of both, as `combine` numbers the classes; columns that one lacks are null."""
    return first.unionByName(second.withColumn("ec_id", F.col("ec_id") + offset), allowMissingColumns=True)


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts (ec_key, sample, n) of several files by class key and sample."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("ec_key", "sample").agg(F.sum("n").alias("n"))
