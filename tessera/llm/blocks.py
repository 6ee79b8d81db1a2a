"""Dealing the members of groups to blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, member: str, chunks: Column) -> DataFrame:
    """Each row once for every block pair (i, j), i <= j, of its group that holds it.

    `chunks` is the group's number of chunks.  A group of one chunk stays one
    block.  In a larger one any two members meet in some block, so a task holds
    two chunks at most, however large the group is.
    """
    dealt = members.withColumn("_n", chunks.cast("int")).withColumn("_c", F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("_n")).cast("int"))
    other = F.explode(F.when(F.col("_n") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("_o", other).withColumn("i", F.least("_c", "_o")).withColumn("j", F.greatest("_c", "_o")).withColumn("side", (F.col("_c") == F.col("j")).cast("int")).drop("_n", "_c", "_o")
