"""Alignment-shaped relations derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dealt

BROADCAST_ROWS = 1 << 18  # parts (key, brand, type) that are sent to every executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_alignments(spark: SparkSession, sf_dir: str, cell: bool = True) -> DataFrame:
    """Order lines as alignments: read = order, locus = brand, haplotype = return flag, cell = nation.

    Without `cell` the orders and customers aren't joined: every line has both.  Parts are
    sent to every executor while they are few; else both are dealt by part, and each task
    hashes its share of the parts, so that lines are never sorted.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    if part.count() <= BROADCAST_ROWS:
        part = F.broadcast(part)
    else:
        rows = line.count()
        line, part = dealt(line, rows, "l_partkey"), dealt(part, rows, "p_partkey").hint("shuffle_hash")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    columns = [F.col("l_orderkey").alias("read_id"), F.col("p_brand").alias("target"), F.col("l_returnflag").alias("hap"), "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus", "p_type"]
    if not cell:
        return joined.select(*columns)
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return joined.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*columns, F.col("c_nationkey").alias("cell"))


def line_incidence(spark: SparkSession, sf_dir: str, status: str = "F", v: float = 1.0, by: tuple[str, ...] = ("ec_id",)) -> DataFrame:
    """Incidence (ec_id = read, target, hap, v) of the lines of one status, valid ones if not
    said otherwise, dealt by the columns `by`."""
    lines = line_alignments(spark, sf_dir, cell=False).where(F.col("l_linestatus") == status).select(F.col("read_id").alias("ec_id"), "target", "hap")
    return dealt(lines, table(spark, sf_dir, "lineitem").count(), *by).distinct().withColumn("v", F.lit(v))


def read_incidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incidence and counts (ec_id, sample = cell, n) of valid lines."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    reads = line.where("l_linestatus = 'F'").select("l_orderkey").distinct()
    n = reads.join(orders, reads.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return line_incidence(spark, sf_dir), n.select(F.col("l_orderkey").alias("ec_id"), F.col("c_nationkey").alias("sample")).distinct().withColumn("n", F.lit(1).cast("long"))


def part_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes with a place and a count: chr, start_pos, end_pos, read_count, gene_id, symbol."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    count = line.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("read_count"))
    start = F.floor(F.col("p_retailprice") * 1000).cast("long")
    return part.join(count, part.p_partkey == count.l_partkey).select(
        F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("chr"), start.alias("start_pos"), (start + F.col("p_size") * 10000).alias("end_pos"), "read_count"
    )
