"""Readers of the line-based inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import chromosome
from ..operators.classes import dense_index
from .bam import SPLIT
from .fastq import is_blocked, read_blocked_fastq


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one file, numbered from 0.

    A count per partition gives each its start; the lines themselves aren't shuffled.
    """
    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    starts = lines.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return lines.join(F.broadcast(starts), "_p").select((F.coalesce("_s", F.lit(0)) + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(target, target_idx): the first word of each line that is no comment or blank, in order of first sight."""
    lines = numbered_lines(spark, path).where(~F.startswith("value", F.lit("#")))
    names = lines.select(F.split(F.trim("value"), r"\s+")[0].alias("target"), "line").where("target <> ''")
    return dense_index(names, "target", "line", "target_idx")


def all_targets(listed: DataFrame, header: DataFrame) -> DataFrame:
    """Listed targets, then the unseen ones of a header (target, tid), indexed in that order."""
    both = listed.select("target", F.col("target_idx").alias("o"), F.lit(0).alias("k")).unionByName(header.select("target", F.col("tid").cast("long").alias("o"), F.lit(1).alias("k")))
    return dense_index(both.select("target", F.struct("k", "o").alias("o")), "target", "o", "target_idx")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(gene, target) of lines `gene TAB isoform TAB isoform ...`."""
    parts = spark.read.text(path).select(F.split(F.rtrim("value"), "\t").alias("p")).where(F.size("p") > 1)
    return parts.select(F.col("p")[0].alias("gene"), F.explode(F.slice("p", 2, F.size("p") - 1)).alias("target")).where("target <> ''")


def check_groups(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """`groups`, or an error naming a target that the profile lacks."""
    if missing := groups.join(targets, "target", "left_anti").select("target").take(1):
        raise KeyError(missing[0].target)
    return groups


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, hap) of lines `gene TAB letters` after leading comments, a row per letter."""
    lines = numbered_lines(spark, path)
    start = lines.where(~F.startswith("value", F.lit("#"))).agg(F.min("line").alias("s"))
    rows = lines.join(F.broadcast(start)).where("line >= s").select(F.split("value", "\t").alias("p")).where(F.size("p") > 1)
    return rows.select(F.col("p")[0].alias("gene"), F.explode(F.split(F.trim(F.col("p")[1]), "")).alias("hap")).where("hap <> ''")


GENE_COLUMNS = ["gene_id", "chromosome", "start_pos_bp", "end_pos_bp", "strand", "symbol", "name", "transcripts"]


def read_gene_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gene table and groups (gene, target); genes without a known chromosome go."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in GENE_COLUMNS))
    genes = raw.select(*[F.trim(c).alias(c) for c in GENE_COLUMNS]).withColumn("chromosome", chromosome(F.col("chromosome"))).where("chromosome is not null")
    genes = genes.withColumns({c: F.col(c).cast("bigint") for c in ("start_pos_bp", "end_pos_bp")})
    return genes.drop("transcripts"), genes.select(F.col("gene_id").alias("gene"), F.explode(F.transform(F.split("transcripts", ","), lambda t: F.trim(t))).alias("target")).where("target <> ''")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema="sample_id string, file string")
    return raw.select(*[F.trim(c).alias(c) for c in raw.columns])


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(read_id, sequence) of a file of four-line records.

    A plain file is read in Spark's splits, a block-compressed one in exact ranges of
    about `split` bytes; a file that is one compressed stream can't be cut and is one task.
    """
    if is_blocked(path):
        return read_blocked_fastq(spark, path, split).select("read_id", "sequence")
    lines = numbered_lines(spark, path).withColumn("record", F.expr("line div 4"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = lines.where("line % 4 < 2").groupBy("record").agg(part(0).alias("n"), part(1).alias("sequence"))
    return rows.select(F.substring_index(F.expr("substring(n, 2)"), " ", 1).alias("read_id"), "sequence")


def split_fastq(spark: SparkSession, path: str, parts: int, out: str) -> None:
    """Write a FASTQ file as `parts` files of whole records, in their order."""
    lines = numbered_lines(spark, path).withColumn("record", F.expr("line div 4"))
    lines.repartitionByRange(parts, "record").sortWithinPartitions("line").select("value").write.text(out)


def read_salmon(spark: SparkSession, classes: str, quant: str) -> tuple[DataFrame, DataFrame]:
    """Classes (ec_id, target index, n) and targets (idx, name, length) of a quantifier's output.

    The class file names its number of targets and classes, the targets, then
    lines `k TAB id ... TAB count`.  Every target needs an effective length.
    """
    lines = numbered_lines(spark, classes).where("line >= 2")
    names = lines.where(~F.contains("value", F.lit("\t"))).select((F.col("line") - 2).alias("idx"), F.col("value").alias("name"))
    parts = lines.where(F.contains("value", F.lit("\t"))).select(F.col("line").alias("ec_id"), F.split("value", "\t").alias("p"))
    k = F.col("p")[0].cast("int")
    rows = parts.select("ec_id", F.get("p", k + 1).cast("bigint").alias("n"), F.explode(F.slice("p", F.lit(2), k).cast("array<bigint>")).alias("idx"))
    lengths = spark.read.csv(quant, sep="\t", header=True)
    lengths = lengths.select(F.col(lengths.columns[0]).alias("name"), F.col(lengths.columns[2]).cast("double").alias("_length"))
    length = F.coalesce("_length", F.raise_error(F.concat(F.lit("no effective length: "), F.col("name"))).cast("double"))
    return rows, names.join(lengths, "name", "left").select("name", "idx", length.alias("length"))


def read_salmon_targets(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(idx, name): `known` targets of the class file, then the unseen ones of a target file (first column), in its order."""
    listed = numbered_lines(spark, path).select(F.split("value", "\t")[0].alias("name"), F.col("line").alias("o"), F.lit(1).alias("k")).where("name <> ''")
    both = known.select("name", F.col("idx").alias("o"), F.lit(0).alias("k")).unionByName(listed)
    return dense_index(both.select("name", F.struct("k", "o").alias("o")), "name", "o", "idx")


def name_differences(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """(side, name): names that only one of two tables has."""
    only = lambda x, y, side: x.select(name).distinct().join(y, name, "left_anti").select(F.lit(side).alias("side"), F.col(name).alias("name"))
    return only(one, other, "first").unionByName(only(other, one, "second"))


def check_same(files: list[DataFrame], name: str) -> None:
    """An error naming a target (or haplotype) that isn't in all of the files' tables."""
    for other in files[1:]:
        if found := name_differences(files[0], other, name).take(1):
            raise ValueError(f"only one file has {name} {found[0].name}")
