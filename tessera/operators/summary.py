"""Sums, unique hits, normalisation and reports over incidence and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import algebra


def sum_locus(a: DataFrame) -> DataFrame:
    return a.groupBy("ec_id", "hap").agg(F.sum("v").alias("v"))


def sum_haplotype(a: DataFrame) -> DataFrame:
    return a.groupBy("ec_id", "target").agg(F.sum("v").alias("v"))


def alignment_counts(a: DataFrame, n: DataFrame, by: list[str] = ()) -> DataFrame:
    """Reads aligned to each haplotype and target, weighted by class counts, per `by` if given."""
    return a.join(n, "ec_id").groupBy("hap", "target", *by).agg(F.sum(F.col("v") * F.col("n")).alias("reads"))


def unique_reads(a: DataFrame, ignore_haplotype: bool) -> DataFrame:
    """The incidence of classes that hit one target (ignoring haplotypes) or one target and haplotype.

    Smallest and largest coordinate tell that apart in one aggregation with map-side combining.
    """
    key = F.struct("target") if ignore_haplotype else F.struct("target", "hap")
    one = a.where("v <> 0").groupBy("ec_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x = y")
    return a.join(one.select("ec_id"), "ec_id", "left_semi")


def unique_allelic(a: DataFrame, n: DataFrame, by: list[str] = ()) -> DataFrame:
    return alignment_counts(unique_reads(a, False), n, by)


def unique_locus(a: DataFrame, n: DataFrame, by: list[str] = ()) -> DataFrame:
    single = unique_reads(a, True).select("ec_id", "target").distinct()
    return single.join(n, "ec_id").groupBy("target", *by).agg(F.sum("n").alias("reads"))


def normalize(a: DataFrame, axis: str, groups: DataFrame | None = None) -> DataFrame:
    """Values as shares: over the haplotypes of a locus (locus), the loci of a
    haplotype (haplotype), a whole class (read), a gene (group), or a gene's
    haplotype (haplogroup); the last two take groups (gene, target), where a target
    may be in several genes, and give a row for each."""
    keys = {"locus": ["ec_id", "target"], "haplotype": ["ec_id", "hap"], "read": ["ec_id"], "group": ["ec_id", "gene"], "haplogroup": ["ec_id", "gene", "hap"]}[axis]
    if "gene" in keys:
        a = a.join(groups, "target")
    return a.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy(*keys)))


def alignment_report(a: DataFrame, n: DataFrame, haplotypes: list[str], targets: DataFrame) -> DataFrame:
    """locus, aln_<hap>..., uniq_<hap>..., locus_uniq for every target.

    Smallest and largest coordinates tell whether a class hits one target, or one target
    and haplotype; they are joined back to the incidence by class, so all buffers have a
    fixed size.
    """
    total = n.groupBy("ec_id").agg(F.sum("n").alias("n"))
    cells = a.where("v <> 0")
    flags = cells.groupBy("ec_id").agg(F.min("target").alias("t"), F.max("target").alias("u"), F.min("hap").alias("h"), F.max("hap").alias("i")).join(total, "ec_id")
    hits = cells.join(flags, "ec_id").withColumn("one", F.col("t") == F.col("u")).withColumn("alone", F.col("one") & (F.col("h") == F.col("i")))
    weight = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("v") * F.col("n"))), F.lit(0.0))
    columns = [weight(F.col("hap") == h).alias(f"aln_{h}") for h in haplotypes] + [weight((F.col("hap") == h) & F.col("alone")).alias(f"uniq_{h}") for h in haplotypes]
    # a class of one target counts once for it, at its first haplotype
    locus = F.coalesce(F.sum(F.when(F.col("one") & (F.col("hap") == F.col("h")), F.col("n"))), F.lit(0)).alias("locus_uniq")
    found = hits.groupBy("target").agg(*columns, locus)
    return targets.select("target").join(found, "target", "left").na.fill(0).withColumnRenamed("target", "locus")


def print_read(a: DataFrame, ec_id, haplotypes: list[str]) -> DataFrame:
    """The loci of one class by name, a column per haplotype, 0 where it isn't hit."""
    values = [F.coalesce(F.sum(F.when(F.col("hap") == h, F.col("v"))), F.lit(0.0)).alias(h) for h in haplotypes]
    return a.where(F.col("ec_id") == F.lit(ec_id)).groupBy("target").agg(*values).orderBy("target")


def reads_of_locus(a: DataFrame, target: str, hap: str | None = None) -> DataFrame:
    """The classes that hit a locus, under one haplotype or any, once each and in order."""
    hit = a.where((F.col("target") == target) & (F.col("v") != 0))
    return (hit if hap is None else hit.where(F.col("hap") == hap)).select("ec_id").distinct().orderBy("ec_id")


def pull(a: DataFrame, n: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidence and counts of the classes in `reads` (ec_id) only."""
    some = reads.select("ec_id").distinct()
    return a.join(some, "ec_id", "left_semi"), n.join(some, "ec_id", "left_semi")


def sorted_haplotypes(a: DataFrame) -> DataFrame:
    """(hap_idx, hap): the haplotypes in text order; a handful, so one window numbers them."""
    return a.select("hap").distinct().select((F.row_number().over(Window.orderBy("hap")) - 1).cast("long").alias("hap_idx"), "hap")


def genotype_mask(a: DataFrame, groups: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Only the haplotypes of each gene's genotype (gene, hap); targets of no listed gene go.
    Classes are not collapsed again, so one may lose all its rows and keep its count."""
    allowed = groups.join(genotypes, "gene").select("target", "hap").distinct()
    return a.join(allowed, ["target", "hap"], "left_semi").select(*algebra.AXES, "v")


def bundle(a: DataFrame, groups: DataFrame, reset: bool = False) -> DataFrame:
    """Values summed over each gene's targets; the gene becomes the target axis."""
    out = a.join(groups, "target").groupBy("ec_id", F.col("gene").alias("target"), "hap").agg(F.sum("v").alias("v"))
    return algebra.reset(out) if reset else out


def target_span(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """target, hap, span: last minus first start position plus one, 0 where nothing aligns."""
    found = alignments.groupBy("tid").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return refs.join(found, "tid", "left").groupBy("target", "hap").agg(F.coalesce(F.max("hi") - F.min("lo") + 1, F.lit(0)).alias("span"))


def span_table(spans: DataFrame, haplotypes: list[str]) -> DataFrame:
    """target_span as a table: a row per target by name, a column per haplotype, 0 where nothing aligns."""
    return spans.groupBy("target").pivot("hap", haplotypes).agg(F.first("span")).na.fill(0).orderBy("target")


def shape(a: DataFrame, n: DataFrame) -> DataFrame:
    left = a.agg(F.count_distinct("target").alias("num_loci"), F.count_distinct("hap").alias("num_haplotypes"), F.count("*").alias("nnz"))
    right = n.agg(F.count_distinct("sample").alias("num_samples"), F.count_distinct("ec_id").alias("num_ecs"))
    return left.join(right)  # one row each
