"""Shared reads between genes, lookups over the result, and binned expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Genes of a class whose pairs a task makes at once; larger classes are cut into blocks of so many.
BLOCK = 512


def _pairs(sets: DataFrame, keep: list[str], block: int) -> DataFrame:
    """(keep..., gene_id_1, gene_id_2) of all ordered pairs of the distinct genes in `g`.

    A set of up to `block` genes gives its pairs where it is.  A larger one is cut into
    blocks, and pairs of blocks are dealt to tasks: each makes block x block pairs
    a row, however large the class is.
    """
    pairs = lambda df: df.select(*keep, "h", F.explode("g").alias("gene_id_1")).select(*keep, "gene_id_1", F.explode("h").alias("gene_id_2"))
    small = sets.where(F.size("g") <= block).withColumn("h", F.col("g"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(g) - 1) div {block} as int)")), lambda i: F.slice("g", i * block + 1, F.lit(block)))
    large = sets.where(F.size("g") > block).select(*keep, cut.alias("_b")).select("*", F.explode("_b").alias("g")).select(*keep, "g", F.explode("_b").alias("h"))
    return pairs(small.select(*keep, "g", "h")).unionByName(pairs(large.repartition(F.xxhash64("g", "h"))))


def shared_reads(b: DataFrame, n: DataFrame, block: int = BLOCK) -> DataFrame:
    """(gene_id_1, gene_id_2, read_count): reads of the classes that hit both genes.

    `b` is (ec_id, gene), distinct.  Classes, not reads, are joined with
    themselves; classes with the same genes count together before any pair is made.
    """
    sets = b.join(n.groupBy("ec_id").agg(F.sum("n").alias("n")), "ec_id").groupBy("ec_id").agg(F.collect_set("gene").alias("g"), F.first("n").alias("n"))
    sets = sets.groupBy(F.sort_array("g").alias("g")).agg(F.sum("n").alias("n"))
    return _pairs(sets, ["n"], block).groupBy("gene_id_1", "gene_id_2").agg(F.sum("n").alias("read_count"))


def shared_reads_by(b: DataFrame, n: DataFrame, sample: str = "sample", block: int = BLOCK) -> DataFrame:
    """(sample, gene_id_1, gene_id_2, read_count): shared_reads for every sample.

    Classes with the same genes count together per sample before any pair is made.
    """
    sets = b.groupBy("ec_id").agg(F.sort_array(F.collect_set("gene")).alias("g"))
    sets = sets.join(n, "ec_id").groupBy("g", sample).agg(F.sum("n").alias("n"))
    return _pairs(sets, [sample, "n"], block).groupBy(sample, "gene_id_1", "gene_id_2").agg(F.sum("n").alias("read_count"))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object, as the lookups answer."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def check_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows`, or an error naming a key that occurs twice."""
    if twice := rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").take(1):
        raise ValueError(f"{key} {tuple(twice[0])[:-1]} occurs {twice[0]._n} times")
    return rows


def exactly_one(rows: DataFrame):
    """The only row; an error when there is none or another."""
    found = rows.take(2)
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} rows instead of one")
    return found[0]


def gene_totals(shared: DataFrame) -> DataFrame:
    return shared.where("gene_id_1 = gene_id_2").select(F.col("gene_id_1").alias("gene_id"), "read_count")


def gene_edges(shared: DataFrame) -> DataFrame:
    return shared.where("gene_id_1 <> gene_id_2")


def expression(gene_info: DataFrame, totals: DataFrame, sample_id: str) -> DataFrame:
    return gene_info.join(totals.where((F.col("read_count") > 0) & (F.col("sample_id") == sample_id)), "gene_id")


def neighbors(edges: DataFrame, gene_info: DataFrame, sample_id: str, gene_id: str) -> DataFrame:
    near = edges.where((F.col("sample_id") == sample_id) & (F.col("gene_id_1") == gene_id))
    return near.join(gene_info, near.gene_id_2 == gene_info.gene_id).drop("gene_id_1", "gene_id_2").orderBy(F.desc("read_count"), "gene_id")


def gene_pairs(edges: DataFrame, gene_info: DataFrame, sample_id: str) -> DataFrame:
    """Every edge with both genes' columns, prefixed g1_ and g2_, in the order of both ids."""
    out = edges.where(F.col("sample_id") == sample_id)
    for k in ("1", "2"):
        side = gene_info.select(*[F.col(c).alias(f"g{k}_{c}") for c in gene_info.columns])
        out = out.join(side, F.col(f"gene_id_{k}") == F.col(f"g{k}_gene_id"))
    return out.drop("gene_id_1", "gene_id_2").orderBy("g1_gene_id", "g2_gene_id")


def lookup_gene(gene_info: DataFrame, gene_id: str) -> DataFrame:
    return gene_info.where(F.col("gene_id") == gene_id)


def lookup_symbol(gene_info: DataFrame, symbol: str) -> DataFrame:
    return gene_info.where(F.upper("symbol") == symbol.upper()).orderBy("gene_id").limit(1)


def filter_options(options: DataFrame, text: str, column: str = "label", most: int = 1000) -> DataFrame:
    """Options in which every word of `text` starts some word, ignoring case; the list shows `most`."""
    has = F.split(F.lower(column), r"\s+")
    starts = lambda token: F.exists(has, lambda w: F.startswith(w, F.lit(token)))
    out = options
    for token in text.lower().split():
        out = out.where(starts(token))
    return out.orderBy(column).limit(most)


def expression_bins(genes: DataFrame, size: int) -> DataFrame:
    """(chr, bin, max_expr): the largest log2 count of the genes that touch a bin, ends included."""
    at = F.explode(F.sequence(F.expr(f"start_pos div {size}"), F.expr(f"end_pos div {size}")))
    return genes.select("chr", at.alias("bin"), F.log2("read_count").alias("e")).groupBy("chr", "bin").agg(F.max("e").alias("max_expr"))


def dense_bins(bins: DataFrame) -> DataFrame:
    """(chr, bin, value) for every bin up to each chromosome's last; 0 where no gene is."""
    every = bins.groupBy("chr").agg(F.max("bin").alias("last")).select("chr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("bin"))
    return every.join(bins, ["chr", "bin"], "left").select("chr", "bin", F.coalesce("max_expr", F.lit(0.0)).alias("value"))


def largest_bins(bins: DataFrame) -> DataFrame:
    """(chr, max_expr): the largest value of a chromosome's bins, at least 0."""
    return bins.groupBy("chr").agg(F.greatest(F.lit(0.0), F.max("max_expr")).alias("max_expr"))


def plotted(genes: DataFrame) -> DataFrame:
    """Genes on valid chromosomes but M, with the colour scale's value and the middle of the gene."""
    ok = genes.where(F.col("chr").isNotNull() & ~F.col("chr").isin("M", "MT"))
    return ok.withColumn("color_val", F.log10("read_count") / F.log10(F.lit(1000.0))).withColumn("mid_pos", (F.col("start_pos") + F.col("end_pos")) / 2)


def unique_names(files: DataFrame) -> DataFrame:
    """Adds sample_id: repeated names get _2, _3 ... in the order of their paths."""
    k = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    return files.withColumn("sample_id", F.when(k > 1, F.concat_ws("_", "name", k.cast("string"))).otherwise(F.col("name")))
