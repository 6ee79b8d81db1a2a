"""From classes to the sparse class x target x haplotype incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import mask_of, set_bits


def incidence(classes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ec_id, target, hap, v) of classes (ec_id, ec_key) by a join of their loci with refs (tid, target, hap).

    `refs` is a header's dictionary; Spark broadcasts it while it is small.
    """
    loci = classes.select("ec_id", F.explode(F.split("ec_key", ",")).alias("_t"))
    return loci.join(refs.withColumn("_t", F.col("tid").cast("string")), "_t").select("ec_id", "target", "hap", F.lit(1.0).alias("v")).distinct()


def to_mask(a: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """(ec_id, target, mask): one bit per aligned haplotype, from haplotypes (hap, hap_idx), at most 63."""
    return a.where("v <> 0").join(F.broadcast(haplotypes), "hap").groupBy("ec_id", "target").agg(F.bit_or(mask_of(F.col("hap_idx"))).alias("mask"))


def from_mask(masked: DataFrame, haplotypes: DataFrame) -> DataFrame:
    planes = masked.select("ec_id", "target", F.explode(set_bits(F.col("mask"))).alias("hap_idx"))
    return planes.join(F.broadcast(haplotypes), "hap_idx").select("ec_id", "target", "hap", F.lit(1.0).alias("v"))
