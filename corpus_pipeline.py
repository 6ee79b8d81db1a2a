"""A corpus pipeline from five operators: quality rules, exact dedup, near-duplicate
dedup, mixing sources to target weights, packing.

Each stage is written as Parquet and read again as the next one's documents; what a
stage wrote on its way is deleted then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import drop_copies
from tessera.llm.mixing import take_mixture
from tessera.llm.ngram_join import keep_one_of_each
from tessera.llm.packing import pack
from tessera.llm.quality_rules import keep_good
from tessera.llm.store import fresh_path, scratch, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", lambda spark, docs, sf_dir: keep_good(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: drop_copies(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: keep_one_of_each(docs)),
    ("mixing sources to target weights", lambda spark, docs, sf_dir: take_mixture(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Estimation, near-duplicate classes and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for i, (_, stage) in enumerate(first):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), fresh_path(spark, f"stage{i}"))
    return last(spark, docs, sf_dir)
