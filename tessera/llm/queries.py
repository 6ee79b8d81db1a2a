"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, ngram_join, oracles, sharding
from .classifier import score_quality
from .exact_dedup import exact_dedup
from .line_dedup import find_repeated_lines
from .mixing import mix_sources
from .packing import pack
from .passage_dedup import passage_dedup
from .periodic_runs import periodic_runs, planted
from .pii import find_personal_data, summary
from .quality_rules import quality_rules
from .resampling import resample
from .sharding import shard
from .token_files import round_trip

#: Byte limit of a shard in the registered query.
SHARD_BYTES = 2 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(operator: Callable[..., DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"), **options)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": _on_documents(find_repeated_lines),
        "op2_ngram_join": _on_documents(lambda d: ngram_join.ngram_join(d).drop("class_key")),  # a hash that SQL can't form
        "op3_exact_dedup": _on_documents(exact_dedup),
        "op4_quality_rules": _on_documents(lambda d: quality_rules(d)),
        "op5_mixing": _on_documents(mix_sources),
        "op6_packing": _on_documents(pack),
        "op7_token_files": _on_documents(round_trip),
        "op8_sharding": _on_documents(shard, limit=SHARD_BYTES),
        "op9_pii": _on_documents(lambda d: summary(find_personal_data(d))),
        "op10_quality_classifier": lambda spark, sf_dir: score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
        "op11_periodic_runs": _on_documents(periodic_runs, change=planted),
        "op12_suffix_array_dedup": _on_documents(passage_dedup),
        "op13_importance_resampling": lambda spark, sf_dir: resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    norm = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
    return {
        "op2_ngram_join": ngram_join.oracle_sql(),
        "op3_exact_dedup": f"""with n as (select doc_id, {norm} as norm, length(coalesce(text, '')) as points from documents),
r as (select *, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from n)
select doc_id, keep_id, group_size, keep_id = doc_id as kept, sha256(norm) as text_sha256 from r""",
        "op5_mixing": mixing.oracle_sql(),
        "op8_sharding": sharding.oracle_sql(limit=SHARD_BYTES),
        "op11_periodic_runs": oracles.PERIODIC_RUNS,
        "op12_suffix_array_dedup": oracles.PASSAGES,
        "op13_importance_resampling": oracles.RESAMPLING,
    }


