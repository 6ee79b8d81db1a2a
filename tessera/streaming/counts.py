"""Counts of valid alignments that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per key and window of event time; rows later than `late` are dropped, so state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
