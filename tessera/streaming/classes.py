"""Class counts of a stream of alignments: reads close as the watermark passes them.

The first stage gathers the loci of a read until no more can come; the second counts
the classes of closed reads.  Both keep their state in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Reads(StatefulProcessor):
    """Distinct loci of one read, given out once as a key when the read closes."""

    def __init__(self, gap: int):
        self.gap = gap  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loci = handle.getMapState("loci", "locus string", "seen boolean")
        self.closes = handle.getValueState("closes", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.closes.get()[0] if self.closes.exists() else None
        at = last
        for batch in rows:
            for locus in batch["locus"].astype(str).unique():
                self.loci.updateValue((locus,), (True,))
            end = int(batch["ms"].max()) + self.gap
            at = end if at is None else max(at, end)
        if at is not None and at != last:
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(at)
            self.closes.update((at,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        loci = sorted((k[0] for k in self.loci.keys()), key=lambda x: x.encode())
        closed = pd.Timestamp(self.closes.get()[0], unit="ms")
        self.loci.clear()
        self.closes.clear()
        yield pd.DataFrame({"read": [key[0]], "ec_key": [",".join(loci)], "closed": [closed]})

    def close(self) -> None:
        pass


def closed_reads(stream: DataFrame, read: str, locus: str, time: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(read, ec_key, closed): each read once, as its distinct loci in text order joined by commas.

    A read closes `gap` after its last alignment, once the watermark, `late` behind the
    newest event, has passed that; a name that comes back later is another read.  State
    is the loci of open reads.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    own = stream.selectExpr(f"cast(`{read}` as string) as read", f"cast(`{locus}` as string) as locus", f"cast(`{time}` as timestamp) as time", f"unix_millis(cast(`{time}` as timestamp)) as ms").withWatermark("time", late)
    return own.groupBy("read").transformWithStateInPandas(_Reads(gap_ms), "read string, ec_key string, closed timestamp", "Append", "EventTime")


def add_counts(totals: str):
    """A writer for foreachBatch that keeps (ec_key, n) of all closed reads in the folder `totals`:
    each batch adds a file of its counts under its number, so that a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("ec_key").count().withColumnRenamed("count", "n").write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return write


def counted(spark: SparkSession, totals: str) -> DataFrame:
    """(ec_key, n) of what add_counts has written so far."""
    return spark.read.parquet(totals).groupBy("ec_key").agg(F.sum("n").alias("n"))
