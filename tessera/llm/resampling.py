"""Importance resampling towards a target distribution of hashed word n-grams.

Every word n-gram falls into one of BUCKETS buckets by its crc32.  A bucket's gain is the
log ratio of its smoothed share in the target to that in the documents, a document's
weight the mean gain of its features, and the draw takes the highest weights plus
Gumbel noise, which samples without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BUCKETS = 10_000
#: What each byte of UTF-8 becomes: A-Z lower case, other ASCII characters than letters and digits a space.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def feature_buckets(found: list[bytes], longest: int = 2) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words: the checksum of a run is that of
    the run without its last word carried on over a space and the word."""
    sums, spaced, out = list(map(zlib.crc32, found)), [b" " + w for w in found], []
    for size in range(1, longest + 1):
        out.append(np.array(sums, np.uint32))
        sums = list(map(zlib.crc32, spaced[size:], sums))
    return (np.concatenate(out) % BUCKETS).astype(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, longest: int = 2) -> Counter:
    """How many features of all `texts` (text) fall into each bucket; a task sends a row a bucket at most."""

    def task(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in _texts(batch, "text"):
                total.update(feature_buckets(words(text), longest).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return Counter({r.bucket: r.n for r in counted.collect()})  # BUCKETS rows at most


def gains(documents: Counter, target: Counter) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the documents, one added to every bucket."""
    mine, theirs = float(documents.total() + BUCKETS), float(target.total() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(target[b] + 1) * mine / (float(documents[b] + 1) * theirs))) for b in range(BUCKETS)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of a standard Gumbel value g that seed and id determine; a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, longest: int, seed: int):
    def task(batches):
        for batch in batches:
            ids, sizes, features, weights = batch.column("doc_id").to_pylist(), [], [], []
            for text in _texts(batch, "text"):
                buckets = feature_buckets(found := words(text), longest)
                sizes.append(len(found))
                features.append(len(buckets))
                weights.append(int(gain[buckets].sum()) // len(buckets) if len(buckets) else 0)
            scores = [w + noise(i, seed) for w, i in zip(weights, ids, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (ids, sizes, features, weights, scores)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("tie")], ["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    return task


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_features, weight, score, rank.

    Of the N documents with `least_words` words floor(percent N / 100) are drawn: the
    highest scores, ties to the smaller doc_id, then (null or repeated ids) by a hash of
    the text and the place in the input, so that exactly that many ranks are given.
    The rank counts from 1 and is null for what isn't drawn.  Null and empty texts have
    no features and weight 0; an empty table gives none, an empty target a target
    without features.  Other columns are ignored.

    Texts are read twice, once for the bucket counts and once for the weights, and never
    shuffled.  Ranks come from a count per score: a score is a whole number of
    thousandths of a log, so its values are some ten thousand whatever the rows, and
    rows are sorted only inside one score.
    """
    gain = gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    scored = materialize(own.mapInArrow(_weigh(gain, longest, seed), "doc_id long, n_words long, n_features long, weight long, score long, tie long").withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    counts = able.groupBy("score").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    wanted = counts.agg(F.floor(F.lit(percent) * F.coalesce(F.sum("_n"), F.lit(0)) / 100).alias("_wanted"))
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "tie", "row"))
    open_scores = F.broadcast(counts.join(F.broadcast(wanted)).where("_before < _wanted").select("score", "_before", "_wanted"))  # a row per score
    drawn = able.join(open_scores, "score").select("row", (F.col("_before") + within).cast("long").alias("rank"), "_wanted").where("rank <= _wanted")
    return scored.join(drawn.select("row", "rank"), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
