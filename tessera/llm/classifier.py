"""Quality classifier: regularised quadratic discriminant on document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import SLICE, hashed_words
from .store import broadcast_if_small, materialize

FEATURES = ("length", "word_length", "symbols", "capitals", "marks", "bars", "digits", "ends", "distinct", "adjacent", "lines", "accents")
#: Share of the pooled covariance, then of the diagonal, mixed into each class covariance.
POOLED, DIAGONAL = 0.2, 0.1
MOST_LABELS = 1_000_000  # labelled rows used at most (those with the smallest hashes of doc_id)

_TABLES = {
    "symbols": b"#*$%&<>@^~\\{}[]=_",
    "capitals": bytes(range(65, 91)),
    "marks": b"!?",
    "bars": b"|",
    "digits": b"0123456789",
    "ends": b".",
    "lines": b"\n",
    "accents": bytes(range(0xC0, 0x100)),
}
_CLASS = np.full(256, len(_TABLES), np.uint8)
for _k, _c in enumerate(_TABLES.values()):
    _CLASS[list(_c)] = _k


def _class_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bytes of each class in each row, counted a slice at a time."""
    width = len(_TABLES) + 1
    out = np.zeros((len(offsets) - 1) * width, np.int64)
    for at in range(0, len(data), SLICE):
        part = _CLASS[data[at : at + SLICE]]
        row = np.searchsorted(offsets, np.arange(at, at + len(part)), side="right") - 1
        out += np.bincount(row * width + part, minlength=len(out))
    return out.reshape(-1, width)[:, :-1].astype(float)


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text: logs of counts and square roots of shares, 0 without words."""
    out = []
    for offsets, data, hashes, sizes, first in hashed_words(column):
        shares = np.sqrt(_class_counts(offsets, data) / np.maximum(np.diff(offsets)[:, None], 1))
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        n = np.diff(first)
        part = np.zeros((len(n), len(FEATURES)))
        part[:, 2:8] = shares[:, :6]
        part[:, 10:12] = shares[:, 6:8]
        for i in np.flatnonzero(n):
            a, b = first[i], first[i + 1]
            part[i, 0] = np.log1p(n[i])
            part[i, 1] = np.log(sizes[a:b].mean())
            # the share of distinct words falls with length, so it is set against what its logarithm allows
            part[i, 8] = np.log1p(len(np.unique(hashes[a:b]))) / np.log1p(n[i])
            part[i, 9] = np.sqrt(same[a + 1 : b].sum() / n[i])
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _measure(batches):
    for batch in batches:
        x = document_statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], ["doc_id", *FEATURES])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each label its rows, mean and covariance: one aggregation, whose result is 2 rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = {}
    for r in rows.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect():
        c = np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        out[int(r["label"])] = int(r["n"]), np.array([r[f"m{i}"] for i in range(d)]), c
    return out


def discriminant(stats: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Column:
    """Posterior probability of label 1 as an expression over FEATURES.

    Class covariances are shrunk to the pooled one and to their own diagonal.
    Each one's Cholesky factor is inverted once; a log density is then minus half
    the squared length of the factor's inverse times the centred statistics.
    With rows of one label only, the score is that label's; without any, 0.5.
    """
    if set(stats) != {0, 1}:
        return F.lit(0.5 if not stats else float(max(stats)))
    total = sum(n for n, _, _ in stats.values())
    pooled = sum(n * c for n, _, c in stats.values()) / total
    density = {}
    for label, (n, mean, c) in stats.items():
        c = (1 - POOLED) * c + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        inverse = np.linalg.inv(factor)
        square = F.lit(0.0)
        for i in range(len(c)):
            row = F.lit(0.0)
            for j in range(i + 1):
                row = row + (F.col(FEATURES[j]) - float(mean[j])) * float(inverse[i, j])
            square = square + row * row
        density[label] = -0.5 * square - float(np.log(np.diag(factor)).sum()) + float(np.log(n / total))
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), density[0] - density[1]))))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = MOST_LABELS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from the rows of `labels` (doc_id, quality 0 or 1) whose
    crc32(doc_id as text) mod 5 is not 0; scores come from the text alone.  Null
    and empty texts have all statistics 0 and are scored like any other; null
    labels are passed over, repeated ones count each time; other columns are
    ignored.  Of more than `most` labelled rows those with the smallest hashes of
    doc_id are used.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = materialize(own.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = materialize(marked, "labels")
    if (n := marked.count()) > most:
        cut = marked.select(F.xxhash64("doc_id").alias("h")).approxQuantile("h", [most / n], 1e-3)[0]
        marked = marked.where(F.xxhash64("doc_id") <= cut)
    model = discriminant(moments(measured.join(broadcast_if_small(marked, 16), "doc_id")))
    scored = measured.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
