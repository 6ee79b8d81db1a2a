"""Runs of repeated words inside a text, by Kruskal's algorithm over descending LCPs.

The suffixes of a text (as words) that share a long prefix are united in the order of
that prefix's length.  Each class keeps its positions in order, so that a union shows
which positions become neighbours.  Neighbours i < j that meet at an LCP of at least
j - i begin a stretch with period j - i that ends where the LCP does; it is a run if
the word before i breaks the period.  Every run shows up exactly once, at its first
two periods: no position between them can share so long a prefix, else the period
would not be the smallest.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Numbers(dict):
    """word -> number, given as words turn up."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def _ranks(numbers: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: the rank of the 2^k words from i on (fewer at the end) until all differ."""
    out, size, step = [np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1], len(numbers), 1
    while step < size and out[-1].max() < size:
        behind = np.zeros(size, np.int64)
        behind[:-step] = out[-1][step:]
        out.append(np.unique(out[-1] * (size + 1) + behind, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    return out


def suffix_lcps(numbers: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(lcp, i, j) of neighbours in the suffix array that share `least` words or more, longest first."""
    ranks = _ranks(numbers)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    i, j, shared, size = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(numbers)
    for level in range(len(ranks) - 1, -1, -1):
        # ranks of a level are equal exactly if 2^level whole words are, or both suffixes end alike, which two don't
        inside = (i < size) & (j < size)
        same = inside.copy()
        same[inside] = ranks[level][i[inside]] == ranks[level][j[inside]]
        i, j, shared = i + (same << level), j + (same << level), shared + (same << level)
    found = np.flatnonzero(shared >= least)
    found = found[np.argsort(-shared[found], kind="stable")]
    return list(zip(shared[found].tolist(), a[found].tolist(), b[found].tolist(), strict=True))


def _may_repeat(numbers: np.ndarray, words: int) -> bool:
    """Whether some stretch of `words` words may occur twice (told by its hash, so never denied wrongly)."""
    n = len(numbers) - words + 1
    if n < 2:
        return False
    wide, total = numbers.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(words):
        total = (total ^ (total >> np.uint64(29))) * _MIXERS[1] + wide[k : k + n] * _MIXERS[k % 5]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def runs(numbers: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period), in order, of the maximal stretches with smallest period
    `period` that are at least `least` long and hold the period `times` (2 or more) times."""
    overlap = max(1, min(max(least, times * q) - q for q in range(1, max(2, least))))  # the least LCP of a run's first two periods
    if not _may_repeat(numbers, overlap):
        return []
    word = numbers.tolist()
    root: dict[int, int] = {}
    classes: dict[int, list[int]] = {}
    out = []

    def find(x: int) -> int:
        if x not in root:
            root[x], classes[x] = x, [x]
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def meet(i: int, j: int, shared: int) -> None:
        period = j - i
        if shared + period >= max(least, times * period) and (not i or word[i - 1] != word[j - 1]):
            out.append((i, shared + period, period))

    for shared, a, b in suffix_lcps(numbers, overlap):
        large, small = find(a), find(b)
        if len(classes[large]) < len(classes[small]):
            large, small = small, large
        root[small] = large
        kept, joins = classes[large], classes.pop(small)
        for k, x in enumerate(joins):
            at = bisect_left(kept, x)
            if at and (not k or kept[at - 1] != joins[k - 1]):
                meet(kept[at - 1], x, shared)
            if at < len(kept) and (k + 1 == len(joins) or joins[k + 1] > kept[at]):
                meet(x, kept[at], shared)
            kept.insert(at, x)
    return sorted((i, length, period) for i, length, period in out)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs hold after their first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of the documents, told by the crc32 of the id, turned periodic
    from some word on; a null id counts as no such document."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + [again[k % p] for k in range(n - a)]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(doc_id, words: list[bytes], least: int, times: int) -> tuple:
    known = _Numbers()
    found = runs(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), least, times)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = sorted(found, key=lambda r: (r[0], r[2]))
    text = "".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()
    return doc_id, len(found), start, length, period, 1000 * length // period if found else None, _digest(text), _digest(b" ".join(collapsed(words, found)))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, change=None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_runs, the longest run's start,
    length, period and exponent_milli (null without a run; ties to the smaller start,
    then period), runs_sha256 of all runs, collapsed_sha256 of the text without repeats.

    Words are what the characters of [\\x20\\x09-\\x0D] part; a null or empty text has
    none, no runs and the digests of nothing.  Runs are those of `runs`.  `change(words,
    doc_id)` may alter the words first.  Repeated rows are separate documents; other
    columns are ignored; an empty table gives none.

    A text is looked at by itself, so nothing is shuffled and a task holds one batch of
    texts.  Texts in which no stretch of words occurs twice are told by hashes and need
    no suffix array; the others cost n log n for n words.
    """

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            split = ((i, (t or b"").split()) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True))
            rows = [_row(i, words if change is None else change(words, i), least, times) for i, words in split]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(task, COLUMNS)


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """`docs` with every text that holds a run replaced by its words without repeats, joined
    by one space; texts without runs and all other columns stay as they are."""

    def task(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words, known = (text or "").encode().split(), _Numbers()
                found = runs(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), least, times)
                out.append(b" ".join(collapsed(words, found)).decode() if found else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(task, docs.withColumn("text", F.col("text").cast("string")).schema)
