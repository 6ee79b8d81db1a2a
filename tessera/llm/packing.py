"""Order-preserving packing by dynamic programming with a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions
from .tokens import default_path, encoder

#: Costs in tokens of padding: of cutting at a sentence end, elsewhere, and of each window.
SENTENCE, ANYWHERE, EACH = 4, 64, 8
BLOCK = 1 << 18  # tokens planned at once
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(ends: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut in a run of tokens, and the penalty of each cut.

    `ends`: token counts before and including each document; `sentence`: marks
    tokens that end a sentence.  Stretches without either get cuts at every size / 4.
    """
    total = int(ends[-1])
    penalty = np.full(total + 1, -1, np.int64)
    penalty[np.flatnonzero(sentence) + 1] = SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    step = max(1, size // 4)
    for a, b in zip(at[:-1][np.diff(at) > step], at[1:][np.diff(at) > step], strict=True):
        penalty[a + step : b : step] = ANYWHERE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices into `at` of the cuts, first and last included, of least cost.

    A window of length L costs EACH plus its padding: size - L, or nothing when
    L is a power of two (windows under size / 16 aren't considered for that).
    cost[k] = penalty[k] + EACH + size - at[k] + the least
    cost[j] + at[j] over j within `size` before k: the queue holds the candidates
    for that least value in increasing order, so each enters and leaves once.
    """
    n = len(at)
    where = at.tolist()
    penalties = penalty.tolist()
    short: dict[int, list[int]] = {}
    p = max(1, size // 16)
    while p < size:
        found = np.searchsorted(at, at - p)
        hit = np.flatnonzero((at >= p) & (at[np.minimum(found, n - 1)] == at - p))
        for k, j in zip(hit.tolist(), found[hit].tolist(), strict=True):
            short.setdefault(k, []).append(j)
        p *= 2
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(where[0], 0)])
    for k in range(1, n):
        x = where[k]
        while where[queue[0][1]] < x - size:
            queue.popleft()
        least, j = queue[0]
        best = least + size - x
        for i in short.get(k, ()):
            if cost[i] < best:
                best, j = cost[i], i
        cost[k], back[k] = best + EACH + penalties[k], j
        c = cost[k] + x
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, k))
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Packs documents as they come; keeps only the tokens that aren't placed yet."""

    def __init__(self, size: int, ends_sentence: np.ndarray, first: int):
        self.size, self.ends_sentence, self.sequence = size, ends_sentence, first
        self.docs: list[list] = []  # [doc_id, its ids not placed yet, how many were placed, all its ids' number]
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.waiting += len(ids)
        return self.place(False) if self.waiting >= BLOCK else []

    def place(self, final: bool) -> list[tuple]:
        """The pieces of the best windows; unless `final`, the last windows are
        left open and planned again with what follows."""
        if not self.docs:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        at, penalty = cut_points(ends, self.ends_sentence[ids], self.size)
        cuts = [int(at[k]) for k in best_cuts(at, penalty, self.size)]
        if not final:
            cuts = [c for c in cuts if c <= len(ids) - 8 * self.size]
        out, doc, begin = [], 0, 0
        for first, b in zip(cuts[:-1], cuts[1:], strict=True):
            a = first
            while a < b:
                doc_id, own, placed, total = self.docs[doc]
                take = min(b, int(ends[doc])) - a
                from_ = a - begin
                out.append((doc_id, placed + from_, take, zlib.crc32(own[from_ : from_ + take].tobytes()), total, self.sequence, a - first))
                a += take
                if a == ends[doc]:
                    begin, doc = int(ends[doc]), doc + 1
            self.sequence += 1
        used = cuts[-1] - begin if cuts else 0
        self.docs = self.docs[doc:]
        if used and self.docs:
            self.docs[0][1] = self.docs[0][1][used:]
            self.docs[0][2] += used
        self.waiting = len(ids) - (cuts[-1] if cuts else 0)
        return out


def _task(size: int, path: str):
    def task(batches):
        tokenizer = encoder(path)
        packer = Packer(size, tokenizer.ends_sentence(), TaskContext.get().partitionId() << 36)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += packer.add(doc_id, tokenizer.with_end(text))
            yield _batch(rows)
        yield _batch(packer.place(True))

    return task


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in COLUMNS.split(", ")])


def pack(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text) in sequences of at most `size` tokens.

    Documents follow each other by doc_id; each is its token ids and the end id
    0.  Windows are cut at document or sentence ends so that padding plus cut
    penalties are least among these cuts; only where neither comes within a quarter
    of a window are cuts elsewhere considered, at every quarter, and of windows that
    need no padding because their length is a power of two only those of at least
    size / 16.  Null and empty texts are their end id alone;
    repeated rows are separate documents; a null doc_id comes first.

    Ranges of doc_id are packed independently, each in one streaming task that
    holds about BLOCK tokens; a range wastes at most one window.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(_task(size, path or default_path()), COLUMNS)
