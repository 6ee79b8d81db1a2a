"""Vectorised hashing of words, shingles and substrings over Arrow batches.

All hashes are polynomials over the 64-bit ring (the base is odd, so it has an
inverse and any substring's hash is a difference of two prefix sums), finished
by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Characters of [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
SLICE = 1 << 19  # bytes hashed at once, so that the temporary arrays stay in cache

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k for k < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for i, b in enumerate((BASE, inverse)):
            out = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                out[filled : filled + step] = out[:step] * np.uint64(pow(b, filled, 1 << 64))
                filled += step
            _powers[i] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[0] = 0 and S[i] = sum of values[j] * BASE ** j for j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal contents at any place hash alike."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def text_slices(column: pa.Array):
    """(first row, offsets from 0, bytes) of runs of rows of about SLICE bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (and the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = inner[solid[inner] & solid[inner + 1]]  # a word ends one row and another begins the next
    begins[joined] = True
    ends[joined - 1] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


WINDOW = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes, or of all when there are fewer."""
    n = len(hashes)
    size = min(size, n)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * (WINDOW[k % 5] + np.uint64(2 * (k // 5)))
    return mix(total)


def _pieces(data: np.ndarray):
    """`data` in parts of about SLICE bytes that end at a space; a longer word stays whole."""
    at = 0
    while at < len(data):
        to = at + SLICE
        while to < len(data) and not (found := np.flatnonzero(IS_SPACE[data[to : to + SLICE]])).size:
            to += SLICE
        to = min(len(data), to + int(found[0]) if to < len(data) else to)
        yield data[at:to]
        at = to


def hashed_words(column: pa.Array):
    """For runs of rows: offsets, bytes, hash and byte length of every word, first word of each row.

    A text of more than two slices is a run of its own and is hashed part by part.
    """
    for _, offsets, data in text_slices(column):
        if len(offsets) == 2 and len(data) > 2 * SLICE:
            parts = []
            for piece in _pieces(data):
                start, end, _ = words(np.array([0, len(piece)]), piece)
                parts.append((spans(prefix_sums(piece), start, end), end - start))
            hashes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield offsets, data, hashes, sizes, np.array([0, len(hashes)])
        else:
            start, end, first = words(offsets, data)
            yield offsets, data, spans(prefix_sums(data), start, end), end - start, first


def shingle_sets(column: pa.Array, size: int = 5):
    """The sorted distinct shingle hashes of each row, in order; empty without words."""
    for _, _, hashes, _, first in hashed_words(column):
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(windows(hashes[a:b], size)) if b > a else np.empty(0, np.uint64)
