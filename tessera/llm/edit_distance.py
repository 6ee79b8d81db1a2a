"""Segments of the partition scheme, and banded bit-parallel edit distance of many pairs at once."""

from __future__ import annotations

import numpy as np


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of `parts` segments of a line, as even as can be, the longer ones last."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def allowed(length: int, edits: int, per: int) -> int:
    """Edits allowed when the shorter line has `length` characters: one for each `per`, `edits` at most."""
    return min(edits, length // per)


def probes(length: int, edits: int, per: int = 1) -> list[tuple[int, int, int, int]]:
    """(other length, segment, start, size) of the substrings of a line of `length` that a
    partner no longer than it, within the allowed edits k, can have as its segment.

    A line is cut into k + 1 segments.  If two lines are within k edits, some segment
    of the shorter one matches at a place that both a count of edits from the left
    and one from the right allow.
    """
    out = []
    for other in range(max(1, length - edits), length + 1):
        k, shift = allowed(other, edits, per), length - other
        if not shift <= k < other or not k:
            continue
        for i, (start, size) in enumerate(segments(other, k + 1)):
            low = max(0, start - i, start + shift - (k - i))
            high = min(length - size, start + i, start + shift + (k - i))
            out += [(other, i, at, size) for at in range(low, high + 1)]
    return out


def rest_pieces(length: int, start: int, size: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 pieces of a line outside of one segment: of lines within k
    edits that share the segment, one piece at least is whole in both."""
    right = length - start - size
    left_parts = min(start, max(k + 1 - right, round((k + 1) * start / (start + right))))
    out = segments(start, left_parts) if left_parts else []
    if k + 1 > left_parts:
        out += [(start + size + at, n) for at, n in segments(right, k + 1 - left_parts)]
    return out


def rest_probes(length: int, other: int, start: int, size: int, at: int, k: int) -> list[tuple[int, int, int]]:
    """(piece, start, size) of the substrings of a line of `length` that a partner of length
    `other` can have as its rest_pieces, when the partner's segment (start, size) is at `at` here."""
    out, shift, total = [], at - start, length - other
    for j, (begin, n) in enumerate(rest_pieces(other, start, size, k)):
        near, low, high = (0, 0, at - n) if begin < start else (total, at + size, length - n)
        for d in range(max(shift, near) - k, min(shift, near) + k + 1):
            if low <= begin + d <= high:
                out.append((j, begin + d, n))
    return out


LONG = 512  # characters from which the common start and end of two lines are cut off first


def _trimmed(a: str, b: str, edits: int) -> tuple[str, str]:
    """The lines without their common start and end, which no edit needs, but for a few characters."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    differs = np.flatnonzero(x[:n] != y[:n])
    start = max(0, (int(differs[0]) if len(differs) else n) - edits - 1)
    x, y, n = x[start:], y[start:], n - start
    differs = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    end = max(0, min(n - edits - 1, int(differs[0]) if len(differs) else n))
    return a[start : len(a) - end], b[start : len(b) - end]


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distance of each pair, or edits + 1 when it is larger; lines of at least edits + 1 characters each.

    A column of the edit table is a word of vertical differences around the
    diagonal; all pairs take a step together.  Bit 63 is the row `edits` below
    the diagonal, bits outside the band never match.
    """
    out = np.full(len(pairs), edits + 1, np.int64)
    pairs = [_trimmed(a, b, edits) if len(a) > LONG else (a, b) for a, b in pairs]
    order = sorted(range(len(pairs)), key=lambda p: len(pairs[p][0]) + len(pairs[p][1]))
    at = 0
    while at < len(order):
        longest = max(len(x) for x in pairs[order[at]])
        to = at + 1
        while to < len(order) and to - at < 8192 and (to - at + 1) * (n := max(longest, *map(len, pairs[order[to]]))) < 1 << 22 and n <= longest + 64:
            longest, to = n, to + 1
        some = order[at:to]
        out[some] = _batch([tuple(sorted(pairs[p], key=len, reverse=True)) for p in some], edits)
        at = to
    return out


def _matrix(lines: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((width, len(lines)), pad, np.uint32)
    for k, line in enumerate(lines):
        out[: len(line), k] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _batch(pairs: list[tuple[str, str]], k: int) -> np.ndarray:
    one, two = np.uint64(1), np.uint64
    n1, n2 = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    width = int(n1.max())
    a = np.full((width + 2 * k + 1, len(pairs)), 0xFFFFFFFF, np.uint32)  # row r holds character r - k
    a[k : k + width] = _matrix([x for x, _ in pairs], width, 0xFFFFFFFF)
    b = _matrix([y for _, y in pairs], width, 0xFFFFFFFE)
    up = np.full(len(pairs), (~((1 << (63 - k)) - 1)) & (2**64 - 1), np.uint64)
    down = np.zeros(len(pairs), np.uint64)
    dist = np.full(len(pairs), k, np.int64)
    for i in range(int(n2.max())):
        x = np.zeros(len(pairs), np.uint64)
        for d in range(2 * k + 1):
            x |= (a[i + d] == b[i]).astype(np.uint64) << two(63 - 2 * k + d)
        diagonal = (((x & up) + up) ^ up) | x | down
        plus = down | ~(diagonal | up)
        minus = diagonal & up
        first = i < n1 - k
        shift = np.clip(62 - (i - (n1 - k)), 0, 62).astype(np.uint64)
        along = (~diagonal >> two(63)).astype(np.int64)
        across = ((plus >> shift) & one).astype(np.int64) - ((minus >> shift) & one).astype(np.int64)
        dist += np.where(i < n2, np.where(first, along, across), 0)
        up = minus | ~((diagonal >> one) | plus)
        down = (diagonal >> one) & plus
    dist[n1 - n2 > k] = k + 1
    return np.minimum(dist, k + 1)
