"""Linear-time suffix sorting by groups of Lyndon prefixes.

First suffixes are grouped by their longest Lyndon prefix: groups, at first one for each
symbol, are taken in descending order; a member points to the last position before it
whose suffix lies in a lower group, and what is pointed at equally often from one group
moves on, together, to a group just above its own.  Then positions are put into their
groups' places in one pass over the growing array, along the same pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in order; a suffix comes before those that it begins."""
    size = len(symbols)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols, 1):  # places count from 1: 0 stands for "none before"
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    live, above, group = [len(m) for m in members], list(range(1, len(members) + 1)), [-1] * (size + 1)
    below = list(range(-1, len(members) - 1))
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    if not size:
        return []
    lowest, top, previous = 0, len(members) - 1, [-1] * (size + 1)
    above[top] = -1

    g = top
    while g >= 0:
        counts: dict[int, int] = {}
        for i in members[g]:
            if group[i] == g:
                j = i - 1
                while (k := previous[j]) >= 0:
                    j = k
                previous[i] = j
                counts[j] = counts.get(j, 0) + 1
        counts.pop(0, None)
        moved: dict[int, dict[int, list[int]]] = {}
        for p, n in counts.items():
            if live[h := group[p]] > 1:
                moved.setdefault(h, {}).setdefault(n, []).append(p)
        for h, sets in moved.items():
            at, left = h, live[h] - sum(map(len, sets.values()))
            for n in sorted(sets)[0 if left else 1 :]:  # the least set may stay if nothing else does
                new = len(members)
                for p in sets[n]:
                    group[p] = new
                live[h] -= len(sets[n])
                members.append(sets[n])
                live.append(len(sets[n]))
                above.append(above[at])
                below.append(at)
                below[above[at]] = new
                above[at] = new
                at = new
        g = below[g]

    slot, g, at = [0] * len(members), lowest, 0
    while g >= 0:
        slot[g] = at
        at += live[g]
        g = above[g]
    out = [0] * size
    for i in range(-1, size):
        j = size if i < 0 else out[i] - 1
        while j and (g := group[j]) >= 0:
            out[slot[g]] = j
            slot[g] += 1
            group[j] = -1
            j = previous[j]
    return [i - 1 for i in out]


def neighbour_lcps(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, how many symbols its suffix shares with the one before or
    after it in the suffix array, whichever is more."""
    size = len(symbols)
    padded = np.concatenate([symbols, [-1]])
    a, b = order[:-1].copy(), order[1:].copy()
    shared, active = np.zeros(max(0, size - 1), np.int64), np.arange(max(0, size - 1))
    while len(active):
        same = (padded[np.minimum(a, size)] == padded[np.minimum(b, size)]) & (a < size) & (b < size)
        a, b, active = a[same] + 1, b[same] + 1, active[same]
        shared[active] += 1
    best = np.zeros(size, np.int64)
    best[order[1:]] = shared
    best[order[:-1]] = np.maximum(best[order[:-1]], shared)
    return best
