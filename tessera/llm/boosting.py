"""Gradient-boosted trees over counted patterns of small integer features.

Spark counts how often each combination of feature values occurs and how many of
those are positive; the table is bounded by the product of the features' levels.
Trees are fitted to it on the driver and applied as a SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pattern = tuple[tuple[int, ...], float, float]  # features, rows, positive rows


def _leaf(rows: list[tuple[tuple[int, ...], float, float]], ridge: float) -> float:
    return sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + ridge)


def _grow(rows, depth: int, ridge: float, nominal: frozenset[int]):
    """A tree of (feature, value, equal?, yes, no) nodes and leaf weights, by exact gain."""
    total_g, total_h = sum(g for _, g, _ in rows), sum(h for _, _, h in rows)
    best = None
    for f in range(len(rows[0][0])) if depth else ():
        sums: dict[int, list[float]] = {}
        for x, g, h in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g_yes = h_yes = 0.0
        for v in sorted(sums)[: None if f in nominal else -1]:
            g_yes, h_yes = (sums[v][0], sums[v][1]) if f in nominal else (g_yes + sums[v][0], h_yes + sums[v][1])
            gain = g_yes**2 / (h_yes + ridge) + (total_g - g_yes) ** 2 / (total_h - h_yes + ridge)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, v)
    if best is None or best[0] <= total_g**2 / (total_h + ridge) + 1e-9:
        return _leaf(rows, ridge)
    _, f, v = best
    goes = (lambda x: x[f] == v) if f in nominal else (lambda x: x[f] <= v)
    yes, no = [r for r in rows if goes(r[0])], [r for r in rows if not goes(r[0])]
    if not yes or not no:
        return _leaf(rows, ridge)
    return f, v, f in nominal, _grow(yes, depth - 1, ridge, nominal), _grow(no, depth - 1, ridge, nominal)


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        f, v, equal, yes, no = tree
        tree = yes if (x[f] == v if equal else x[f] <= v) else no
    return tree


def fit(patterns: list[Pattern], rounds: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, nominal: frozenset[int] = frozenset()) -> tuple[float, list]:
    """(base log-odds, trees) by Newton boosting of the logistic loss."""
    n, p = sum(w for _, w, _ in patterns), sum(w for _, _, w in patterns)
    base = math.log((p + 1) / (n - p + 1))
    odds, trees = [base] * len(patterns), []
    for _ in range(rounds if patterns else 0):
        prob = [1 / (1 + math.exp(-max(-40.0, min(40.0, o)))) for o in odds]
        rows = [(x, pos - w * q, w * q * (1 - q)) for (x, w, pos), q in zip(patterns, prob, strict=True)]
        tree = _grow(rows, depth, ridge, nominal)
        trees.append(tree)
        odds = [o + rate * max(-4.0, min(4.0, _value(tree, x))) for o, (x, _, _) in zip(odds, patterns, strict=True)]
    return base, trees


def predict(model: tuple[float, list], x: tuple[int, ...], rate: float = 0.4) -> float:
    odds = model[0] + sum(rate * max(-4.0, min(4.0, _value(t, x))) for t in model[1])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def expression(model: tuple[float, list], features: list[Column], rate: float = 0.4) -> Column:
    """The probability of the positive class as a SQL expression."""

    def build(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(rate * max(-4.0, min(4.0, tree)))
        f, v, equal, yes, no = tree
        return F.when(features[f] == v if equal else features[f] <= v, build(yes)).otherwise(build(no))

    odds = F.lit(model[0])
    for tree in model[1]:
        odds = odds + build(tree)
    return 1 / (1 + F.exp(-odds))


def threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """The least score at which all rows scoring as much are positive in at least that share;
    above 1 if there is none.  scored: (score, rows, positive rows)."""
    n = p = 0.0
    best = 2.0
    for i, (score, rows, positive) in enumerate(ordered := sorted(scored, reverse=True)):
        n, p = n + rows, p + positive
        if (i + 1 == len(ordered) or ordered[i + 1][0] < score) and p >= precision * n:
            best = score
    return best
