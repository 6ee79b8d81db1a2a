"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, fresh_path, materialize


#: A node with more edges than this is a hub; at most HUBS nodes are, however many edges there are.
HUB_EDGES, HUBS = 256, 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, own: bool, most: int) -> DataFrame:
    """(u, v, m) with m the least neighbour of u, or u itself if that is less and `own`.

    The edges of a hub stay where they are and get its value by broadcast (`most`
    bounds the hubs), so that no key of the shuffled join has more than `most` rows.
    """
    least = F.least(F.min("v"), F.first("u")) if own else F.min("v")
    least = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    few = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionByName(few.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs.

    The component is its smallest node.  Self loops are allowed; an empty table
    gives an empty result.  Each round is two aggregations (with map-side
    combining) and two joins in which the edges of hubs aren't shuffled; rounds
    grow with the logarithm of the longest chain.  Each is written to the shared
    folder, and the one before it is deleted.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges", path)
    state = _state(edges)
    while state[0]:
        most = max(HUB_EDGES, 2 * state[0] // HUBS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_with_least(both, True, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", one := fresh_path(spark, "large"))
        joined = _with_least(large, False, most)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u > v").distinct(), "edges", two := fresh_path(spark, "edges"))
        new = _state(edges)
        discard(spark, path)
        discard(spark, one)
        path = two
        if new == state:
            break
        state = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning(n: int, left, right) -> list[tuple[int, int]]:
    """Of links between positions under n, those that join two trees (union-find)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left, right, strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
