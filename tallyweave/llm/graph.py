"""Connected components of a distributed link table (large-star and small-star rounds)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyweave.sources.scratch import discard, materialise


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of the nodes that are not their own root."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionAll(own).where("a != b").distinct()


def _mark(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(a, b)`` links of longs to ``(node, root)``: root is the least node reachable.

    Nodes that are their own root have no row. Each round is written to the shared
    scratch folder, so neither the lineage nor the driver grows with the graph; the
    rounds grow with the logarithm of the longest path.
    """
    now = materialise(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        before, now = now, materialise(_small_star(_large_star(now)), "links")
        discard(before)
        after = _mark(now)
        if after == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = after
    raise RuntimeError("components did not settle")
