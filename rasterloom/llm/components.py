"""Connected components by alternating star contraction, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.storage import discard, written

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node it sees (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them. Edges run from larger a to smaller b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge in `edges` (a, b); component is its smallest reachable node.

    O(log n) rounds of joins on the edge list; a round writes its edges to the shared folder, so lineage
    stays short and a lost executor costs one round. Loops and repeated edges are dropped.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        stat = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(stat) == mark or stat["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        mark = tuple(stat)
        last, now = now, written(_small_star(_large_star(now)))
        discard(last)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
