"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of every node on the least node around it, itself included. edges: a > b, as in the result."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    hung = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return hung.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs every node and its smaller neighbours on the least of these. edges: a > b, as in the result."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b) of longs; component is the least node reachable.

    Loops and repeated edges make no difference; an empty table gives an empty
    one. Edges with a null end are ignored. Each star hands on a reliable
    checkpoint: the next reads it several times, and a plan of two stars would
    hold the first as often. Rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        now = checkpointed(_small_star(checkpointed(_large_star(now))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
