"""Groups of similar sets from buckets of candidates, losing no link and without all pairs of a dense group.

Two nodes that share a bucket are candidates; a link is a pair of candidates
whose sets have a Jaccard likeness of at least `threshold`. First every node is
held against one node of its buckets, then against one node of each
group found so far, and at last every two candidates of different groups against
each other. A dense group falls together in the first round, which takes no more
pairs than rows; pairs inside a group are never looked at again. Members can say
where they may stand in a bucket: then unlike texts are no candidates merely
because they share something that is frequent (see fits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed
from tessera.llm.components import components


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float, plausible: Callable[[str, str], Column] | None, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those pairs (a, b) that are links. nodes: (node, n, ...), n the size of the set; sets: from a frame of nodes to (node, set)."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select([F.col(c).alias(f"{end}_{c}" if c != "node" else end) for c in nodes.columns]), end)
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    likely = pairs.where(low >= high * threshold)
    if plausible is not None:
        likely = likely.where(plausible("a_", "b_"))
    likely = checkpointed(likely.select("a", "b"))
    have = sets(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    joined = likely.join(have.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a").join(have.select(F.col("node").alias("b"), F.col("set").alias("b_set")), "b")
    return checkpointed(joined.where(jaccard(F.col("a_set"), F.col("b_set")) >= threshold).select("a", "b"))


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    joined = members.join(groups.withColumnRenamed("component", "label"), "node", "left")
    return checkpointed(joined.select(*members.columns, F.coalesce("label", "node").alias("label")))


#: What a member of a bucket says of itself to `fits`: the size of its set, the largest size of the other's, and whether it may be the smaller one here.
SAYS = ("n", "most", "own")


def fits(a: str, b: str, threshold: float) -> Column:
    """Of two members of a bucket (columns n, most, own and node): whether a is the smaller one (of equal sizes the lesser node), may be so in this bucket, and both take the other's size."""
    c = lambda x, name: F.col(x + name)
    smaller = (c(a, "n") < c(b, "n")) | (c(a, "n") == c(b, "n")) & (c(a, "node") < c(b, "node"))
    return smaller & c(a, "own") & (c(b, "n") <= c(a, "most")) & (c(a, "n") <= c(b, "most")) & (c(a, "n") >= c(b, "n") * threshold - 1e-6)


def linked(
    members: DataFrame,
    nodes: DataFrame,
    threshold: float,
    sets: Callable[[DataFrame], DataFrame],
    plausible: Callable[[str, str], Column] | None = None,
    hints: DataFrame | None = None,
) -> DataFrame:
    """(node, component) for every node that has a link. members: (bucket, node); see _verified for the rest.

    If members also have the columns SAYS, only those two are candidates of which one fits the other in a bucket.
    hints: more (bucket, node) for the first turn, of which no link depends.
    """
    groups = members.sparkSession.createDataFrame([], "node long, component long")
    says = [c for c in SAYS if c in members.columns]
    # The text with the least of its own before what it shares with others is alike to most of them.
    first = F.struct(*([(F.col("most") / F.greatest("n", F.lit(1))).alias("good")] if says else []), (-F.col("node")).alias("least"), "node", *says)
    mark = lambda df, x: df.select(*[F.col(c).alias(c if c == "bucket" else x + c) for c in df.columns])
    either = fits("a_", "b_", threshold) | fits("b_", "a_", threshold) if says else F.lit(True)
    now = members
    for turn in range(3):
        if turn == 0:
            lead = lambda df, at: mark(df, "b_").join(mark(df.groupBy("bucket").agg(F.max(at).alias("m")).select("bucket", "m.*"), "a_"), "bucket")
            # One pair for each node: the least leader of all its buckets.
            one = lambda df: lead(df.select("bucket", "node"), F.struct((-F.col("node")).alias("least"), "node")).groupBy("b_node").agg(F.min("a_node").alias("a_node"))
            pairs = lead(members, first).where(either).select("b_node", "a_node") if says else one(members)
            pairs = (pairs if hints is None else pairs.union(one(hints))).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        else:
            several = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
            open_ = now.join(several, "bucket", "left_semi")
            if turn == 1:
                least = open_.groupBy("bucket", "label").agg(F.max(first).alias("m")).select("bucket", "label", "m.*")
                fit = either
                pairs = mark(open_, "b_").join(mark(least, "a_"), "bucket")
            else:
                fit = fits("a_", "b_", threshold) if says else F.col("a_node") < F.col("b_node")
                pairs = mark(open_, "b_").join(mark(open_.where("own") if says else open_, "a_"), "bucket")
            pairs = pairs.where((F.col("a_label") != F.col("b_label")) & fit).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        # A group so far is handed on as links to its least node: earlier links say no more.
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(known.union(_verified(pairs, nodes, threshold, plausible, sets)))
        if turn < 2:
            now = _labelled(members, groups)
    return groups
