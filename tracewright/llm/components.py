"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join.

Nothing is collected but one number a round: how many nodes keep the links from being stars. The round that would only find nothing to do is
not run. A node with very many links meets its minimum in a join that Spark may split, since both sides are exchanges of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links both ways, and a row a node: its least neighbour or itself, and how many smaller ones and how many in all it has."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    each = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count("*").alias("n"))
    return both, materialize(each, "neighbours")


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of longs to rows ``(node, root)`` of every linked node but the roots; root is the component's
    smallest node. Self-links and nulls count for nothing; no links give no rows."""
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(oriented, "links")
    while True:
        both, nodes = _neighbours(now)
        if not nodes.where("below > 1 or (below = 1 and n > 1)").count():  # stars alone: every node has no smaller neighbour, or that one only
            discard(nodes)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = materialize(both.join(nodes.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")  # a row a link
        after = _small_star(large)
        discard(now, nodes, large)
        now = after
