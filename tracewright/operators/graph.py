"""Graphs as edge tables: neighbours, degrees and breadth-first search with a defined visiting order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table
from ..storage import written
from .ordered import prefix_sums


def build(edges: DataFrame, directed: bool = True, node_count: int | None = None) -> DataFrame:
    """Distinct (src, dst); undirected graphs get each edge both ways, self-loops once. Nodes outside 0..node_count - 1 raise."""
    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if node_count is not None:
        bad = (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= node_count)
        pairs = pairs.withColumn("src", F.when(bad, F.raise_error(F.lit("node out of range")).cast("long")).otherwise(F.col("src")))
    if not directed:
        pairs = pairs.unionByName(pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.distinct()


def neighbours(graph: DataFrame, node: int) -> DataFrame:
    return graph.where(F.col("src") == node).select("dst").orderBy("dst")


def bfs(graph: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """Rows (node, depth, visit_rank): level by level, within a level by the parent's rank, then by node.

    A level is one join of the frontier with the edges, a grouped minimum and an anti-join; each is written to the shared folder, so that
    lineage stays short. Ranks within a level come from counts a parent, added up by ranges of the parents' ranks, so no task sees a
    whole level unless it is the children of one parent."""
    spark = graph.sparkSession
    levels = [spark.createDataFrame([(start, 0, 0)], "node long, depth int, visit_rank long")]
    depth, seen = 0, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier, visited = levels[-1], reduce(DataFrame.unionByName, levels)
        met = frontier.join(graph, frontier["node"] == graph["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("visit_rank").alias("parent"))
        new = met.join(visited.select("node"), "node", "left_anti")
        before = prefix_sums(new.groupBy("parent").agg(F.count("*").alias("_n")), "parent", "_n", "_before")
        within = F.row_number().over(W.partitionBy("parent").orderBy("node")) - 1
        level = new.join(before.select("parent", "_before"), "parent").select("node", F.lit(depth).alias("depth"), (F.col("_before") + within + seen).cast("long").alias("visit_rank"))
        levels.append(written(level, "level"))
        found = levels[-1].count()
        if not found:
            break
        seen += found
    return reduce(DataFrame.unionByName, levels)


def _supply(spark, sf_dir) -> DataFrame:
    """Suppliers 0.., parts after them."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


_EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem"
_BOTH = f"e AS ({_EDGES}), g AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("graph_neighbors", f"SELECT dst FROM ({_EDGES}) WHERE src = 3")
def _neighbours(spark, sf_dir):
    return neighbours(build(_supply(spark, sf_dir)), 3)


@query("graph_degrees", f"WITH {_BOTH} SELECT src AS node, count(*) AS degree FROM g GROUP BY 1")
def _degrees(spark, sf_dir):
    return build(_supply(spark, sf_dir), directed=False).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


@query(
    "bfs_depth",
    "WITH RECURSIVE e AS (SELECT n_regionkey AS src, 100 + n_nationkey AS dst FROM nation UNION SELECT 100 + c_nationkey, 1000 + c_custkey FROM customer "
    "UNION SELECT 100 + s_nationkey, 100000000 + s_suppkey FROM supplier), r(node, depth) AS (SELECT 1, 0 UNION ALL SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3) "
    "SELECT node::BIGINT AS node, min(depth)::INT AS depth FROM r GROUP BY 1",
)
def _bfs_depth(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as bigint) AS src", "cast(100 + n_nationkey as bigint) AS dst")
    edges = edges.unionByName(table(spark, sf_dir, "customer").selectExpr("cast(100 + c_nationkey as bigint) AS src", "1000 + c_custkey AS dst"))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").selectExpr("cast(100 + s_nationkey as bigint) AS src", "100000000 + s_suppkey AS dst"))
    return bfs(build(edges), 1, 3).select("node", "depth")


@query("bfs_visit_order")
def _bfs_order(spark, sf_dir):
    return bfs(build(_supply(spark, sf_dir), directed=False), 0)
