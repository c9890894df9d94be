"""Running counts and exact quantiles of groups of any size: values are cut into ranges, so no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64  # ranges of a group's values
WIDTH = 1 << 16


def same(columns: list[str], other: str = "_k") -> Column:
    """Equality of each column with ``other`` and its number, nulls equal."""
    out = F.lit(True)
    for i, c in enumerate(columns):
        out &= F.col(c).eqNullSafe(F.col(f"{other}{i}"))
    return out


def _keyed(df: DataFrame, by: list[str], *columns) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *columns)


def ordered_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows (by, value, c, before): how many rows of the group have each value, and how many have a smaller one. Nulls count for nothing.

    A group's distinct values are cut at approximate quantiles; counts before a range are added to running counts within it."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    bounds = _keyed(counts.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_q")), by, "_q")
    ranged = counts.join(bounds, same(by)).withColumn("_r", F.size(F.filter("_q", lambda x: x < F.col(value)))).select(*by, value, "c", "_r")
    sums = ranged.groupBy(*by, "_r").agg(F.sum("c").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # RANGES rows
    starts = _keyed(sums.withColumn("_b", start), by, F.col("_r").alias("_kr"), "_b")
    within = F.coalesce(F.sum("c").over(W.partitionBy(*by, "_r").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(starts, same(by) & (F.col("_r") == F.col("_kr"))).withColumn("before", F.col("_b") + within).select(*by, value, "c", "before")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Rows (by, one column a share): linearly interpolated quantiles; a group without values has no row."""
    counted = ordered_counts(rows, by, value)
    n = _keyed(counted.groupBy(*by).agg(F.sum("c").alias("_n")), by, "_n")
    met = counted.join(n, same(by))
    picks = []
    for i, p in enumerate(shares.values()):
        at = F.lit(p) * (F.col("_n") - 1)
        for name, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            picks.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col(value))).alias(f"_{name}{i}"))
    out = met.groupBy(*by, "_n").agg(*picks)
    share = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    return out.select(*by, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * share(p)).alias(name) for i, (name, p) in enumerate(shares.items())])


def with_median(aggregated: DataFrame, rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Add the exact median of each group to a table with a row a group; null without values."""
    found = _keyed(quantiles(rows, by, value, {"_median": 0.5}), by, F.col("_median").alias(name))
    return aggregated.join(found, same(by), "left").drop(*[f"_k{i}" for i in range(len(by))])


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Add 1-based ranks in the group; ties share their mean rank, nulls have none."""
    counted = ordered_counts(rows, by, value)
    ranks = _keyed(counted, by, F.col(value).alias("_v"), (F.col("before") + (F.col("c") + 1) / 2).alias(name))
    return rows.join(ranks, same(by) & (F.col(value) == F.col("_v")), "left").drop("_v", *[f"_k{i}" for i in range(len(by))])


def prefix_sums(rows: DataFrame, order: str, amount: str, name: str = "before") -> DataFrame:
    """Add the sum of ``amount`` over the rows with a smaller ``order`` (a whole number, once each), ``WIDTH`` numbers a range."""
    ranged = rows.withColumn("_r", F.floor(F.col(order) / WIDTH))
    sums = ranged.groupBy("_r").agg(F.sum(amount).alias("_n"))
    start = sums.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    within = F.coalesce(F.sum(amount).over(W.partitionBy("_r").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(start, "_r").withColumn(name, (F.col("_b") + within).cast("long")).drop("_r", "_b")
