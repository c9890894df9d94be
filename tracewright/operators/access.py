"""Record access: point, range, equality and prefix lookups over rows with an explicit slot id.

Slot ids order records by insertion. All operators return whole records; filters are plain predicates, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table


def point_lookup(records: DataFrame, key: str, value, slot: str) -> DataFrame:
    """At most one record with ``key == value``: the one with the largest slot id, whatever was updated last."""
    return records.where(F.col(key) == F.lit(value)).orderBy(F.desc(slot)).limit(1)


def point_lookup_all(records: DataFrame, key: str, slot: str) -> DataFrame:
    """The point lookup of every key at once: one shuffle of one partial row a key and task."""
    winner = F.max_by(F.struct(*records.columns), slot).alias("_w")
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(winner).select("_w.*")


def range_scan(records: DataFrame, key: str, low, high, slot: str) -> DataFrame:
    """Records with low <= key <= high, duplicates kept, in (key, slot) order; empty if high < low."""
    return records.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key, slot)


def equality_filter(records: DataFrame, key: str, value, slot: str) -> DataFrame:
    """All records with ``key == value`` by rising slot id."""
    return records.where(F.col(key) == F.lit(value)).orderBy(slot)


def filter_all(postings: DataFrame, category: str, ids: str, first, second) -> DataFrame:
    """Distinct ids posted under both categories; the posting itself if they are the same."""
    left = postings.where(F.col(category) == F.lit(first)).select(ids).distinct()
    right = postings.where(F.col(category) == F.lit(second)).select(ids)
    return left.join(right, ids, "left_semi")


def prefix_search(records: DataFrame, key: str, prefix: str, slot: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` records, in (key, slot) order, whose key starts with ``prefix``; bytes compare unsigned."""
    return records.where(F.col(key).startswith(prefix)).orderBy(key, slot).limit(limit)


def contains(postings: DataFrame, probes: DataFrame, on: list[str]) -> DataFrame:
    """Probes with a flag that tells whether their (category, id) is posted."""
    known = postings.select(*on).distinct().withColumn("_there", F.lit(True))
    return probes.join(known, on, "left").withColumn("contained", F.coalesce("_there", F.lit(False))).drop("_there")


def positions(records: DataFrame, slot: str, width: int = 1 << 16, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Add ``position``: how many live slots (of the same group) come before, without one task that sees all rows. Slots are counted a range of
    ``width`` at a time; the ranges' running sum has a row a range."""
    from pyspark.sql import Window as W

    by = by or []
    ranged = records.withColumn("_r", F.floor(F.col(slot) / width))
    counts = ranged.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*by, "_r").orderBy(slot)) - 1
    return ranged.join(before, [*by, "_r"]).withColumn(name, (F.col("_b") + within).cast("long")).select(*records.columns, name)


def resolve_position(records: DataFrame, slot: str, position: int) -> DataFrame:
    """The record at a position; one that is out of range raises when the result is computed."""
    if position < 0:
        raise IndexError(f"position {position} is out of range")
    found = positions(records, slot).where(F.col("position") == position)
    there = found.agg(F.count("*").alias("_n"), F.first(F.struct(*records.columns)).alias("_w"))
    checked = F.when(F.col("_n") == 0, F.raise_error(F.lit(f"position {position} is out of range")).cast("long")).otherwise(F.col("_n"))
    return there.withColumn("_n", checked).where("_n > 0").select("_w.*")


def summary_of(column: str) -> list[Column]:
    return [F.count("*").alias("n"), F.countDistinct(column).alias("distinct_keys")]


@query(
    "point_lookup_latest",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
)
def _latest(spark, sf_dir):
    return point_lookup_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("point_lookup_one", "SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 1")
def _one(spark, sf_dir):
    return point_lookup(table(spark, sf_dir, "orders"), "o_custkey", 7, "o_orderkey")


@query(
    "range_scan_inclusive",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem "
    "WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-15'",
)
def _range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return rows.where(F.col("l_shipdate").between(day("1997-03-01"), day("1997-04-15"))).orderBy("l_shipdate", "l_orderkey", "l_linenumber")


@query("range_scan_price", "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def _range_price(spark, sf_dir):
    return range_scan(table(spark, sf_dir, "orders"), "o_totalprice", 100000.0, 120000.0, "o_orderkey")


@query("range_scan_inverted", "SELECT * FROM orders WHERE o_totalprice BETWEEN 120000 AND 100000")
def _range_inverted(spark, sf_dir):
    return range_scan(table(spark, sf_dir, "orders"), "o_totalprice", 120000.0, 100000.0, "o_orderkey")


@query("equality_filter", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def _equality(spark, sf_dir):
    return equality_filter(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", "o_orderkey")


@query("filter_all", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def _filter_all(spark, sf_dir):
    return filter_all(table(spark, sf_dir, "events"), "event_type", "user_id", "click", "purchase")


@query("prefix_search", "SELECT * FROM part WHERE starts_with(p_name, 're') ORDER BY p_name, p_partkey LIMIT 100")
def _prefix(spark, sf_dir):
    return prefix_search(table(spark, sf_dir, "part"), "p_name", "re", "p_partkey", 100)


@query("prefix_search_all", "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000') ORDER BY c_name, c_custkey LIMIT 500")
def _prefix_all(spark, sf_dir):
    return prefix_search(table(spark, sf_dir, "customer"), "c_name", "Customer#00000", "c_custkey", 500)


@query(
    "posting_contains",
    "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS contained FROM customer",
)
def _contains(spark, sf_dir):
    postings = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return contains(postings, table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


@query("record_size", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS distinct_keys FROM orders")
def _size(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(*summary_of("o_custkey"))


@query("record_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus <> 'F'")
def _positions(spark, sf_dir):
    return positions(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey")


@query("ordered_items", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice, p_partkey")
def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy("p_retailprice", "p_partkey")
