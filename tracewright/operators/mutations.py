"""Insert, update, delete and upsert as plans over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, table
from .access import positions


def insert(records: DataFrame, new: DataFrame, slot: str, high_water: int, order: str) -> DataFrame:
    """Append ``new``; slot ids go on from ``high_water``, the largest ever given, so a deleted slot is never reused.

    New rows are numbered by ``order``, a whole number, a range of it at a time."""
    numbered = positions(new.withColumn("_o", F.col(order).cast("long")), "_o", name="_p").withColumn(slot, F.col("_p") + 1 + F.lit(high_water))
    return records.unionByName(numbered.select(*records.columns))


def update(records: DataFrame, changes: DataFrame, slot: str) -> DataFrame:
    """Replace the named columns of the records whose slot is in ``changes`` (one row a slot); slots are kept."""
    changed = [c for c in changes.columns if c != slot]
    new = changes.select(slot, F.struct(*changed).alias("_new"))
    joined = records.join(new, slot, "left")
    return joined.select(*[(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in records.columns])


def delete(records: DataFrame, slots: DataFrame, slot: str) -> DataFrame:
    """Drop the records whose slot is listed."""
    return records.join(slots.select(slot), slot, "left_anti")


def upsert(records: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row a key: the one with the largest sequence number of records (at 0) and changes."""
    both = records.withColumn(sequence, F.lit(0).cast("long")).unionByName(changes)
    latest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), sequence).alias("_w"))
    return latest.select("_w.*").drop(sequence)


def replay(log: DataFrame, slot: str, sequence: str, kind: str) -> DataFrame:
    """Live rows of a log of inserts, updates and deletes: the last entry a slot wins, unless it is a delete."""
    last = log.groupBy(slot).agg(F.max_by(F.struct(*log.columns), sequence).alias("_w")).select("_w.*")
    return last.where(F.col(kind) != "delete").drop(sequence, kind)


def exclusive(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one of two snapshots and not the other, by multiplicity; empty if the snapshots are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


@query(
    "mutation_insert",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
)
def _insert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"))
    return insert(orders, new, "o_orderkey", orders.agg(F.max("o_orderkey")).first()[0] or 0, "o_custkey")


@query(
    "mutation_update",
    "SELECT o_orderkey, o_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice "
    "FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def _update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    changes = orders.join(building, "o_custkey").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return update(orders, changes, "o_orderkey")


@query("mutation_delete", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _delete(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return delete(table(spark, sf_dir, "orders"), returned, "o_orderkey")


@query(
    "mutation_upsert",
    "WITH c AS (SELECT o_custkey AS c_custkey, 'spent ' || o_orderstatus AS tag, o_orderkey + 1 AS seq FROM orders), "
    "b AS (SELECT c_custkey, c_mktsegment AS tag, 0 AS seq FROM customer UNION ALL SELECT * FROM c) "
    "SELECT c_custkey, tag FROM b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1",
)
def _upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("spent "), "o_orderstatus").alias("tag"), (F.col("o_orderkey") + 1).alias("seq"))
    return upsert(base, changes, "c_custkey", "seq")


_LOG = {"signup": "insert", "view": "update", "click": "update", "purchase": "update", "error": "delete"}


@query(
    "mutation_replay",
    "SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'",
)
def _replay(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _LOG.items()])
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "value", kind.alias("kind"))
    return replay(log, "user_id", "event_id", "kind")


@query("snapshot_difference", "SELECT o_orderkey, o_custkey, 'left' AS side FROM orders WHERE o_orderstatus = 'F'")
def _difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return exclusive(orders.select("o_orderkey", "o_custkey"), orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey"))
