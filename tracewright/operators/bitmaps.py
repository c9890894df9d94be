"""Posting sets as Spark bitmaps: built in each task, merged by bucket, so a posting's size never meets one row limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, table

CONTAINER = 1 << 16
DENSE = 4096


def postings(rows: DataFrame, category: str, ids: str) -> DataFrame:
    """Rows (category, bucket, bitmap)."""
    keyed = rows.where(F.col(ids).isNotNull()).select(category, F.bitmap_bucket_number(ids).alias("bucket"), F.bitmap_bit_position(ids).alias("_p"))
    return keyed.groupBy(category, "bucket").agg(F.bitmap_construct_agg("_p").alias("bitmap"))


def cardinality(posted: DataFrame, category: str) -> DataFrame:
    return posted.groupBy(category).agg(F.sum(F.bitmap_count("bitmap")).alias("cardinality"))


def union(posted: DataFrame) -> DataFrame:
    """One bitmap a bucket: ids in any posting."""
    return posted.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersection(posted: DataFrame, category: str) -> DataFrame:
    """One bitmap a bucket: ids in every posting. A bucket that some posting lacks has none."""
    all_ = posted.select(category).distinct().agg(F.count("*").alias("_all"))
    met = posted.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_met"))
    return met.join(F.broadcast(all_), F.col("_met") == F.col("_all")).select("bucket", "bitmap")  # one row


def materialise(bitmaps: DataFrame, name: str = "id") -> DataFrame:
    """The ids of bitmaps: only bytes that are set are unfolded."""
    size = 32768
    byte = F.expr("filter(transform(sequence(0, octet_length(bitmap) - 1), i -> struct(i, conv(hex(substring(bitmap, i + 1, 1)), 16, 10) AS v)), x -> x.v <> '0')")
    bits = bitmaps.select("bucket", F.explode(byte).alias("b")).select("bucket", "b.i", F.col("b.v").cast("int").alias("v"))
    each = bits.select("bucket", "i", F.explode(F.expr("filter(sequence(0, 7), k -> (v & shiftleft(1, k)) <> 0)")).alias("k"), "v")
    bit = F.col("i") * 8 + F.col("k")  # Spark puts 1..32768 into bucket 1, and 0 and below into buckets from 0 down
    return each.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * size + bit + 1).otherwise(F.col("bucket") * size - bit).cast("long").alias(name))


def containers(rows: DataFrame, category: str, ids: str) -> DataFrame:
    """How many containers of 65,536 ids each posting has, and how many are dense (4,096 distinct ids or more)."""
    per = rows.select(category, ids).distinct().groupBy(category, F.floor(F.col(ids) / CONTAINER).alias("_c")).agg(F.count("*").alias("_n"))
    return per.groupBy(category).agg(F.count("*").alias("containers"), F.count_if(F.col("_n") >= DENSE).alias("dense_containers"), F.sum("_n").alias("ids"))


@query("bitmap_cardinality", "SELECT event_type, count(DISTINCT user_id) AS cardinality FROM events GROUP BY 1")
def _cardinality(spark, sf_dir):
    return cardinality(postings(table(spark, sf_dir, "events"), "event_type", "user_id"), "event_type")


@query("bitmap_union", "SELECT count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS total FROM orders")
def _union(spark, sf_dir):
    ids = materialise(union(postings(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")))
    return ids.agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query(
    "bitmap_intersect",
    "SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
)
def _intersect(spark, sf_dir):
    return materialise(intersection(postings(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey"), "o_orderpriority"))


@query(
    "bitmap_containers",
    "SELECT l_returnflag, count(*) AS containers, count(*) FILTER (n >= 4096) AS dense_containers, sum(n)::BIGINT AS ids FROM "
    "(SELECT l_returnflag, l_orderkey // 65536 AS c, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _containers(spark, sf_dir):
    return containers(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")
