"""Measured costs from files: calibration profiles (JSON) and benchmark sweeps (CSV). What does not hold together raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields and operations of a sweep file.
SWEEP_FIELDS = {"operation": "string", "cardinality": "bigint", "repetitions": "bigint", "seed": "bigint", "dense_containers": "bigint", "ns_per_op": "double", "result_size": "bigint"}
SWEEP_OPERATIONS = ("contains", "intersection", "materialize", "union")
# The fields of a calibration profile and the states that they default to.
MEASUREMENT = (
    "primitive string, operation string, implementation_id string, access_distribution map<string,string>, ns_per_op double, repetitions long, stdev_ns double, "
    "mean_ns double, median_ns double, min_ns double, max_ns double, samples_ns array<double>"
)
PROFILE = f"profile_id string, seed long, n long, record_count long, protocol string, evidence_state string, measurements array<struct<{MEASUREMENT}>>"
EVIDENCE_STATE = "MEASURED_LOCAL_PROCESS"


def _refuse(rows: DataFrame, what: str) -> None:
    if found := rows.limit(1).collect():
        raise ValueError(f"{what}: {found[0].asDict()}")


def read_sweep(spark: SparkSession, path: str, operations: tuple[str, ...] = SWEEP_OPERATIONS, samples: int | None = None) -> DataFrame:
    """Sweep rows with the types of ``SWEEP_FIELDS``, of one file or many with equal headers.

    Raises unless the header has just these fields, every value is sane, and each cardinality has each operation with the same seeds,
    each seed once, and one number of repetitions an operation; with ``samples`` also that many seeds."""
    header = spark.read.option("header", True).csv(path).columns
    if set(header) != set(SWEEP_FIELDS) or len(header) != len(SWEEP_FIELDS):
        raise ValueError(f"unexpected fields: {header}")
    text = spark.read.schema(", ".join(f"{c} string" for c in header)).options(header=True, enforceSchema=False).csv(path)
    rows = text.select(*[F.expr(f"try_cast({c} AS {kind})").alias(c) for c, kind in SWEEP_FIELDS.items()])
    ns = F.col("ns_per_op")
    sane = F.col("operation").isin(*operations) & (ns >= 0) & ~F.isnan(ns) & (ns < float("inf")) & F.expr("cardinality >= 1 AND repetitions >= 1 AND seed >= 0 AND dense_containers >= 0 AND result_size >= 0")
    _refuse(rows.where(~F.coalesce(sane, F.lit(False))), "invalid measurement")

    each = rows.groupBy("cardinality", "operation", "seed").agg(F.count("*").alias("n"), F.min("repetitions").alias("low"), F.max("repetitions").alias("high"))
    seeds = each.groupBy("cardinality", "seed").agg(F.count("*").alias("operations"), F.max("n").alias("n"))
    _refuse(seeds.where((F.col("n") > 1) | (F.col("operations") != len(operations))), "repeated seed, or not with all operations")
    keys = each.groupBy("cardinality", "operation").agg(F.count("*").alias("samples"), F.min("low").alias("low"), F.max("high").alias("high"))
    _refuse(keys.where((F.col("low") != F.col("high")) | (F.lit(samples) != F.col("samples"))), "unequal repetitions, or another number of samples")
    if rows.isEmpty():
        raise ValueError("no measurements")
    return rows


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Calibration profiles, a JSON document a file, to a row a measurement with its profile's fields.

    ``distribution`` is the declared access pattern as JSON text with sorted names, so that equal ones are equal text. A profile without
    measurements, values that are not positive, samples that are not as many as the repetitions, and a build with an access pattern raise."""
    docs = spark.read.schema(PROFILE).options(multiLine=True, mode="FAILFAST").json(path)
    _refuse(docs.where("coalesce(size(measurements), 0) < 1").select("profile_id"), "profile without measurements")
    named = docs.select(
        F.coalesce("profile_id", F.concat_ws("-", F.lit("smoke"), F.coalesce("seed", F.lit(0)), F.coalesce("n", F.lit(0)))).alias("profile_id"),
        F.coalesce("record_count", "n", F.lit(0)).cast("long").alias("record_count"), "protocol", F.coalesce("evidence_state", F.lit(EVIDENCE_STATE)).alias("evidence_state"), F.explode("measurements").alias("m"),
    )
    rows = named.select("profile_id", "record_count", "protocol", "evidence_state", "m.*").withColumn("repetitions", F.coalesce("repetitions", F.lit(1)).cast("long"))
    sane = (
        F.expr("length(primitive) BETWEEN 1 AND 128 AND length(operation) BETWEEN 1 AND 128 AND ns_per_op > 0 AND repetitions BETWEEN 1 AND 1000")
        & F.expr("coalesce(implementation_id RLIKE '^[A-Za-z0-9_.:-]{1,200}$', true) AND coalesce(stdev_ns >= 0, true) AND (operation <> 'build' OR access_distribution IS NULL)")
        & F.expr(" AND ".join(f"coalesce({c} > 0, true)" for c in ("mean_ns", "median_ns", "min_ns", "max_ns")))
        & F.expr("coalesce(size(samples_ns), 0) < 1 OR (size(samples_ns) = repetitions AND forall(samples_ns, s -> s > 0))")
    )
    _refuse(rows.where(~F.coalesce(sane, F.lit(False))).select("profile_id", "primitive", "operation"), "invalid measurement")
    identity = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("access_distribution"))))
    return rows.withColumnRenamed("implementation_id", "implementation").withColumn("distribution", identity).drop("access_distribution")
