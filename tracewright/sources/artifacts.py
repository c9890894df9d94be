"""Content-addressed artifacts, sample files and snapshots on any store that Spark writes to."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = "sample_id string, condition_id string, workload_id string, repetition_index long, metric string, value double, measurement_source string, protocol_id string, machine_fingerprint string"


def with_digest(artifacts: DataFrame, content: str = "content") -> DataFrame:
    return artifacts.withColumn("sha256", F.sha2(content, 256))


def store(artifacts: DataFrame, path: str, content: str = "content") -> None:
    """Append artifacts whose content is not there yet; of equal new ones a single row."""
    new = with_digest(artifacts, content).dropDuplicates(["sha256"])
    spark = artifacts.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti").select(*new.columns)
    new.write.mode("append").parquet(path)


def corrupted(stored: DataFrame, content: str = "content") -> DataFrame:
    """Artifacts whose content no longer has its digest."""
    return stored.where(F.sha2(content, 256) != F.col("sha256")).select("sha256", F.sha2(content, 256).alias("found"))


def inventory(stored: DataFrame, claims: DataFrame, content: str = "content") -> DataFrame:
    """What a backup has to hold: (sha256, size_bytes) of every artifact. Content without its digest raises, and so do open claims
    (rows with a ``state``), since what they write is not settled."""
    if corrupted(stored, content).limit(1).count():
        raise ValueError("an artifact has lost its digest")
    if claims.where(F.col("state").isin("PENDING", "AMBIGUOUS_FAILURE")).limit(1).count():
        raise ValueError("claims are open")
    return stored.select("sha256", F.octet_length(content).cast("long").alias("size_bytes")).distinct()


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Raw samples, one JSON object a line, with all fields; malformed lines and repeated sample ids raise."""
    rows = spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)
    broken = rows.where(" OR ".join(f"{f.name} IS NULL" for f in T._parse_datatype_string(SAMPLES).fields)).limit(1).count()
    repeated = rows.groupBy("sample_id").count().where("count > 1").limit(1).count()
    if broken or repeated:
        raise ValueError("incomplete samples" if broken else "repeated sample ids")
    return rows


def schema_identity(schema: T.StructType) -> str:
    """SHA-256 over the ordered names and types."""
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in schema.fields], separators=(",", ":")).encode()).hexdigest()


def write_snapshot(records: DataFrame, path: str) -> str:
    """Records beside the identity of their schema; returns the identity."""
    identity = schema_identity(records.schema)
    records.write.parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(identity,)], "identity string").coalesce(1).write.parquet(f"{path}/identity")
    return identity


def read_snapshot(spark: SparkSession, path: str, identity: str | None = None) -> DataFrame:
    """The records; another identity than the one written, or than the one asked for, raises."""
    records = spark.read.parquet(f"{path}/records")
    written = spark.read.parquet(f"{path}/identity").first()[0]
    if written != schema_identity(records.schema) or (identity is not None and identity != written):
        raise ValueError("the snapshot has another schema")
    return records
