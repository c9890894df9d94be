"""Streams against their batch counterparts."""

import random

from pyspark.sql import functions as F

from tracewright.functions import traces
from tracewright.plans import adaptation
from tracewright.streaming import sessions


def drain(stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_monotone_sessions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.randrange(40)) for i in range(60)]
    batch = spark.createDataFrame(rows, "session long, arrival long, sequence long")
    for k in range(3):  # three files, one after the other
        batch.where(F.floor(F.col("arrival") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(sessions.accept_monotone(stream), tmp_path, "steps")
    want = adaptation.monotone_sessions(batch, "session", "arrival", "sequence").collect()
    assert sorted((r.session, r.sequence, r.accepted) for r in got) == sorted((r.session, r.sequence, r.accepted) for r in want)


def test_phase_changes(spark, tmp_path):
    keys = [1, 2, 3, 4] * 10 + [7, 8] * 20 + [9]
    batch = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "trace_id long, arrival long, key long")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(sessions.phase_changes(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), size=20), tmp_path, "phases")
    want = traces.phase_boundaries(batch.withColumnRenamed("arrival", "pos"), 20).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
