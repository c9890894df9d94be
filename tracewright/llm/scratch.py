"""Tables written to the shared folder, so that no lineage is replayed and no executor's loss matters."""

from __future__ import annotations

import re
import uuid
import warnings
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests, a folder of the warehouse, with a warning on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: tables go to the warehouse, which all executors must share", stacklevel=3)
    return spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"


def _location(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it read back.

    A reliable checkpoint() would run the plan twice (once to count, once to write); a table runs it once.
    The table goes with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _location(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once all that reads them is written itself. Other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            at, files = _location(df.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def placed(table: DataFrame, *columns: str) -> DataFrame:
    """These columns and ``place``, the row's number in the order in which the Parquet table was written: files by the numbers in their names, rows
    as they stand. Reading alone does not keep that order. The driver holds a number a file; other DataFrames are written first."""
    if not table.inputFiles():
        table = materialize(table, "placed")
    meta = table.metadataColumn("_metadata")  # also beside a column of that name
    rows = table.select(*columns, meta["file_path"].alias("_path"), meta["row_index"].alias("_at"))
    counts = sorted(map(tuple, rows.groupBy("_path").count().collect()), key=lambda x: [int(s) if i % 2 else s for i, s in enumerate(re.split(r"([0-9]+)", x[0]))])
    firsts = accumulate((n for _, n in counts), initial=0)
    files = table.sparkSession.createDataFrame([(path, first) for (path, _), first in zip(counts, firsts)], "_path string, _first long")
    return rows.join(F.broadcast(files), "_path").select(*columns, (F.col("_first") + F.col("_at")).alias("place"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
