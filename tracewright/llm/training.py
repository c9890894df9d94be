"""Bounded, documented samples of labelled documents, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` labelled documents of each label, drawn by a hash of the key, with how many there are in all.

    ``learn`` says which rows may teach. Documents without a label, or with a null one, are left out.
    """
    usable = labels.where(learn & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label")).dropDuplicates([key])
    found = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    drawn = [usable.where(F.col("label") == v).orderBy(F.xxhash64(key, F.lit(7)), key).limit(per_label) for v in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # 2 * per_label rows of two numbers at most
    return docs.select(key, "text").join(F.broadcast(chosen), key), found
