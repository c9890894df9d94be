"""Documents to training sequences: toxic documents go, one of each group of near duplicates stays, secrets are masked, sources are
mixed to target weights, and what is left is packed in the order of the mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; the mixture's order is that of the written rows. No stage samples or caps: each works
on all that its predecessor kept. Null texts and ids, repeated rows and empty tables have the results that the stages' operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, packing, secrets, simhash, toxicity
from tracewright.llm.scratch import discard, documents, materialize, placed
from tracewright.llm.training import remainder


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rejects what scores at the threshold or above; learns from the labels op1 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels, "toxic", remainder("doc_id", 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: secrets become a mask; n_chars follows the text, every document stays."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows in the order of the schedule, across and within the files, which packing follows; every document stays."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"), F.col("source").alias("_source")), mixing.WEIGHTS, source="_source", text="_text")
    return mixed.orderBy("slot", "mix_order").select("_doc.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row a piece, with its sequence and place. By sequence_id, sequences follow the order in which the documents were written."""
    return packing.pack_documents(placed(docs, "doc_id", "text"), place="place")


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("secrets", masked_secrets),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
# Learned scores, connected components, a forest and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
