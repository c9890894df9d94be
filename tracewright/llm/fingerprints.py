"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's word shingles (five words; a shorter text is one shingle), so
the sketch of a union is the bottom k of two sketches: parts of a document merge in any order, in tasks or by
``merge_sketches`` over groups. From sketches alone come the resemblance (Jaccard), the containment and the number of
distinct shingles; all are exact while a text has at most k distinct shingles.

As a string a sketch is its hashes in rising order, 8 characters of URL-safe base64 each; equal texts have equal strings.

Defined results: null and empty texts have the empty sketch; two empty sketches resemble each other by 1, an empty and
another by 0. Repeated rows are fingerprinted one by one. A text of any length is sketched whole, within its row. An empty table gives no rows. Other
columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents
from .simhash import shingles

K = 128
RANGE_BYTES = 1 << 23  # of the texts of a range, about
MAX_RANGES = 20_000  # beyond, ranges are longer
SHINGLE = 5
BITS = 48
PART = 1 << 16  # words sketched at once


def sketch(text: bytes, k: int = K, size: int = SHINGLE, part: int = PART) -> np.ndarray:
    """Bottom-k of a UTF-8 text, rising; words are runs of anything but ASCII space, as they stand. Texts of more than ``part`` words are sketched in
    parts, which overlap by a word less than a shingle, and merged."""
    words = text.split()
    if len(words) > part:
        return merge((_bottom(words[at : at + part + size - 1], k, size) for at in range(0, len(words) - size + 1, part)), k)
    return _bottom(words, k, size)


def _bottom(words: list[bytes], k: int, size: int) -> np.ndarray:
    grams = shingles(words, size)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g) for g in grams), np.uint64, len(grams)) >> np.uint64(64 - BITS)
    return np.unique(hashes)[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of the union of the texts' shingles."""
    parts = list(sketches)
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of the shingle sets: the share of the union's bottom k that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = merge((a, b), k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles of the text: exact below k, else (k - 1) / (k-th smallest hash as a fraction)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[-1]) + 1) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has too: the intersection's size by a's, both estimated."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merge((a, b), k), k)
    return float(min(1.0, both / distinct_shingles(a, k)))


def encode(a: np.ndarray) -> str:
    return urlsafe_b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(urlsafe_b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Rows (key, fingerprint, n_shingles): one pass, no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            all_ = [sketch(t or b"", k, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encode(a) for a in all_], pa.string()), pa.array([distinct_shingles(a, k) for a in all_], pa.float64())],
                [key, "fingerprint", "n_shingles"],
            )

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string, n_shingles double")


def merge_sketches(fingerprints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketch of each group's union. Every task first merges what it has of a group as it reads, then 64 salts and last the group are folded,
    so a hot group costs a task no more than its own rows."""
    rows = fingerprints.select(*by, "fingerprint")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def done() -> pd.DataFrame:
            out = pd.DataFrame([(*key, encode(a)) for key, a in held.items()], columns=[*by, "fingerprint"])
            held.clear()
            return out

        for pdf in it:
            for key, own in pdf.groupby(by, dropna=False, sort=False)["fingerprint"]:
                key = tuple(None if pd.isna(x) else x for x in key)
                held[key] = merge([*([held[key]] if key in held else []), *map(decode, own)], k)
            if len(held) > 4096:
                yield done()
        yield done()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["fingerprint"] = encode(merge((decode(s) for s in pdf["fingerprint"]), k))
        return out

    spread = rows.mapInPandas(read, rows.schema).withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    part = spread.groupBy(*by, "_salt").applyInPandas(fold, spread.schema)
    return part.groupBy(*by).applyInPandas(fold, spread.schema).drop("_salt")


def _pairwise(estimate):
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([estimate(decode(x), decode(y)) for x, y in zip(a, b)], dtype="float64")

    return each


def resemblance_of(a: Column, b: Column) -> Column:
    """Resemblance of two fingerprint columns."""
    return F.pandas_udf(_pairwise(resemblance), "double")(a, b)


def containment_of(a: Column, b: Column) -> Column:
    """Containment of the first fingerprint column's texts in the second's."""
    return F.pandas_udf(_pairwise(containment), "double")(a, b)


def _ranges(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Add b, the number of each document's range, in the order of (doc_id, hash of the text); returns how many ranges there are.

    The input's bytes set their number. Bounds come from a quantile summary, so the driver holds a number a range. A doc_id that is
    a bound several times, as a hot one is, and null are split evenly by the text's hash; only equal rows stay together."""
    about = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = min(MAX_RANGES, (about["bytes"] or 0) // size + 1)
    nulls = about["nulls"] * n // max(1, about["n"]) + 1
    rest = n - nulls + 1
    bounds = docs.where("doc_id is not null").approxQuantile("doc_id", [i / rest for i in range(1, rest)], 0.1 / rest) if rest > 1 else []
    split = {float("-inf"): 1}
    for x in sorted(bounds or []):
        if x in split:  # a hot doc_id is a range of its own, in as many parts as it is a bound
            split[x] += 1
            split.setdefault(float(np.nextafter(x, np.inf)) if abs(x) >= 1 << 53 else x + 1, 1)
        else:
            split[x] = 1
    at = sorted(split)
    first = np.cumsum([nulls, *(split[x] for x in at)]).tolist()
    share = lambda parts: F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts)  # noqa: E731  the text's hash as a place in [0, parts)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    bucketed = Bucketizer(splits=[*at, float("inf")], inputCol="_x", outputCol="_k").transform(hashed) if len(at) > 1 else hashed.withColumn("_k", F.lit(0.0))
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # noqa: E731  folded to one array
    k = F.col("_k").cast("int") + 1
    parts = F.element_at(numbers([split[x] for x in at]), k)
    b = F.when(F.col("doc_id").isNull(), F.least(share(F.lit(nulls)), F.lit(nulls - 1))).otherwise(F.element_at(numbers(first[:-1]), k) + F.least(share(parts), parts - 1))
    return bucketed.select(b.cast("int").alias("b"), "doc_id", "h", "text"), first[-1]


def with_next(docs: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Documents dealt out by ranges of doc_id, a range a task, and sorted, each range ended by a copy of the document that follows it.

    Rows are (b, ghost, doc_id, text); ghost marks the copies. The last range ends with the first row that has a doc_id."""
    spark = docs.sparkSession
    dealt, n = _ranges(docs, size)
    heads = dealt.groupBy("b").agg(F.min(F.struct("doc_id", "h")).alias("least")).orderBy("b").collect()  # a row a range
    firsts = [(r.b, r.least.doc_id, r.least.h) for r in heads]
    begin = next((x for x in firsts if x[1] is not None), None)
    follows = [*firsts[1:], begin] if begin else firsts[1:]
    rows = dealt.select("b", F.lit(False).alias("ghost"), "doc_id", "h", "text")
    if follows:
        places = F.broadcast(spark.createDataFrame([(a[0], *b[1:]) for a, b in zip(firsts, follows)], "to int, _id long, _h long"))  # MAX_RANGES rows at most
        ghosts = dealt.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select(F.col("to").alias("b"), F.lit(True).alias("ghost"), "doc_id", "h", "text")
        rows = rows.unionByName(ghosts)
    return rows.repartitionById(n, "b").sortWithinPartitions("b", "ghost", "doc_id", "h").select("b", "ghost", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, k: int = K, size: int = SHINGLE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text beside its edited text (the last floor(n/2) code points replaced by the first as many of the next
    document's, all of them if there are fewer) and the next document. Rows with a null doc_id come before all others, rows with equal ones are in the
    order of their texts' hashes; the last document is followed by the first with a doc_id, or by an empty text if there is none."""

    def judged(doc_id, text: str, own: np.ndarray, after: str, after_sketch: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        other = sketch(edited, k, size)
        near = resemblance(own, other, k), resemblance(own, after_sketch, k)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(own), encode(other), *near, distinct_shingles(own, k), containment(own, other, k)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_in_edited"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is not there yet
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()
            return batch

        for batch in it:
            for b, ghost, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                b, ghost, text = b.as_py(), ghost.as_py(), text.as_py() or ""
                own = sketch(text.encode(), k, size)
                if held and held[0] == b:
                    out.append(judged(*held[1:], text, own))
                elif held:
                    out.append(judged(*held[1:], "", own[:0]))
                held = None if ghost else (b, doc_id.as_py(), text, own)
            yield flush()
        if held:
            out.append(judged(*held[1:], "", np.zeros(0, np.uint64)))
        yield flush()

    return with_next(docs, range_bytes).mapInArrow(batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_in_edited double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))
