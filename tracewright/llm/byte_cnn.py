"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over every position of a
chunk (as sums of table rows, one table for each offset in the filter), are rectified and max-pooled within the chunk; the
maximum and the mean over all chunks go through one logistic unit. Training is Adam on a bounded sample drawn by hash
(``PER_LABEL`` documents a label, all chunks of each, so that pooling covers the same whole text as in scoring); the share of each label among all learning
rows then sets the bias. Scoring is one pass without a shuffle, a chunk block at a time in memory.

Defined results: null and empty texts are one chunk of padding. If a label is missing among the learning rows the score is
the share of label 1 (0.5 without any, as with empty tables). Labels, lang, source and doc_id are no inputs. Repeated rows are scored one by
one. A very long text is scored by itself, a block of chunks at a time; of tied positions in a chunk the first is the filter's. An empty table gives
no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents
from .training import labelled_sample, remainder

WIDTH = 6
FILTERS = 24
CHUNK = 512
OVERLAP = 64
PER_LABEL = 1200
EPOCHS = 12
RATE = 0.01
DECAY = 1e-4
BLOCK = 32  # chunks in work at once
THRESHOLD = 0.3


def chunked(text: bytes) -> np.ndarray:
    """Overlapping chunks [n, CHUNK] that cover every byte; the last is padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class ByteCNN:
    table: np.ndarray  # [WIDTH, 256, FILTERS]
    bias: np.ndarray  # [FILTERS]
    out: np.ndarray  # [2 * FILTERS]: of the maximum, of the mean
    out_bias: float

    def convolve(self, chunks: np.ndarray) -> np.ndarray:
        """Filter sums [n, positions, FILTERS] before the bias."""
        span = CHUNK - WIDTH + 1
        total = np.take(self.table[0], chunks[:, :span], axis=0, mode="clip")
        row = np.empty_like(total)
        for k in range(1, WIDTH):
            np.take(self.table[k], chunks[:, k : k + span], axis=0, out=row, mode="clip")
            total += row
        return total

    def strongest(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's best position and its sum there, before the bias."""
        conv = self.convolve(chunks)
        best = conv.argmax(axis=1)
        return best, np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Rectified maxima [n, FILTERS] of chunks."""
        parts = [self.convolve(chunks[a : a + BLOCK]).max(axis=1) for a in range(0, len(chunks), BLOCK)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def combine(self, pools: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose chunks begin at ``starts``."""
        counts = np.diff(np.r_[starts, len(pools)])
        features = np.hstack([np.maximum.reduceat(pools, starts), np.add.reduceat(pools, starts) / counts[:, None]])
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        scores, held, starts, n = [], [], [], 0
        for text in texts:
            starts.append(n)
            held.append(chunked(text))
            n += len(held[-1])
            if n >= 4096:  # 2 MB of bytes; a long text is pooled by itself
                scores.append(self.combine(np.concatenate([self.pooled(c) for c in held]) if len(held) == 1 else self.pooled(np.concatenate(held)), np.array(starts)))
                held, starts, n = [], [], 0
        if held:
            scores.append(self.combine(self.pooled(np.concatenate(held)), np.array(starts)))
        return np.concatenate(scores)


def gradient(net: ByteCNN, x: np.ndarray, first: np.ndarray, count: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean log loss of documents whose ``count`` chunks begin at ``first``; a gradient reaches a table only at each filter's best
    position in each chunk."""
    best, raw = map(np.concatenate, zip(*(net.strongest(x[a : a + BLOCK]) for a in range(0, len(x), BLOCK))))  # [chunks, FILTERS]
    raw = raw + net.bias
    pool = np.maximum(raw, 0)
    top, mean = np.maximum.reduceat(pool, first), np.add.reduceat(pool, first) / count[:, None]
    logit = np.hstack([top, mean]) @ net.out + net.out_bias
    error = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
    doc = np.repeat(np.arange(len(labels)), count)
    from_mean = (error / count)[doc, None] * net.out[FILTERS:]
    best_chunk = pool == top[doc]
    from_top = best_chunk * error[doc, None] * net.out[:FILTERS] / np.add.reduceat(best_chunk, first, dtype=np.int64)[doc]  # tied chunks share it
    d_raw = np.where(raw > 0, from_mean + from_top, 0).astype(np.float32)
    d_table = np.zeros_like(net.table)
    which = np.broadcast_to(np.arange(FILTERS), best.shape)
    for k in range(WIDTH):
        np.add.at(d_table[k], (np.take_along_axis(x, best + k, axis=1), which), d_raw)
    return {"out": np.hstack([top, mean]).T @ error, "out_bias": error.sum(), "bias": d_raw.sum(axis=0), "table": d_table}


def fit(chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteCNN:
    """Adam on the log loss."""
    rng = np.random.default_rng(seed)
    net = ByteCNN(
        (rng.normal(0, 0.25, (WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0
    )
    ends = np.r_[starts[1:], len(chunks)]
    state = {k: [0.0, 0.0] for k in ("table", "bias", "out", "out_bias")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            docs = order[at : at + 32]
            own = np.concatenate([np.arange(starts[d], ends[d]) for d in docs])
            count = (ends - starts)[docs]
            first = np.r_[0, np.cumsum(count)[:-1]]
            grad = gradient(net, chunks[own], first, count, labels[docs])
            step += 1
            for name, g in grad.items():
                now = getattr(net, name)
                g = g + DECAY * now
                m, v = state[name]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[name] = [m, v]
                setattr(net, name, now - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
                if name != "out_bias":
                    setattr(net, name, getattr(net, name).astype(np.float32))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str, learn, per_label: int = PER_LABEL) -> ByteCNN | float:
    """A network, or the constant score where only one label can be learned from."""
    sample, found = labelled_sample(docs, labels, label, learn, per_label)
    if not found.get(0) or not found.get(1):
        return found.get(1, 0) / sum(found.values()) if found else 0.5

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [chunked(text or b"").tobytes() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])

    rows = sample.mapInArrow(cut, "doc_id long, label int, chunks binary").toPandas().sort_values("doc_id")
    if rows["label"].nunique() < 2:  # labels of documents that aren't there
        return float(rows["label"].mean()) if len(rows) else 0.5
    counts = np.array([len(c) // CHUNK for c in rows["chunks"]])
    chunks = np.frombuffer(b"".join(rows["chunks"]), np.uint8).reshape(-1, CHUNK)
    y = rows["label"].to_numpy(np.float64)
    net = fit(chunks, np.r_[0, np.cumsum(counts)[:-1]], y)
    net.out_bias = float(net.out_bias + np.log(found[1] / found[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score_documents(docs: DataFrame, net: ByteCNN | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, score)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            scores = net.score(texts).astype(np.float64) if isinstance(net, ByteCNN) else np.full(len(texts), float(net))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], [key, "score"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~held_out)
    scored = score_documents(docs, net)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
