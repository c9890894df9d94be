"""Toxicity of texts whose words may be disguised: a noisy-channel decoder restores them, then a learned lexicon scores.

1. Language model: counts of three-character windows over every document (27 letter classes and a boundary), summed in each
   task before they are shuffled; the table has 28^3 cells at any corpus size.
2. Channel: a token with letters among digits or symbols, a letter three times running, separators between single letters, or
   a run of single-character tokens becomes a lattice. Each run of equal characters is a position: a leet character may stand
   for its letters or for a boundary, a repetition for one or two letters, a separator for nothing or a boundary. Viterbi
   search finds the cheapest path under channel and language model. All other tokens stand as they are.
3. Score: each restored word gets the largest lower bound of the log odds of its prefixes and itself; a logistic unit
   combines the largest weights among a document's distinct words, and the surest word may decide alone (noisy or). Both are learned from a bounded sample drawn by hash
   (``PER_LABEL`` documents a label): the lexicon from one half, the unit and what counts as sure from the other, the final lexicon from both. The sample's
   words stay in a table: entries are counted and weighed in Spark, and the driver gets the lexicon and ``TOP`` weights a document.

Scoring is one pass over whole texts without a shuffle. Defined results: null and empty texts score as texts without words.
If a label is missing among the learning rows the score is the share of label 1 (0 without any), and so for an empty labels table. Labels,
lang, source and doc_id are no inputs. Repeated rows are scored one by one; a text of any length costs time in proportion to it. An empty
table gives no rows. ``reject`` keeps all columns, whatever their names; ``score_documents`` replaces a column called score. Equally cheap
readings of a token go to the one that the lattice lists first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, documents, materialize
from .training import labelled_sample, remainder

PER_LABEL = 2000
PREFIXES = (3, 4, 5, 6, 7)
TOP = 8  # largest word weights that the unit sees
MARGIN = 0.5  # log odds above all but one in a thousand clean learning documents at which one word may decide alone
COUNTS = ("n0", "n1", "t0", "t1")  # documents of each label, in all and without those that teach the unit
MIN_DOCS = 3  # sample documents that a lexicon entry needs
CACHE = 150_000  # tokens whose weights a task remembers
WORK = 1 << 18  # bytes counted at once
ROWS = 200  # documents in work at once
THRESHOLD = 0.7
SYMBOLS = 28

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
EDGE = ".,;:?\"'()[]{}<>#%&*«»…"
MARKS = re.compile(r"[!$|+]{2,}$|!$")
DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+€]|.*(\w)\1\1|.*[^\W\d_][.\-_*~][^\W\d_][.\-_*~])", re.DOTALL)
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
WORD = re.compile(r"[^\W\d_]+")


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[0xC0:] = 27  # the first byte of any other letter; continuation bytes are skipped
    return table


_CLASS = _classes()


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def window_counts(texts: list[bytes]) -> np.ndarray:
    """Counts [SYMBOLS ** 3] of three-symbol windows; a text begins and ends with boundaries."""
    raw = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
    raw = raw[(raw & 0xC0) != 0x80]
    total = np.zeros(SYMBOLS**3, np.int64)
    for at in range(0, len(raw) - 2, WORK):
        symbols = _CLASS[raw[at : at + WORK + 2]]
        total += np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)
    return total


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """-log P(third | first two) from all documents, interpolated with the two-symbol and uniform models."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                total += window_counts([t for t in whole.column(0).slice(at, ROWS).cast(pa.binary()).to_pylist() if t])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    rows = docs.select(text).mapInArrow(batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n3 = np.zeros(SYMBOLS**3)
    for r in rows:  # SYMBOLS ** 3 at most
        n3[r.cell] = r.n
    n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2 = n3.sum(axis=0)
    p2 = (n2 + 0.5) / (n2.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    return -np.log((n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters may have been, with the channel's costs."""
    positions = []
    for ch, run in groupby(token.lower()):
        n = sum(1 for _ in run)
        if ch in LEET:
            options = [(letter, 1.2) for letter in LEET[ch]] + [(" ", 3.0)]
            options += [(letter * 2, 1.5) for letter in LEET[ch]] if n > 1 else []
        elif ch.isalpha():
            options = [(ch, 0.0)] if n == 1 else [(ch * 2, 0.2), (ch, 2.0)] if n == 2 else [(ch, 0.7), (ch * 2, 0.7)]
        else:
            options = [("", 0.5), (" ", 1.0)]
        positions.append(options)
    return positions


def decode(token: str, costs: list[list[list[float]]]) -> str:
    """Cheapest reading of a disguised token: lower-case words, space-separated."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in [*lattice(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for emitted, extra in options:
                x, y, total = a, b, cost + extra
                for ch in emitted:
                    z = _class(ch)
                    total += costs[x][y][z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, emitted))
        states = after
    path, parts = min(states.values(), key=lambda s: s[0])[1], []
    while path:
        path, emitted = path
        parts.append(emitted)
    return "".join(reversed(parts)).strip()


def token_words(token: str, costs: list) -> list[str]:
    """Words of one whitespace-free token (or of a run of single characters with its spaces), restored if disguised."""
    core = token.strip(EDGE)
    core = MARKS.sub("", core).strip(EDGE) or core
    if (" " in core or "\t" in core) or DISGUISED.match(core):
        return WORD.findall(decode(core, costs))
    return WORD.findall(core.lower())


def restore(text: str, costs: list) -> str:
    """The text with its disguised tokens decoded."""
    text = SPACED.sub(lambda m: decode(m.group(), costs), text)
    return re.sub(r"\S+", lambda m: " ".join(token_words(m.group(), costs)) if DISGUISED.match(m.group().strip(EDGE)) else m.group(), text)


def tokens_of(text: str) -> set[str]:
    """Distinct tokens; a run of single characters is one token beside its parts."""
    found = set(text.split())
    found.update(m.group() for m in SPACED.finditer(text))
    return found


def entries(word: str) -> list[str]:
    return ["^" + word[:n] for n in PREFIXES if len(word) >= n] + [word + "$"]


def entry_counts(words: DataFrame) -> DataFrame:
    """Rows (words, label, unit) of distinct words to (entry, n0, n1, t0, t1): documents of each label that have the entry, in all and without the
    unit's. Batches are summed before the shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in it for at in range(0, whole.num_rows, ROWS)):
            seen: dict[str, int] = {}  # the four counts, of 16 bits each: a slice has fewer documents
            for own, label, unit in zip(*(c.to_pylist() for c in batch.columns)):
                one = (1 << 16 * label) + (0 if unit else 1 << 16 * (2 + label))
                for e in {e for w in own.split() for e in entries(w)}:
                    seen[e] = seen.get(e, 0) + one
            counts = np.fromiter(seen.values(), "<u8", len(seen)).view("<u2").reshape(-1, 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *map(pa.array, counts.T.copy())], ["entry", *COUNTS])

    each = words.select("words", "label", "unit").mapInArrow(batches, "entry string, " + ", ".join(f"{c} long" for c in COUNTS))
    return each.groupBy("entry").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _odds(n0, n1, all0: int, all1: int):
    """Lower bounds (one standard error) of log odds by documents that have an entry, of all0 and all1 documents."""
    return np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1)) - np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def lexicons(words: DataFrame, totals: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """The entries whose bounds are above 0, by all documents and without the unit's; ``totals`` are the documents of each of ``COUNTS``. Only entries
    that may be in one of them come to the driver."""

    def may(c0: str, c1: str, all0: int, all1: int) -> Column:
        n0, n1 = F.col(c0) + 0.5, F.col(c1) + 0.5
        odds = F.log(n1 / (all1 + 1)) - F.log(n0 / (all0 + 1)) - F.sqrt(1 / n1 + 1 / n0)
        return (F.col(c1) > 0) & (F.col(c0) + F.col(c1) >= MIN_DOCS) & (odds > -1e-9)

    found = entry_counts(words).where(may("n0", "n1", *totals[:2]) | may("t0", "t1", *totals[2:])).collect()
    out = []
    for c0, c1, *of in (("n0", "n1", *totals[:2]), ("t0", "t1", *totals[2:])):
        each = {r["entry"]: float(_odds(r[c0], r[c1], *of)) for r in found if r[c1] and r[c0] + r[c1] >= MIN_DOCS}
        out.append({e: each[e] for e in sorted(each) if each[e] > 0})
    return out[0], out[1]


def largest_weights(words: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Rows (doc_id, label, words) to (doc_id, label, n, top): how many words there are, and the ``TOP`` largest weights in falling order."""
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            each = [[max(shared.value.get(e, 0.0) for e in entries(w)) for w in own.split()] for own in batch.column(2).to_pylist()]
            top = pa.array([sorted(own, reverse=True)[:TOP] for own in each], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, each), pa.int64()), top], ["doc_id", "label", "n", "top"])

    return words.select("doc_id", "label", "words").mapInArrow(batches, "doc_id long, label int, n long, top array<double>")


def features(weights: np.ndarray, sure: float, n: int | None = None) -> np.ndarray:
    """The largest word weight, how far it is above ``sure``, means of the 3 and TOP largest, how many words there are (``n``, where the weights
    are not all)."""
    top = np.zeros(TOP)
    best = np.sort(weights)[::-1][:TOP]
    top[: len(best)] = best
    return np.r_[top[0], max(0.0, top[0] - sure), top[:3].mean(), top.mean(), np.log1p(len(weights) if n is None else n)]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    costs: np.ndarray  # of the language model
    lexicon: dict[str, float]
    unit: np.ndarray
    sure: float = 0.0  # log odds at which one word may decide alone
    constant: float | None = None

    def scorer(self):
        """A function of one text, with a bounded memory of token weights."""
        costs, lexicon, sure, known = self.costs.tolist(), self.lexicon, self.sure, {}

        def weight(token: str) -> float:
            return max((lexicon.get(e, 0.0) for w in token_words(token, costs) for e in entries(w)), default=0.0)

        def score(text: str) -> float:
            if self.constant is not None:
                return self.constant
            if len(known) > CACHE:
                known.clear()
            weights = []
            for token in tokens_of(text):
                found = known.get(token)
                if found is None:
                    found = known[token] = weight(token)
                weights.append(found)
            z = float(features(np.array(weights), sure) @ self.unit[:-1] + self.unit[-1])
            alone = 3 * (max(weights, default=0.0) - sure)
            no = [1 / (1 + np.exp(np.clip(x, -30, 30))) for x in (z, alone)]
            return float(1 - no[0] * no[1])  # either the words together or the surest one

        return score


def train(docs: DataFrame, labels: DataFrame, label: str, learn, per_label: int = PER_LABEL) -> ToxicityModel:
    costs = language_model(docs)
    sample, found = labelled_sample(docs, labels, label, learn, per_label)
    if not found.get(0) or not found.get(1):
        return ToxicityModel(costs, {}, np.zeros(1), constant=found.get(1, 0) / max(1, sum(found.values())))
    drawn = sorted({(r.doc_id, r.label) for r in sample.select("doc_id", "label").collect()})  # two numbers a document of the bounded sample
    y = np.array([v for _, v in drawn])
    if len(set(y)) < 2:  # labels of documents that aren't there
        return ToxicityModel(costs, {}, np.zeros(1), constant=float(y.mean()) if len(y) else 0.0)
    for_unit = np.random.default_rng(5).random(len(y)) < 0.5
    if both := len(set(y[for_unit])) < 2 or len(set(y[~for_unit])) < 2:
        for_unit[:] = True
    halves = docs.sparkSession.createDataFrame([(*x, bool(u)) for x, u in zip(drawn, for_unit)], "doc_id long, label int, unit boolean")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = costs.tolist()
        for batch in it:
            out = [" ".join(sorted({w for t in tokens_of(x or "") for w in token_words(t, table)})) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], ["doc_id", "label", "unit", "words"])

    taught = docs.select("doc_id", "text").join(F.broadcast(halves), "doc_id").select("text", "doc_id", "label", "unit")
    words = materialize(taught.mapInArrow(batches, "doc_id long, label int, unit boolean, words string"), "words")
    of = {(r.label, r.unit): r["count"] for r in words.groupBy("label", "unit").count().collect()}
    totals = [of.get((v, False), 0) + of.get((v, True), 0) for v in (0, 1)]
    teaching = totals if both else [of.get((v, False), 0) for v in (0, 1)]
    lexicon, part = lexicons(words, [*totals, *teaching])
    each = sorted(largest_weights(words.where("unit"), lexicon if both else part).collect(), key=lambda r: r.doc_id)
    discard(words)
    sure = float(np.quantile([max(r.top, default=0.0) for r in each if not r.label], 0.999)) + MARGIN
    x, y = np.array([features(np.array(r.top), sure, r.n) for r in each]), np.array([r.label for r in each], np.float64)
    unit = logistic(x, y)
    unit[-1] += np.log(found[1] / found[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(costs, lexicon, unit, sure)


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone by default) and the score, which replaces a column of that name."""
    keep = [c for c in (keep or ["doc_id"]) if c != "score"]
    sent = keep if text in keep else [*keep, text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 28 ** 3 costs and the bounded sample's lexicon

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in (whole.slice(at, ROWS) for whole in it for at in range(0, whole.num_rows, ROWS)):
            scores = pa.array([score(t or "") for t in batch.column(sent.index(text)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), scores], [*keep, "score"])

    return docs.select(*sent).mapInArrow(batches, f"{schema}, score double")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    scored = score_documents(docs.select(*columns), model, f"_c{docs.columns.index(text)}", [f"_c{i}" for i in range(len(columns))])
    return scored.where(F.col("score") < threshold).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 3) == 1
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", ~held_out)
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
