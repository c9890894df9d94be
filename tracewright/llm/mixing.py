"""Mixing sources to target weights by Pfair scheduling.

1. Blocks. A source's documents are put in random order and cut every ``BLOCK_CHARS`` characters: a block holds the documents that begin
   in it. Prefix sums are taken in two steps, within buckets of a source and over the buckets, so no task holds a source.
2. Windows. While a set of sources has blocks left (a phase), block j (from 0) of a source with share w of the weights may be released at
   floor(j / w) and is due at ceil((j + 1) / w); each slot goes to the released block with the earliest deadline. Shares are exact
   fractions, so every source stays within less than one block of its share at every slot of a phase, however long it is. When a
   source runs out the phase ends and the others share its weight.
3. Frames. Phases are cut into frames of about ``FRAME`` slots, which are scheduled independently, in Spark. After a whole period of the
   weights every share is a whole number, so frames end there if the period is at most ``PERIOD``; otherwise ``counts_at`` finds counts, each the
   floor or the ceiling of a share, from which all later and to which all earlier deadlines can be kept. The driver holds a number
   a source and frame; the schedule is a table with a row a block.

A source that holds a third of all rows costs no more than others: its rows are spread over buckets, and rows meet the schedule by
source and block. Spark broadcasts the schedule only while the written table is under the session's limit. No number of sources and no
weight is refused. There are at most as many phases as sources. Only where the period is longer than ``PERIOD`` does each frame also
take time in proportion to sources / smallest share.

Defined results: null sources are one source. Sources without a weight share ``rest`` (by default each weighs 1, so unlisted
sources are mixed evenly); a weight must be above 0. Null and empty texts have length 0. A text longer than a block leaves the blocks that
it covers empty; their slots then hold nothing. Repeated rows and rows with equal or null keys are placed one by one. Columns named like an added one
are replaced. No row is dropped or repeated. An empty table gives no rows. The random order follows the rows' places in the input's
files, so the input should be a written table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import documents, materialize

BLOCK_CHARS = 100_000
FRAME = 4096  # slots that one task schedules at a time
MAX_FRAMES = 4096
PERIOD = 1 << 20  # slots of the longest period that is a frame by itself
SCAN = 1 << 20  # numbers in work at once
BUCKET_BLOCKS = 64  # blocks of a bucket, about
MAX_BUCKETS = 1 << 16  # of a source; beyond, its buckets grow
MAX_BROADCAST = 1_000_000  # sources; beyond, they are joined by their names
ADDED = ("block", "slot", "release", "deadline", "phase", "mix_order")
WEIGHTS: dict[str, float] = {"src0": 4.0, "src1": 2.0, "src2": 2.0}


def whole_weights(weights: list) -> np.ndarray:
    """The weights as whole numbers in the same proportion; a float counts as the decimal it is written as."""
    exact = [Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    shared = math.gcd(*whole)
    return np.array([w // shared for w in whole], object)


def _ceil(a, b):
    return -(-a // b)


def _window(p, q, j):
    """Release and deadline of block j of a source with share p / q."""
    return j * q // p, _ceil((j + 1) * q, p)


def _plain(p: np.ndarray, q: int, most: int) -> np.ndarray:
    """As 64-bit numbers where products with ``most`` fit, else Python's."""
    return p.astype(np.int64) if max(q, int(p.max()) * most, q * 2) < 1 << 62 else p.astype(object)


def _room(p: np.ndarray, q: int, t: int, begin: int, end: int) -> np.ndarray:
    """For each b from begin to end - 1 the slots of [t, b) that blocks whose window lies in it leave free."""
    whole, out = _ceil(p * t, q), []
    for at in range(begin, end, step := max(1, SCAN // len(p))):
        b = np.arange(at, min(at + step, end)).astype(p.dtype)
        out.append(b - t - np.maximum(b[:, None] * p // q - whole, 0).sum(axis=1))
    return np.concatenate(out)


def counts_at(p: np.ndarray, t: int, horizon: int, before: np.ndarray | None = None) -> np.ndarray:
    """Blocks that each source has had after t slots: the floor or the ceiling of t * p / sum(p), adding up to t, and no less than ``before``, the
    counts of an earlier slot. All deadlines up to ``horizon`` can be kept.

    Of the blocks whose window holds t, some must be done before t. As many are taken as the deadlines after t need, in the order of those
    deadlines, each time the one that was released first: it is the easiest to have done before."""
    q = int(p.sum())
    p = _plain(p, q, 2 * (t + 1) + 2 * _ceil(q, int(p.min())))
    had = p * t // q
    wanted = t - int(had.sum())
    if not wanted:
        return had
    sure = np.zeros(len(p), bool) if before is None else before > had
    open_ = np.flatnonzero((p * t % q != 0) & ~sure)
    release, deadline = _window(p[open_], q, had[open_])
    had = had + sure
    wanted -= int(sure.sum())
    ready: list[tuple[int, int]] = []
    by_deadline: dict[int, list[tuple[int, int]]] = {}
    for r, d, s in zip(release.tolist(), deadline.tolist(), open_.tolist()):
        by_deadline.setdefault(d, []).append((r, s))
    times = sorted(by_deadline)
    met = [d for d in times if d <= horizon]
    if met and wanted:
        last = max(met[-1], min(horizon, times[-1]))
        least = np.minimum.reduceat(_room(p, q, t, met[0], last + 1), [d - met[0] for d in met])
        waiting = taken = 0
        for d, room in zip(met, least.tolist()):
            for x in by_deadline.pop(d):
                heapq.heappush(ready, x)
                waiting += 1
            while taken < wanted and waiting > room:
                had[heapq.heappop(ready)[1]] += 1
                taken, waiting = taken + 1, waiting - 1
        wanted -= taken
    rest = sorted([*ready, *(x for own in by_deadline.values() for x in own)])
    for _, s in rest[:wanted]:
        had[s] += 1
    return had


def phases(blocks: dict, weights: dict, frame: int = FRAME) -> list[tuple]:
    """Rows (phase, slot, sources, p, done, frames): a phase's first slot, whole weights, the blocks that its sources had before, and frames
    (begin, end, counts at begin, counts at end), all counted from the phase's first slot and blocks."""
    left, done, slot, rows = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        names = sorted(left)
        p = whole_weights([weights[s] for s in names])
        q, n = int(p.sum()), np.array([left[s] for s in names], object)
        lasts = n * q // p
        end = int(lasts.min())
        step = frame // q * q or (q if q <= PERIOD else frame)  # whole periods where they are short
        bounds = [(0, n * 0)]
        for t in [*range(step, end, step), end]:
            bounds.append((t, counts_at(p, t, end + 1, bounds[-1][1])))
        had = bounds[-1][1]
        late = np.flatnonzero((lasts == end) & (had < n))  # a last block that is due one slot later
        if len(late):
            had[late[0]] += 1
            end += 1
            bounds[-1] = (end, had)
        frames = [(a, b, [int(x) for x in first], [int(x) for x in last]) for (a, first), (b, last) in zip(bounds, bounds[1:])]
        rows.append((len(rows), slot, names, [int(x) for x in p], [done[s] for s in names], frames))
        for s, k in zip(names, had):
            done[s] += int(k)
            left[s] -= int(k)
            if not left[s]:
                del left[s]
        slot += end
    return rows


def frame_slots(p: list[int], begin: int, end: int, first: list[int], last: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rows (source's number, block, slot, release, deadline) of the slots from ``begin`` on, earliest deadline first."""
    q, tasks = sum(p), []
    for s, w in enumerate(p):
        for j in range(first[s], last[s]):
            release, deadline = _window(w, q, j)
            tasks.append((max(release, begin), min(deadline, end), s, j, release, deadline))
    tasks.sort()
    ready, out, k = [], [], 0
    for t in range(begin, end):
        while k < len(tasks) and tasks[k][0] <= t:
            heapq.heappush(ready, tasks[k][1:])
            k += 1
        due, s, j, release, deadline = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a block missed its deadline")
        out.append((s, j, t, release, deadline))
    return out


def schedule(spark: SparkSession, blocks: dict, weights: dict, frame: int = FRAME) -> DataFrame:
    """Rows (source, block, slot, release, deadline, phase): every block's slot, counted from the mixture's beginning. There are at most
    ``MAX_FRAMES`` frames and one more a phase, so they are longer for very many blocks."""
    frame = max(frame, _ceil(sum(blocks.values()), MAX_FRAMES))
    rows = [(phase, slot, names, [str(x) for x in p], done, *f) for phase, slot, names, p, done, frames in phases(blocks, weights, frame) for f in frames]  # weights may be beyond 64 bits
    frames = spark.createDataFrame(rows, "phase int, slot long, sources array<string>, p array<string>, done array<long>, begin long, end long, first array<long>, last array<long>")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                s, j, t, release, deadline = map(np.array, zip(*frame_slots([int(x) for x in r["p"]], r["begin"], r["end"], r["first"], r["last"])))
                columns = [j + np.array(r["done"])[s], t + r["slot"], release + r["slot"], deadline + r["slot"], np.full(len(s), r["phase"])]
                yield pa.RecordBatch.from_arrays([pa.array(r["sources"]).take(pa.array(s)), *(pa.array(c.astype(np.int64)) for c in columns)], ["_s", "block", "slot", "release", "deadline", "phase"])

    spread = frames.repartition("phase", "begin")
    return spread.mapInArrow(batches, "_s string, block long, slot long, release long, deadline long, phase long").withColumn("phase", F.col("phase").cast("int"))


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit("\0null"))


def plan(docs: DataFrame, weights: dict | None = None, rest: float = 1.0, source: str = "source", text: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[dict, dict]:
    """Blocks and weight of each source; null is the source "\\0null"."""
    weights = weights or {}
    if any(w <= 0 for w in [*weights.values(), rest]):
        raise ValueError("weights must be above 0")
    sized = docs.select(_source(source).alias("_s"), F.coalesce(F.char_length(text), F.lit(0)).alias("_n"))
    totals = {r["_s"]: r["_t"] for r in sized.groupBy("_s").agg(F.sum("_n").alias("_t")).collect()}  # a row a source
    return {s: max(1, _ceil(t, block_chars)) for s, t in totals.items()}, {s: weights.get(s, rest) for s in totals}


def mix(docs: DataFrame, weights: dict | None = None, rest: float = 1.0, source: str = "source", text: str = "text", block_chars: int = BLOCK_CHARS, frame: int = FRAME) -> DataFrame:
    """Add block, slot, release, deadline, phase and mix_order to the documents; (slot, mix_order) orders the mixture, where mix_order is the number of
    characters before the document in its source. Release and deadline are slots, counted like ``slot`` from the beginning."""
    spark = docs.sparkSession
    blocks, own = plan(docs, weights, rest, source, text, block_chars)
    placed = materialize(schedule(spark, blocks, own, frame), "schedule")
    buckets = spark.createDataFrame([(s, n, min(MAX_BUCKETS, n // BUCKET_BLOCKS + 1)) for s, n in blocks.items()], "_s string, _blocks long, _buckets long")
    if len(blocks) <= MAX_BROADCAST:  # else a hot source's rows would meet its one row in one task
        buckets = F.broadcast(buckets)
    names = [c for c in docs.columns if c not in ADDED]
    own_columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]  # apart, so that unused ones are pruned
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(3))
    sized = docs.select(*own_columns, _source(source).alias("_s"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("_n"), row.alias("_row")).join(buckets, "_s")
    sized = sized.withColumn("_b", F.pmod(F.xxhash64("_row"), "_buckets"))
    sums = sized.groupBy("_s", "_b").agg(F.sum("_n").alias("_t"))
    before = F.sum("_t").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))  # MAX_BUCKETS rows at most
    starts = materialize(sums.select("_s", "_b", F.coalesce(before, F.lit(0)).alias("_before")), "buckets")
    within = F.sum("_n").over(W.partitionBy("_s", "_b").orderBy("_row").rowsBetween(W.unboundedPreceding, -1))
    ordered = sized.join(starts, ["_s", "_b"], "left").withColumn("mix_order", F.coalesce("_before", F.lit(0)) + F.coalesce(within, F.lit(0)))
    cut = ordered.withColumn("block", F.least(F.floor(F.col("mix_order") / block_chars), F.col("_blocks") - 1))
    return cut.join(placed, ["_s", "block"]).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *ADDED)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"), WEIGHTS)
    return mixed.select("doc_id", "source", "block", "slot", "release", "deadline", "phase", "mix_order")
