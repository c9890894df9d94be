"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a 200-byte string that covers it starts anywhere else too. All work is on the texts' UTF-8 bytes.

1. Cutting. Each 200-byte window has a key, the least hash of its 64-byte grams; a segment is a run of windows with one key. Equal
   windows have equal keys, so no repeat is lost, and a key that occurs once (and whose gram occurs once in the segment) cannot
   belong to a repeat. Keys are counted by a grouped sum and only segments with a shared key go on.
2. Equal segments become one row with two of their places before any text moves: two copies show all that thousands would.
3. Shards. The distinct segments of keys with a repeat are dealt out by key to shards of about ``SHARD`` bytes. Each shard gets a
   suffix array by Larsson-Sadakane refinement (eight bytes first, then doubling, sorted groups left alone) and its common
   prefixes by Kasai's rule (a prefix is one shorter than its left neighbour's unless the preceding bytes differ). A window is
   repeated if a neighbour in suffix order shares 200 bytes with it.
4. Merging. A key with more bytes of distinct segments than a shard holds spans several. Each of those sends sorted runs of digests, one
   digest a class of equal windows; runs meet by digest range, and each is looked up in every other by binary search. A digest is
   128 bits; the other comparisons are of bytes.
5. Ranges of repeated windows go back to all copies of a segment by a join, and each document's bytes are cut out.

Defined results: null and empty texts have no bytes and nothing removed. Matches never cross documents; they may be in the same one, also
overlapping. Repeated rows repeat each other, so they lose all their bytes (from 200 up); their segments are counted and placed once. Rows are known
by 128 bits of hash of doc_id and text, so those with equal or null doc_id are told apart by their texts. A very long text is cut up ``WORK`` bytes
at a time, with overlaps. An empty table gives no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, documents, materialize

LENGTH = 200
GRAM = 64
SHARD = 1 << 18  # bytes of distinct segments of a shard, about
RUN = (1 << 16) - 1  # windows of a segment at most; longer runs are cut
WORK = 1 << 17  # bytes in work at once; a longer text is cut with an overlap
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 times a power of two) from each position on."""
    h = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), 0, (1,)).copy()
    h ^= h >> np.uint64(29)
    h *= _MULTIPLY[0]
    size = 8
    while size < gram:
        h = h[:-size] * _MULTIPLY[1] + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= _MULTIPLY[3]
    h ^= h >> np.uint64(29)
    return h


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple:
    """Segments of the texts raw[start:end]: (key, position, windows, whether the key's gram occurs again in the segment)."""
    fit = ends - starts >= length
    starts, ends = starts[fit], ends[fit]
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    width = length - gram + 1
    h = _grams(raw, gram)
    least = _slide(h, width, np.minimum)
    n = len(least)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(least[1:], least[:-1], out=edge[1:n])
    edge[starts] = True
    last = ends - length + 1  # first position that is no window of the text
    edge[last] = True
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last, -1)
    at = np.flatnonzero(edge)
    run = np.diff(at)
    at = at[:-1]
    real = np.cumsum(inside)[at] > 0
    at, run = at[real], run[real]
    # a gram's position is some window's least if the windows over it have a least as large
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, width, np.maximum)[: len(h)] == h)
    key = least[at]
    first = np.searchsorted(chosen, at)
    stop = np.searchsorted(chosen, at + run + width - 1)
    met, j = np.zeros(len(at), np.int64), 0
    while (open_ := np.flatnonzero(first + j < stop)).size:
        met[open_] += h[chosen[first[open_] + j]] == key[open_]
        j += 1
    again = met > 1
    if run.size and run.max() > RUN:  # cut very long runs
        parts = -(-run // RUN)
        k = np.repeat(np.arange(len(run)), parts)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
        return key[k], at[k] + nth * RUN, np.minimum(RUN, run[k] - nth * RUN), again[k] | True
    return key, at, run, again


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about WORK bytes: raw, starts, ends, text number and offset in the text of each slice. A text above that is cut so
    that each window is in one slice."""
    held, size, who, where = [], 0, [], []

    def done():
        lengths = np.array([len(x) for x in held])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join([*held, b"\0" * LENGTH]), np.uint8), ends - lengths, ends, np.array(who), np.array(where)

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), WORK):
            part = text[at : at + WORK + LENGTH - 1] if len(text) > WORK else text
            if len(part) >= LENGTH:
                held.append(part)
                who.append(i)
                where.append(at)
                size += len(part)
                if size >= WORK:
                    yield done()
                    held, size, who, where = [], 0, [], []
    if held:
        yield done()


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, h, t, k): rows are known by two hashes, 64 bits each, of text and key; k is the key."""
    k = F.col(key).cast("long")
    return docs.select(F.xxhash64(text, k).alias("d"), F.xxhash64(F.lit(7), text, k).alias("h"), F.col(text).alias("t"), k.alias("k"))


def _packed(docs: DataFrame, key: str, text: str, once: bool = False) -> DataFrame:
    """(d, h, k, size, z): texts compressed for the way; with ``once`` a task sends equal rows once."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # two numbers a row of the task
        for batch in it:
            if once:
                known = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                fresh = [i for i, x in enumerate(known) if x not in seen and not seen.add(x)]
                batch = batch.take(pa.array(fresh, pa.int64()))
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            z = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([len(t) for t in texts], pa.int64()), z], ["d", "h", "k", "size", "z"])

    return _identified(docs, key, text).mapInArrow(batches, "d long, h long, k long, size long, z binary")


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", only_keys: bool = False) -> DataFrame:
    """Rows (m, s, d, h, p, again): key and digest of each segment, where it is; p packs the start and the number of windows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in (whole.slice(a, 1000) for a in range(0, whole.num_rows, 1000)):
                texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
                d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                found = []
                for raw, starts, ends, who, where in _slices(texts):
                    m, at, run, again = segments(raw, starts, ends)
                    if only_keys:
                        found.append((m,))
                        continue
                    mem = raw.tobytes()
                    digest = xxhash.xxh3_64_intdigest
                    s = np.fromiter((digest(mem[a:b]) for a, b in zip(at.tolist(), (at + run + LENGTH - 1).tolist())), np.uint64, len(at))
                    k = np.searchsorted(starts, at, "right") - 1
                    start = (at - starts[k] + where[k]).astype(np.uint64)
                    p = start << np.uint64(16) | run.astype(np.uint64)
                    found.append((m, s, d[who[k]], h[who[k]], p, again))
                names = ["m"] if only_keys else ["m", "s", "d", "h", "p", "again"]
                if found:
                    columns = [np.concatenate(c) for c in zip(*found)]
                    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return _identified(docs, key, text).mapInArrow(batches, "m long" if only_keys else "m long, s long, d long, h long, p long, again boolean")


def suffix_array(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: order of all suffixes of the texts that end at ``ends`` (rising, the last is len(raw)). Each text ends in a
    terminator of its own, below all bytes."""
    n = len(raw)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)  # bytes to the text's end
    word = np.ndarray(n, ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,)).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    word[short] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * left[short]).astype(np.uint64))
    # zero bytes look like the end of a text: then what ends first goes first
    order = np.lexsort((np.minimum(left, 8), word)) if len(raw) and not raw.all() else np.argsort(word, kind="stable")
    # suffixes of less than eight bytes are told apart by their terminators
    new = np.r_[True, (word[order[1:]] != word[order[:-1]]) | (left[order[1:]] < 8) | (left[order[:-1]] < 8)]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    h = 8
    alone = new & np.r_[new[1:], True]
    open_ = np.flatnonzero(~alone)
    while len(open_):
        i = order[open_]
        after = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)] + 1, 0)  # 0: the terminator is next
        pair = rank[i].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        i, pair = i[by], pair[by]
        order[open_] = i  # groups keep their places, members move within
        new = np.r_[True, (pair[1:] != pair[:-1]) | ((pair[1:] & np.uint64(0xFFFFFFFF)) == 0)]
        rank[i] = open_[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        open_ = open_[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's rule in text order: bytes that each suffix in ``order`` shares with the one before it (0 for the first)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1]]
    left = np.repeat(ends, ends - begins) - np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    first = np.zeros(n, bool)
    first[begins[begins < n]] = True
    fresh = (before < 0) | first | first[before] | (raw[i - 1] != raw[before - 1])
    start = np.flatnonzero(fresh)
    length = np.zeros(len(start), np.int64)
    word = np.ndarray(n, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero(before[start] >= 0)
    while len(live):
        a, b = start[live] + length[live], before[start[live]] + length[live]
        most = np.minimum(left[start[live]], left[before[start[live]]]) - length[live]
        inside = (a < n) & (b < n) & (most > 0)
        differ = np.zeros(len(live), np.uint64)
        differ[inside] = word[a[inside]] ^ word[b[inside]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        length[live] += np.minimum(np.where(inside, same, 0), np.maximum(most, 0))
        live = live[inside & (same == 8) & (most > 8)]
    since = np.maximum.accumulate(np.where(fresh, i, 0))
    full = np.zeros(n, np.int64)
    full[start] = length
    return np.maximum(full[since] - (i - since), 0)[order]


def repeated_windows(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each position whether its window occurs again in the shard, and the first position of its class in suffix order
    (-1 where no window fits)."""
    order = suffix_array(raw, ends)
    shared = common_prefixes(raw, ends, order) >= length
    flagged = np.zeros(len(raw), bool)
    flagged[order[shared]] = True
    flagged[order[:-1][shared[1:]]] = True
    leader = np.empty(len(raw), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(shared, 0, np.arange(len(order))))]
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(raw))
    leader[left < length] = -1
    return flagged, leader


def _ranges(flags: np.ndarray) -> list[int]:
    """[first, end, first, end, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).tolist()


def _by_group(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first column) from batches in which groups are contiguous."""
    rest: list[pa.RecordBatch] = []
    for batch in it:
        if batch.num_rows:
            g = batch.column(0).to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if rest and rest[0].column(0)[0].as_py() != g[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
                rest.append(batch.slice(a, b - a))
                if b < len(g):
                    yield pa.Table.from_batches(rest)
                    rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, z, wanted segments) to a row a segment with its bytes."""
    for batch in it:
        size, wanted = batch.column(0).to_pylist(), batch.column(2)
        flat = wanted.flatten()
        p = flat.field("p").to_numpy().view(np.uint64)
        first = (p >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        end = first + (p & np.uint64(RUN)).astype(np.int64) + LENGTH - 1
        bounds = np.cumsum(np.r_[0, wanted.value_lengths().to_numpy()])
        out = []
        for k, z in enumerate(batch.column(1)):
            text = pa.decompress(z.as_buffer(), size[k], "zstd", asbytes=True)
            out += [text[a:b] for a, b in zip(first[bounds[k] : bounds[k + 1]].tolist(), end[bounds[k] : bounds[k + 1]].tolist())]
        names = ["shard", "m", "s", "n", "parts"]
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(out, pa.binary())], [*names, "bytes"])


_DIGEST = np.dtype([("c1", "<u8"), ("c2", "<u8"), ("s", "<i8"), ("at", "<i8")])


def _shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, m, s, n, parts, bytes) to rows (m, s, ranges) of repeated windows. A key that spans shards (parts > 0) also sends
    its windows' digests, a first member a class (the others are known to be repeated): ``parts`` sorted runs by digest."""
    names = ["m", "s", "ranges", "part", "run"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.binary()]
    for table in _by_group(it):
        m, s, n, parts = (table.column(k).to_numpy() for k in range(1, 5))
        texts = table.column(5).to_pylist()
        there = Counter(zip(m.tolist(), s.tolist()))
        alone = [k for k in range(len(s)) if n[k] > 1 and there[int(m[k]), int(s[k])] == 1]  # copies of it are in an equal row
        if alone:
            m, s, n, parts = (np.concatenate([c, c[alone]]) for c in (m, s, n, parts))
            texts += [texts[k] for k in alone]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        flagged, leader = repeated_windows(raw, ends)
        out: list[tuple] = []
        for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            windows = flagged[a : b - LENGTH + 1]
            if windows.any():
                out.append((m[k], s[k], _ranges(windows), None, None))
        for key in np.unique(m[parts > 0]).tolist():
            rows = np.flatnonzero(m == key)
            first = np.concatenate([np.arange(ends[k] - len(texts[k]), ends[k] - LENGTH + 1) for k in rows])
            first = first[leader[first] == first]
            mem = raw.tobytes()
            both = b"".join([xxhash.xxh3_128_digest(mem[x : x + LENGTH]) for x in first.tolist()])
            run = np.zeros(len(first), _DIGEST)
            run["c1"], run["c2"] = np.frombuffer(both, "<u8").reshape(-1, 2).T
            segment = np.searchsorted(ends, first, "right")
            run["s"], run["at"] = s[segment], first - np.r_[0, ends][segment]
            run = np.sort(run, order=("c1", "c2"))
            part = (run["c1"] % np.uint64(parts[rows[0]])).astype(np.int64)
            out += [(key, None, None, p, run[part == p].tobytes()) for p in np.unique(part).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _found_in(run: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each digest of a sorted run is in another sorted run, by binary search."""
    at = np.searchsorted(other["c1"], run["c1"])
    hit = np.zeros(len(run), bool)
    live = np.flatnonzero(at < len(other))
    while len(live):  # equal first halves are next to each other
        live = live[other["c1"][at[live]] == run["c1"][live]]
        hit[live] |= other["c2"][at[live]] == run["c2"][live]
        live = live[~hit[live]]
        at[live] += 1
        live = live[at[live] < len(other)]
    return hit


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, m, run) to rows (m, s, ranges): each sorted run is looked up in every other run of its group."""
    for table in _by_group(it):
        runs = [np.frombuffer(x, _DIGEST) for x in table.column(2).to_pylist()]
        hits = [np.zeros(len(run), bool) for run in runs]
        for i, run in enumerate(runs):
            for j, other in enumerate(runs):
                if i != j:
                    open_ = np.flatnonzero(~hits[i])
                    hits[i][open_] = _found_in(run[open_], other)
        hit = np.sort(np.concatenate([run[own] for run, own in zip(runs, hits)]), order=("s", "at"))
        if len(hit):
            cuts = np.flatnonzero(np.r_[True, hit["s"][1:] != hit["s"][:-1]])
            each = [np.stack([x["at"], x["at"] + 1], axis=1).ravel().astype(np.int32) for x in np.split(hit, cuts[1:])]
            key = table.column(1)[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(cuts)), pa.array(hit["s"][cuts]), pa.array(each, pa.list_(pa.int32()))], ["m", "s", "ranges"])


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (d, h, spans): byte ranges [first, end, ...] of each document that repeated strings cover; not yet united."""
    shared = materialize(cut(docs, key, text, only_keys=True).groupBy("m").agg(F.count("*").alias("_n")).where("_n > 1").select("m", F.lit(True).alias("_shared")), "keys")
    own = cut(docs, key, text).join(shared, "m", "left").where("_shared OR again")
    kept = materialize(own.groupBy("m", "s", "d", "h", "p").agg(F.count("*").alias("n"), F.max("again").alias("again")), "segments")  # equal rows are one
    place = F.struct("d", "h", "p")
    distinct = materialize(kept.groupBy("m", "s").agg(F.sum("n").alias("n"), F.min(place).alias("at"), F.max(place).alias("to"), F.max("again").alias("again")), "distinct")
    size = F.col("at.p").bitwiseAND(F.lit(RUN)) + LENGTH - 1
    groups = distinct.groupBy("m").agg(F.sum(size * F.when(F.col("n") > 1, 2).otherwise(1)).alias("k"), F.max((F.col("n") > 1) | F.col("again")).alias("self"), F.count("*").alias("_c"))
    contested = materialize(groups.where("_c > 1 OR self").select("m", "k"), "contested")
    total = contested.agg(F.sum("k")).first()[0] or 0

    shards = max(1, -(-total // SHARD))
    parts = F.when(F.col("k") > SHARD, F.ceil(F.col("k") / SHARD)).otherwise(0)  # shards of a key that spans several
    shard = F.when(parts > 0, F.xxhash64("m", F.pmod("s", parts))).otherwise(F.pmod(F.xxhash64("m"), F.lit(shards)))
    places = F.explode(F.array_distinct(F.array("at", "to")))
    wanted = distinct.join(contested, "m").select("m", "s", "n", shard.alias("shard"), parts.alias("parts"), places.alias("at")).select(
        F.col("at.d").alias("d"), F.col("at.h").alias("h"), F.struct("shard", "m", "s", "n", "parts", F.col("at.p").alias("p")).alias("w")
    )
    by_doc = wanted.groupBy("d", "h").agg(F.collect_list("w").alias("w"))  # segments of one document
    met = _packed(docs, key, text, once=True).join(by_doc, ["d", "h"]).groupBy("d", "h").agg(F.any_value("size").alias("size"), F.any_value("z").alias("z"), F.any_value("w").alias("w"))
    fetched = met.select("size", "z", "w").mapInArrow(_fetch, "shard long, m long, s long, n long, parts long, bytes binary")
    dealt = fetched.repartition("shard").sortWithinPartitions("shard")
    found = materialize(dealt.mapInArrow(_shard, "m long, s long, ranges array<int>, part long, run binary"), "shards")
    runs = found.where("run is not null").select(F.xxhash64("m", "part").alias("g"), "m", "run")
    across = runs.repartition("g").sortWithinPartitions("g").mapInArrow(_merge, "m long, s long, ranges array<int>")
    all_ranges = found.where("ranges is not null").select("m", "s", "ranges").unionByName(across)
    ranges = materialize(all_ranges.groupBy("m", "s").agg(F.array_distinct(F.collect_list("ranges")).alias("_r")).select("m", "s", F.flatten("_r").alias("ranges")), "ranges")
    discard(shared, distinct, contested, found)
    start = F.expr("shiftrightunsigned(p, 16) & 4294967295")
    placed = kept.select("m", "s", "d", "h", "p").join(ranges, ["m", "s"]).select(
        "d", "h", F.transform("ranges", lambda x, i: start + x + F.when(i % 2 == 1, LENGTH - 1).otherwise(0)).alias("spans")
    )
    return placed.groupBy("d", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, spans, kept): united byte ranges [first, end, ...] that were removed, and the remaining bytes."""
    spans = repeated_ranges(docs, key, text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            all_spans, all_kept = [], []
            for size, z, flat in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = pa.decompress(z.as_buffer(), size, "zstd", asbytes=True) if size else b""
                if flat.is_valid and len(flat.values):
                    edges = flat.values.to_numpy()
                    depth = np.bincount(edges[::2], minlength=size + 1)[: size + 1] - np.bincount(edges[1::2], minlength=size + 1)[: size + 1]
                    gone = np.cumsum(depth)[:size] > 0
                    all_spans.append(_ranges(gone))
                    all_kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                else:
                    all_spans.append([])
                    all_kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(all_spans, pa.list_(pa.int64())), pa.array(all_kept, pa.binary())], ["k", "n_bytes", "spans", "kept"]
            )

    held = _packed(docs, key, text).join(spans, ["d", "h"], "left").select("k", "size", "z", "spans")
    done = held.mapInArrow(batches, "k long, n_bytes long, spans array<long>, kept binary")
    return done.select(F.col("k").alias(key), "n_bytes", "spans", "kept")


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
