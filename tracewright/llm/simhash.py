"""SimHash near-duplicates by bit-sliced comparison.

1. One 64-bit fingerprint a document, from the XXH64 of its word shingles, whole text.
2. Equal fingerprints become one row before anything else, so copies cost nothing further.
3. Fingerprints that differ in at most 3 of 64 bits agree in at least 3 of 6 blocks: each goes under the 20 choices of 3
   blocks, a key of 31 to 33 bits. This loses no link at any size, and buckets stay small at billions of fingerprints.
4. Within a bucket fingerprints are stored as vertical bit planes, 64 to a machine word. A query's bits are xor-ed plane by
   plane into a carry-save counter of two bits and an overflow, which counts 64 distances at once; a word whose 64 lanes have
   all overflowed is abandoned. Large buckets are dealt out as pairs of chunks.
5. Only a spanning forest of each bucket's links is emitted; components of it are the components of all links.

``similar_documents`` applies the same comparison to 512-bit fingerprints of five-word shingles with the radius that similarity 0.8
sets, where blocks of the fingerprint are too short to collect candidates: there, buckets are bands of minimum hashes. Texts travel with
the fingerprints, and a pair joins a bucket's forest only after an exact check of its shingle sets. It takes two rounds. In the
first each member of a bucket meets only the bucket's smallest node, in groups of ``WIDE_CHUNK`` members, which joins most copies in linear work. In
the second, buckets that still hold several classes are compared in full, without what one class already holds.

Defined results: null and empty texts have fingerprint zero, linked like any other. Repeated rows stay rows. Null doc_ids
take part and never name a component (all-null components are null). An empty table gives no rows. Other columns are dropped, whatever their
names. A text of any length is read whole, a few hundred texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, documents, materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 6
CHUNK = 256  # fingerprints of a bucket that one group compares with as many
# For classes of similar documents: 512 bits, and bands of minimum hashes that bring candidates together.
WIDE_SHINGLE = 5
WIDE_LANES = 8
WIDE_RADIUS = 150
SIMILARITY = 0.8
BANDS, BAND_ROWS = 30, 4
WIDE_CHUNK = 512
_ODD = np.random.default_rng(42).integers(0, 1 << 63, WIDE_LANES + 1 + BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 15  # pairs of query and word in work at once
WORDS = 128  # words unfolded at once
ROWS = 1 << 13  # rows of a partition in work at once; a bucket of two takes a word of 64 lanes
BYTES = 1 << 26  # bytes of a partition in work at once, and of shingle sets that are kept


def _few(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; the whole sequence if it is shorter; none of none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a UTF-8 text; A-Z count as a-z."""
    grams = shingles(text.lower().split(), size)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    count = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    count += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(bits), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """Rows (key, fp): the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(it):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Signed masks of every choice of ``blocks - radius`` blocks of 64 bits."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints [n, lanes] of uint64 (n a multiple of 64) as planes[bit, word]; lane i of a word is its i-th fingerprint."""
    words, bits = len(fps) // 64, 64 * fps.shape[1]
    planes = np.empty((bits, words), np.uint64)
    for at in range(0, words, WORDS):  # unfolded bits take eight times the room
        part = np.ascontiguousarray(fps[64 * at : 64 * (at + WORDS)], "<u8").view(np.uint8).reshape(-1, 64, bits // 8)
        unfolded = np.unpackbits(part, axis=2, bitorder="little")
        planes[:, at : at + WORDS] = np.ascontiguousarray(np.packbits(unfolded.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    return planes


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _above(counts: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``, from the counters' bits."""
    greater, equal = over.copy(), ~over
    for level in reversed(range(len(counts))):
        if radius >> level & 1:
            equal &= counts[level]
        else:
            greater |= equal & counts[level]
            equal &= ~counts[level]
    return greater


def near_lanes(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each pair of word and query fingerprint [lanes], the mask of lanes within ``radius`` bits of the query.

    Four planes at a time go through carry-save adders into counters of radius.bit_length() bits and an overflow."""
    levels = radius.bit_length()
    near = np.zeros(len(word), np.uint64)
    live = np.arange(len(word))
    counts = [np.zeros(len(word), np.uint64) for _ in range(max(levels, 1))]
    over, none, one = np.zeros(len(word), np.uint64), np.uint64(0), np.uint64(1)
    for at in range(0, len(planes), 4):
        lane, shift = divmod(at, 64)
        bits = query[:, lane] >> np.uint64(shift)
        m = [planes[at + k, word] ^ (none - (bits >> np.uint64(k) & one)) for k in range(4)]
        low, carry_a = _full_add(counts[0], m[0], m[1])
        counts[0], carry_b = _full_add(low, m[2], m[3])
        if levels < 2:
            over |= carry_a | carry_b
        else:
            counts[1], carry = _full_add(counts[1], carry_a, carry_b)
            for level in range(2, levels):
                counts[level], carry = counts[level] ^ carry, counts[level] & carry
            over |= carry
        if at % 32 == 28:
            open_ = np.flatnonzero(~_above(counts, over, radius))
            if len(open_) < 0.8 * len(word):  # abandon words whose lanes are all beyond the radius
                live, word, query, over = live[open_], word[open_], query[open_], over[open_]
                counts = [c[open_] for c in counts]
    near[live] = ~_above(counts, over, radius)
    return near


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray, fps: np.ndarray, chosen: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Join the label trees of linked rows in place and keep the pairs that did it, the nearest ones first."""
    distance = None
    while True:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        distance = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) if distance is None else distance[apart]
        order = np.argsort(distance, kind="stable")
        high, first = np.unique(np.maximum(la, lb)[order], return_index=True)
        pick = order[first]
        label[high] = np.minimum(la, lb)[pick]
        chosen.append((a[pick], b[pick]))


def _checked_union(label: np.ndarray, a: np.ndarray, b: np.ndarray, fps: np.ndarray, same: Callable[[int, int], bool], chosen: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Like ``_union``, but only a pair that passes ``same`` joins trees; every other pair between two trees gets its turn."""
    order = np.argsort(np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1), kind="stable")
    a, b = a[order], b[order]
    for at in range(0, len(a), 4096):
        while not np.array_equal(up := label[label], label):
            label[:] = up
        some = at + np.flatnonzero(label[a[at : at + 4096]] != label[b[at : at + 4096]])
        for x, y in zip(a[some].tolist(), b[some].tolist()):
            p, q = x, y
            while label[p] != p:
                p = label[p]
            while label[q] != q:
                q = label[q]
            if p != q and same(x, y):
                label[max(p, q)] = min(p, q)
                chosen.append((np.array([x]), np.array([y])))


def spanning_links(
    group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS, same: Callable[[int, int], bool] | None = None, tree: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and side, fingerprints [n, lanes]. Sides: 0 queries, 1 targets of a pair of chunks; 2 both, of a lone
    chunk. Returns the rows (a, b) of a forest of near pairs that spans each group's links; with ``same``, a link is a near pair of rows
    that passes it. Rows of a group with equal ``tree`` are known to be linked.

    A group's queries are compared in three parts; words that are wholly in a query's tree by then are passed over."""
    n = len(fps)
    label, chosen = np.arange(n), []
    if tree is not None and n:
        order = np.lexsort((tree, group))
        new = np.r_[True, (group[order[1:]] != group[order[:-1]]) | (tree[order[1:]] != tree[order[:-1]])]
        label[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]  # the sort is stable: the first row of each tree
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    lanes_of, words, parts = [], 0, [[], [], []]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        target = np.arange(a, b) if side[a] == 2 else a + np.flatnonzero(side[a:b] == 1)
        query = target if side[a] == 2 else a + np.flatnonzero(side[a:b] == 0)
        padded = np.full(-(-len(target) // 64) * 64, -1)
        padded[: len(target)] = target
        lanes_of.append(padded)
        last = words + len(padded) // 64
        for k, (x, y) in enumerate(((0, 4), (4, 64), (64, len(query)))):
            if last > words and x < len(query):
                parts[k].append((words, last, query[x:y]))
        words = last
    if not words:
        return np.zeros(0, int), np.zeros(0, int)
    lanes = np.concatenate(lanes_of).reshape(-1, 64)
    planes = bit_planes(fps[lanes.ravel()])  # lanes without a row are masked below
    first = lanes[:, 0]

    def compare(word: np.ndarray, query: np.ndarray) -> None:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        tree = np.where(lanes >= 0, label[lanes], label[first][:, None])
        one_tree = (tree == tree[:, :1]).all(axis=1)
        todo = ~(one_tree[word] & (tree[word, 0] == label[query]))
        word, query = word[todo], query[todo]
        near = near_lanes(planes, word, fps[query], radius)
        hit = np.flatnonzero(near)
        on = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(on)
        other, own = lanes[word[hit[k]], lane], query[hit[k]]
        real = other >= 0
        if same is None:
            _union(label, own[real], other[real], fps, chosen)
        else:
            _checked_union(label, own[real], other[real], fps, same, chosen)

    for part in parts:
        held_w, held_q, held = [], [], 0
        for lo, hi, query in part:
            for at in range(0, len(query), step := max(1, SLICE // (hi - lo))):
                some = query[at : at + step]
                held_w.append(np.tile(np.arange(lo, hi), len(some)))
                held_q.append(np.repeat(some, hi - lo))
                held += len(some) * (hi - lo)
                if held >= SLICE:
                    compare(np.concatenate(held_w), np.concatenate(held_q))
                    held_w, held_q, held = [], [], 0
        if held:
            compare(np.concatenate(held_w), np.concatenate(held_q))
    if not chosen:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*chosen))


def _group_links(rows: DataFrame, by: list[str], radius: int, check: tuple[int, float] | None = None) -> DataFrame:
    """Rows (by, side, tree, node, fp binary) to links (a, b) of nodes that span all pairs within ``radius`` in each group of ``by`` (longs).

    ``check`` is the shingles' size and the similarity that a link needs; rows then also have their text (size, z)."""
    k = len(by)

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for i in range(k):
            g = table.column(i).to_numpy()
            new[1:] |= g[1:] != g[:-1]
        return new

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = weight = 0

        def done(upto: pa.Table) -> pa.RecordBatch:
            side, tree, node = (upto.column(k + i).to_numpy() for i in range(3))
            fp = np.frombuffer(b"".join(upto.column(k + 3).to_pylist()), "<u8").reshape(len(node), -1)
            same = _similarity_check(upto.column(k + 4).to_pylist(), upto.column(k + 5), *check) if check else None
            a, b = spanning_links(np.cumsum(borders(upto)), side, fp, radius, same, tree)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

        for batch in (whole.slice(at, ROWS) for whole in it for at in range(0, whole.num_rows, ROWS)):
            rest.append(batch)
            held += batch.num_rows
            weight += batch.nbytes
            if held >= ROWS or weight >= BYTES:  # all groups but the last are whole
                table = pa.Table.from_batches(rest).combine_chunks()
                starts = np.flatnonzero(borders(table))
                if len(starts):
                    whole = int(starts[-1])
                    yield done(table.slice(0, whole))
                    table = table.slice(whole)
                rest, held, weight = table.to_batches(), table.num_rows, 0
        if held:
            yield done(pa.Table.from_batches(rest).combine_chunks())

    columns = [*by, "side", "tree", "node", "fp", *(("size", "z") if check else ())]
    grouped = rows.select(*columns).repartition(*by).sortWithinPartitions(*by, "side")
    return grouped.mapInArrow(batches, "a long, b long")


def _chunk_pairs(met: DataFrame, chunk: int) -> DataFrame:
    """Rows (t, key, n, node, ..) of buckets with n members, once for each pair of chunks that they belong to: adds (low, high, side)."""
    return (
        met.withColumn("c", F.ceil(F.col("n") / chunk))
        .withColumn("own", F.pmod(F.xxhash64("node"), "c"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": F.expr("case when own = other then 2 when own < other then 0 else 1 end")})
        .drop("c", "own", "other")
    )


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct longs ``fp`` to links (a, b) that span all pairs within ``radius`` bits (3 at most)."""
    masks = block_masks(radius=radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    keyed = fps.select(F.col("fp").alias("node"), keys.alias("k")).select("node", "k.t", "k.key")
    shared = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = _chunk_pairs(keyed.join(shared, ["t", "key"]), CHUNK)
    own = F.unhex(F.lpad(F.hex("node"), 16, "0"))  # distances don't depend on the bits' order
    return _group_links(rows.withColumns({"fp": own, "tree": F.col("node")}), ["t", "key", "low", "high"], radius)


def _least_keys(distinct: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, least key) and (node, root) to (node, least, root) of every node, and (root, component_id) of every class."""
    named = materialize(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    return named, materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")


def _named(own: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows (key, node), (node, least key) and (node, root) to (key, node, component_id)."""
    named, smallest = _least_keys(distinct, roots)
    classes = materialize(named.join(smallest, "root").select("node", "component_id"), "classes")
    return own.join(classes, "node").select(key, "node", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Rows (key, fp, component_id): component_id is the smallest key reachable over links, its own included."""
    own = materialize(fingerprints(docs, text, key, size), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    return _named(own.withColumnRenamed("fp", "node"), distinct.withColumnRenamed("fp", "node"), roots, key).withColumnRenamed("node", "fp")


def wide_signature(text: bytes, size: int = WIDE_SHINGLE) -> bytes:
    """WIDE_LANES * 64 SimHash bits of the distinct word shingles, the BANDS keys of their minimum hashes, and a digest of them all;
    A-Z count as a-z."""
    h = shingle_set(text, size)
    if not len(h):
        return bytes(8 * (WIDE_LANES + BANDS + 1))
    lanes = (h[:, None] ^ h[:, None] >> np.uint64(31)) * _ODD[:WIDE_LANES]
    lanes ^= lanes >> np.uint64(29)
    lanes *= _ODD[WIDE_LANES : WIDE_LANES + 1]
    lanes ^= lanes >> np.uint64(32)
    count = np.zeros(64 * WIDE_LANES, np.int64)
    for at in range(0, len(lanes), 255):
        bits = np.unpackbits(np.ascontiguousarray(lanes[at : at + 255], "<u8").view(np.uint8).reshape(-1, 8 * WIDE_LANES), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint8)
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _ODD[-BANDS * BAND_ROWS :]).min(axis=0))
    band = least.reshape(BANDS, BAND_ROWS)
    key = band[:, 0].copy()
    for k in range(1, BAND_ROWS):
        key = (key ^ key >> np.uint64(33)) * _ODD[0] + band[:, k]
    return np.packbits(2 * count > len(h), bitorder="little").tobytes() + key.astype("<u8").tobytes() + xxhash.xxh3_64_digest(h.tobytes())


def shingle_set(text: bytes, size: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z count as a-z."""
    grams = shingles(text.lower().split(), size)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def _similarity_check(sizes: list[int], packed: pa.ChunkedArray, size: int, similarity: float) -> Callable[[int, int], bool]:
    """Whether the shingle sets of two rows have the similarity. Texts are cut up when first asked for, and ``BYTES`` of sets kept."""
    held: dict[int, np.ndarray] = {}
    room = 0

    def grams(row: int) -> np.ndarray:
        nonlocal room
        if row not in held:
            if room > BYTES:
                held.clear()
                room = 0
            text = pa.decompress(packed[row].as_buffer(), sizes[row], "zstd", asbytes=True) if sizes[row] else b""
            held[row] = shingle_set(text, size)
            room += held[row].nbytes
        return held[row]

    def same(a: int, b: int) -> bool:
        x, y = grams(a), grams(b)
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate([x, y]), kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common >= similarity * (len(both) - common)

    return same


def _packed_texts(named: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, fp, size, z): the fingerprint and the text of one document of each node, compressed for the way."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(it):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            z = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), z], ["_key", "size", "z"])

    ends = materialize(nodes.join(distinct.select("node", F.col("least").alias("_key"), F.substring("sig", 1, 8 * WIDE_LANES).alias("fp")), "node"), "ends")
    found = named.select("_key", "_text").mapInArrow(packed, f"_key {named.schema['_key'].dataType.simpleString()}, size long, z binary").join(ends, "_key")
    return found.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("fp", "size", "z")])  # a key may be a repeated row's


def _similar(named: DataFrame, radius: int, size: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (_key, _text) to (_key, node) of all of them, (node, least key) of their nodes and (node, root) of the linked ones."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(it):
            both = [wide_signature(t or b"", size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both, pa.binary())], ["_key", "sig"])

    kind = named.schema["_key"].dataType.simpleString()
    own = materialize(named.select("_key", "_text").mapInArrow(batches, f"_key {kind}, sig binary").withColumn("node", F.xxhash64("sig")), "signatures")
    distinct = materialize(own.groupBy("node").agg(F.min("_key").alias("least"), F.any_value("sig").alias("sig")), "distinct")
    at = 8 * WIDE_LANES
    band = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), i -> struct(cast(i AS bigint) AS t, conv(hex(substring(sig, {at + 1} + 8 * i, 7)), 16, 10) AS key)))")
    keyed = distinct.select("node", band.alias("k")).select("node", "k.t", F.col("k.key").cast("long").alias("key"))
    shared = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    met = materialize(keyed.join(shared, ["t", "key"]), "met")
    known = materialize(_packed_texts(named, distinct, met.select("node").distinct()), "texts")
    check = (size, similarity)

    pairs = materialize(met.where("node <> pivot").select("pivot", "node").distinct(), "pivots")
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / WIDE_CHUNK).alias("c"))
    members = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "c").alias("part"), F.lit(1).alias("side"), "node")
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("part"), F.lit(0).alias("side"), F.col("pivot").alias("node"))
    first = materialize(_group_links(members.unionByName(heads).withColumn("tree", F.col("node")).join(known, "node"), ["pivot", "part"], radius, check), "first-links")
    # two steps towards the smallest node of each class are enough to pass over most of what is linked already
    both = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("tree"))
    trees = materialize(least.join(least.select(F.col("node").alias("tree"), F.col("tree").alias("up")), "tree").select("node", F.col("up").alias("tree")), "trees")

    sorted_out = met.join(trees, "node", "left").select("t", "key", "n", "node", F.coalesce("tree", "node").alias("tree"))
    open_ = sorted_out.groupBy("t", "key").agg(F.min("tree").alias("_a"), F.max("tree").alias("_b")).where("_a <> _b").select("t", "key")
    rest = materialize(sorted_out.join(open_, ["t", "key"]), "open-buckets")
    rows = _chunk_pairs(rest, WIDE_CHUNK).join(known, "node")
    second = materialize(_group_links(rows, ["t", "key", "low", "high"], radius, check), "second-links")
    discard(shared, met, pairs, trees, rest, known)
    return own.select("_key", "node"), distinct.select("node", "least"), components(first.unionByName(second))


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = WIDE_RADIUS, size: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (key, component_id) of classes under the similarity (Jaccard) of five-word shingles.

    Large sets of similarity 0.8 have vectors at 27 degrees, so their fingerprints differ in 15.1 % of the bits (77 of 512, give or
    take 8), sets of 4 and 5 shingles in 18.8 % (96, give or take 9); the radius is six deviations above that. Pairs are compared where
    they share a band of four minimum hashes; at similarity 0.8 all thirty bands miss with probability 1.4e-7. Nearest pairs are checked
    first, and only pairs whose sets pass the exact check join a bucket's trees."""
    most = F.lit((1 << 63) - 1)
    named = docs.select(F.col(text).alias("_text"), F.struct(F.coalesce(F.col(key).cast("long"), most).alias("id"), F.xxhash64(text).alias("h")).alias("_key"))
    value = lambda c: F.when(F.col(c)["id"] != most, F.col(c)["id"])
    found = _named(*_similar(named, radius, size, similarity), "_key")
    return found.select(value("_key").alias(key), value("component_id").alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = WIDE_RADIUS, size: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of similar documents, with all its columns: the one with the smallest key (null keys come last;
    equal keys are told apart by all their columns, and of rows that are equal in all one stays)."""
    name = F.struct(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(*docs.columns).alias("h"))
    own, *classes = _similar(docs.select(F.col(text).alias("_text"), name.alias("_key")), radius, size, similarity)
    least = _least_keys(*classes)[1].select(F.col("component_id").alias("_key"))
    kept = materialize(own.select("_key").join(least, "_key").groupBy("_key").agg(F.count("*").alias("_n")).select("_key.id", "_key.h", "_n"), "kept")
    named = docs.select(F.struct(*docs.columns).alias("_doc"), name.alias("_key")).select("_doc", F.col("_key.id").alias("id"), F.col("_key.h").alias("h"))
    once = named.join(kept.where("_n = 1"), ["id", "h"]).select("_doc")
    many = named.join(kept.where("_n > 1"), ["id", "h"]).groupBy("id", "h").agg(F.any_value("_doc").alias("_doc")).select("_doc")
    return once.unionByName(many).select("_doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
