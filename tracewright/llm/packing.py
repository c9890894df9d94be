"""Packing documents into token sequences by first-fit decreasing with a tournament tree, in randomised groups.

Tokens come from a public vocabulary file whose place is a parameter; text is split at ASCII white space first, which that
tokenizer never crosses, so each distinct word is encoded once in a worker and remembered. A document is its ids and one
closing id; it is cut at multiples of the sequence length, and the pieces go to sequences. Pieces fall into groups by a hash of their row's number,
so groups are alike, each is small enough for one task at any corpus size, and no group depends on another. Within a group
pieces are placed longest first, each into the first sequence with room: a tree of capacities, whose inner nodes hold the
larger child, finds it in log2(sequences) steps.

Documents may have a place in an order, such as that of a mixture. Groups then hold consecutive pieces of the order, sequences are numbered by
the mean place of their pieces, and pieces lie in order within their sequence. So sequences read by their ids follow the order, to within a group; padding
is that of first-fit decreasing as before.

Defined results: null and empty texts are the closing id alone. Repeated rows are packed one by one; pieces of equal length are placed by
key, start and checksum, or by their places in the order. A very long text is encoded whole, within its row, and cut. Empty tables give no
rows. Other columns of the documents are dropped, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, materialize

LENGTH = 2048
GROUP = 4096  # pieces of a group, about
RANGE = 4096  # places that are numbered at a time
END = 1  # id that closes a document
CACHE = 300_000  # words that a worker remembers, about 60 MB
MODEL = "word_bpe_49k.json"

_known: dict[str, dict[bytes, bytes]] = {}
_tokenizers: dict[str, object] = {}
# Latin letters, perhaps with a full stop or comma: the tokenizer makes one piece of the letters, lower-cased and as bytes.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """Each Latin letter's lower case in the printable stand-ins that byte-level tokenizers use for bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    stand_in = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    letters = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
    return {ord(c): "".join(stand_in[b] for b in c.lower().encode()) for c in letters}


_LETTERS = _byte_letters()


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_ids(words: list[bytes], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Each word with its ids. Plain words go to the vocabulary's merges directly, others through the whole tokenizer."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    tokenizer = _tokenizers[path]
    merge, whole = tokenizer.model.tokenize, []
    marks = {m: [t.id for t in merge(m)] if m else [] for m in ("", ".", ",")}
    for word in words:
        if plain := _PLAIN.fullmatch(word.decode()):
            ids = [t.id for t in merge(plain[1].translate(_LETTERS))] + marks[plain[2]]
            yield word, struct.pack(f"<{len(ids)}I", *ids)
        else:
            whole.append(word)
    for at in range(0, len(whole), 10_000):
        part = whole[at : at + 10_000]
        for word, got in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
            yield word, struct.pack(f"<{len(got.ids)}I", *got.ids)


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each UTF-8 text as little-endian unsigned 32-bit numbers, without the closing id."""
    known = _known.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    split = [t.split() for t in texts]
    if split:
        known.update(_word_ids(list(set().union(*split).difference(known)), path))
    return [b"".join([known[w] for w in words]) for words in split]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_ids: bool = False, place: str | None = None) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens), and the piece's ids and its document's place if asked for."""
    path = path or vocabulary_path()
    end = np.array([END], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                keys, start, size, crc, total, ids = [], [], [], [], [], []
                for k, own in enumerate(encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], path)):
                    own += end
                    for at in range(0, len(own), 4 * length):
                        part = own[at : at + 4 * length]
                        keys.append(k)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(own) // 4)
                        ids.append(part)
                numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                columns = [batch.column(0).take(pa.array(keys, pa.int64())), *numbers]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                if place:
                    columns.append(batch.column(2).take(pa.array(keys, pa.int64())))
                    names.append("_place")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    own = [F.col(place).cast("long").alias("_place")] if place else []
    return docs.select(key, text, *own).mapInArrow(batches, schema + ", ids binary" * with_ids + ", _place long" * bool(place))


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, placed in the given order into the first bin with room."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        left = tree[node]
        bins.append(node - leaves)
        offsets.append(capacity - left)
        tree[node] = left - size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def ranked(cut: DataFrame) -> DataFrame:
    """Add ``_rank``, the piece's number by place and start. Pieces are counted within ranges of places and over the ranges, so no task holds them all."""
    ranged = cut.withColumn("_range", F.floor(F.col("_place") / RANGE))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_within", F.row_number().over(W.partitionBy("_range").orderBy("_place", "start")) - 1)
    return numbered.join(starts, "_range").select(*cut.columns, (F.col("_before") + F.col("_within")).alias("_rank"))


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to the pieces. Their number sets the number of groups, and their places in its files their groups, so they should be
    a written table; equal pieces, or pieces of one key, fall into different groups. Pieces that have places in an order are grouped and numbered by it."""
    count = cut.count()
    groups = max(1, -(-count // group))
    if follow := "_place" in cut.columns:
        dealt = ranked(cut).drop("_place").withColumn("sequence_id", F.floor(F.col("_rank") / max(1, -(-count // groups))))
    else:
        dealt = cut.withColumn("sequence_id", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(5)), F.lit(groups)))
    schema = T.StructType([*(f for f in dealt.schema.fields if f.name != "_rank"), T.StructField("offset", T.LongType())])
    ties = ["_rank"] if follow else [key, "start", "ids_crc32"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *ties], ascending=[False, *[True] * len(ties)], ignore_index=True)
        bins, offsets = first_fit(pdf["length"].tolist(), length)
        pdf["sequence_id"] = pdf["sequence_id"] * (1 << 32) + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return in_order(pdf, np.array(bins)) if follow else pdf

    return dealt.groupBy("sequence_id").applyInPandas(fill, schema)


def in_order(pdf: pd.DataFrame, bins: np.ndarray) -> pd.DataFrame:
    """A group's sequences numbered by the mean rank of their pieces, which lie in order in them."""
    ranks = (pdf["_rank"] - pdf["_rank"].min()).to_numpy()
    number = np.empty(bins.max() + 1, np.int64)
    number[np.argsort(np.bincount(bins, ranks) / np.bincount(bins), kind="stable")] = np.arange(len(number))
    pdf["sequence_id"] += number[bins] - bins
    pdf = pdf.sort_values(["sequence_id", "_rank"], ignore_index=True)
    pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
    return pdf.drop(columns="_rank")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, key: str = "doc_id", with_ids: bool = False, place: str | None = None) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, sequence_id, offset). ``place`` names a column of whole numbers, once a document, whose order sequences follow."""
    cut = materialize(pieces(docs, path, length, key=key, with_ids=with_ids, place=place), "pieces")
    return pack(cut, length, group, key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
