"""The pipeline's stages on a small table, each held against what it may do to its own input."""

import os
import re
from collections import Counter

import corpus_pipeline
from tracewright.llm import mixing, simhash
from tracewright.llm.scratch import materialize


def test_stages(spark):
    sf_dir = os.environ.get("TEST_PIPELINE_DIR", "/root/testdata/sf0.01")  # sf0.001 has too few toxic labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), f"test-{name}")
        seen[name] = (before, after)
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    first, second = seen["toxicity"]
    dropped = set(ids(first)) - set(ids(second))
    assert dropped and len(dropped - toxic) <= 0.05 * first.count()
    first, second = seen["near_duplicates"]
    classes = {r.doc_id: r.component_id for r in simhash.similar_documents(first).collect()}
    assert set(ids(second)) == set(classes.values()) and len({classes[d] for d in ids(second)}) == second.count()
    first, second = seen["secrets"]
    assert ids(first) == ids(second) and second.where("n_chars <> char_length(text)").count() == 0
    first, second = seen["mixing"]
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(map(tuple, second.collect()), key=repr)
    slots = {r.doc_id: (r.slot, r.mix_order) for r in mixing.mix(first, mixing.WEIGHTS).collect()}
    order = [slots[r.doc_id] for r in corpus_pipeline.mixed_sources(spark, first, sf_dir).collect()]
    assert order == sorted(order)
    first, second = seen["packing"]
    pieces = second.collect()
    assert {r.doc_id for r in pieces} == set(ids(first)) and sum(r.length for r in pieces) == sum(dict((r.doc_id, r.doc_tokens) for r in pieces).values())


def test_stages_on_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, one very long text, columns that clash with those of the operators, and no rows at all."""
    from pyspark.sql import functions as F

    plain = "the river ran over old stones while birds sang and children played near a quiet mill in the valley below "
    texts = [None, "", None, plain * 2, plain * 2, plain + "here", "x", 'token = "0123456789abcdef0123456789abcdef01234567"', plain * 900, "you idiot " * 9]
    rows = [(i if i % 3 else None, t, "en", f"s{i % 2}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, plain * 2, "en", "s0", 9)] * 5 + [(1000 + i, f"{plain} number {i} {'you worthless idiot' if i % 3 == 0 else 'fine day'}", "en", "s1", 9) for i in range(90)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = [F.lit(k).alias(c) for k, c in enumerate(("slot", "phase", "score", "_row", "_doc", "_key", "_text", "_s", "_path", "length", "offset", "sequence_id", "node", "h", "_c0"))]
    spark.createDataFrame([(1000 + i, i % 2, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for part in (rows, []):
        before = materialize(spark.createDataFrame(part, names).select("*", *clash), "odd")
        for name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, before, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert after.columns == before.columns, name
                assert after.select("slot", "_row", "_c0").exceptAll(before.select("slot", "_row", "_c0")).count() == 0
            if name == "mixing":
                assert sorted(map(repr, after.collect())) == sorted(map(repr, before.collect()))
            if name == "secrets" and part:
                assert after.count() == before.count() and not after.where("text like '%0123456789abcdef01234567%'").count()
            if name == "near_duplicates" and part:
                kept = Counter(r.text for r in after.collect())
                assert kept[plain * 2] == 1 and sum(not (t or "").strip() for t in kept.elements()) == 1
            assert bool(part) == bool(after.count()), name
            before = after


def test_registered_queries_have_stable_columns(spark, sf_dir):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    for n in ("op2_byte_cnn", "op1_toxicity"):
        got = entry.queries()[n](spark, sf_dir)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_sequences_follow_the_mixture(spark, tmp_path):
    """Whatever the order of the files on disk, sequences by their ids hold the documents in the mixture's order and the sources in its weights."""
    from pyspark.sql import functions as F

    from tracewright.llm import packing

    n = 3 * packing.GROUP - 1000
    source = F.element_at(F.array(*map(F.lit, ("src0", "src1", "other"))), (F.col("id") % 3 + 1).cast("int"))
    text = F.concat(F.repeat(F.lit("the old mill stood by the river "), 12), F.col("id").cast("string"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), source.alias("source"), F.char_length(text).cast("long").alias("n_chars"))
    mixed = corpus_pipeline.mixed_sources(spark, materialize(docs, "plain"), "").persist()
    at = {r.doc_id: (i, r.source, r.n_chars) for i, r in enumerate(mixed.collect())}
    mixed.withColumn("_metadata", F.lit("clash")).write.option("maxRecordsPerFile", 700).parquet(str(tmp_path / "mixed"))
    written = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(written.inputFiles()) > 10
    pieces = sorted(corpus_pipeline.packed_sequences(spark, written, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    assert Counter(r.doc_id for r in pieces) == Counter(range(n))
    groups = {}
    for r in pieces:
        groups.setdefault(r.sequence_id >> 32, {}).setdefault(r.sequence_id, []).append(r)
    assert sorted(groups) == [0, 1, 2]
    end = 0
    for _, own in sorted(groups.items()):
        places = [[at[r.doc_id][0] for r in s] for s in own.values()]
        assert sorted(sum(places, [])) == list(range(end, end := end + sum(map(len, places))))  # a group is a stretch of the mixture
        assert all(p == sorted(p) for p in places)
        means = [sum(p) / len(p) for p in places]
        assert means == sorted(means)
        for s in own.values():
            assert sum(r.length for r in s) <= packing.LENGTH
            assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
    chars = Counter()
    for s in groups[0].values():
        for r in s:
            chars[at[r.doc_id][1]] += at[r.doc_id][2]
    for s, w in (("src0", 4), ("src1", 2), ("other", 1)):  # a third each without the mixture
        assert abs(chars[s] - chars.total() * w / 7) <= 2 * mixing.BLOCK_CHARS, s
    again = corpus_pipeline.packed_sequences(spark, materialize(written.orderBy(F.desc("doc_id")), "other-order"), "").collect()
    assert {(r.doc_id, r.sequence_id) for r in again} != {(r.doc_id, r.sequence_id) for r in pieces}


def test_places_are_those_of_the_written_rows(spark, tmp_path):
    from tracewright.llm.scratch import placed

    for name, first in (("part-10-b", 20), ("part-9-b", 10), ("part-10-a", 15), ("x", 30)):
        spark.range(first, first + 5).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    files = [str(next((tmp_path / "in" / d).glob("*.parquet"))) for d in ("x", "part-10-b", "part-9-b", "part-10-a")]
    got = placed(spark.read.parquet(*files), "id").orderBy("place").collect()
    assert [(r.id, r.place) for r in got] == [(x, i) for i, x in enumerate([*range(10, 25), *range(30, 35)])]
    assert sorted(map(tuple, placed(spark.range(4).repartition(1), "id").collect()))[0][0] == 0  # not a file: written first
