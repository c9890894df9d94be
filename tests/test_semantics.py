"""Hand values, ties, bounds and properties that a second engine cannot settle."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import evaluation
from tracewright.functions import statistics as stats
from tracewright.functions import traces
from tracewright.operators import access, bitmaps, graph, integrity, mutations, ordered
from tracewright.plans import adaptation, calibration, synthesis
from tracewright.sources import artifacts, measurements
from tracewright.sources import traces as intake


def trace_of(spark, keys):
    return spark.createDataFrame([(0, i, int(k)) for i, k in enumerate(keys)], "trace_id long, pos long, key long")


def profile_of(spark, keys):
    return traces.profile(trace_of(spark, keys)).first()


def test_sequential_trace(spark):
    p = profile_of(spark, range(200))
    assert (p.label, p.sequential_ratio, p.unique_ratio) == ("sequential", 1.0, 1.0)


def test_hotspot_trace(spark):
    p = profile_of(spark, [0] * 900 + list(range(1, 101)))
    assert p.label == "hotspot" and p.top10_mass >= 0.9 and p.entropy < 0.5


def test_zipf_trace(spark):
    keys = [r * 1000 for r in range(1, 31) for _ in range(int(1200 / r**1.1))]
    random.Random(1).shuffle(keys)
    p = profile_of(spark, keys)
    assert p.label == "zipf" and 0.9 <= p.theta <= 1.3 and p.fit >= 0.95


def test_uniform_trace(spark):
    p = profile_of(spark, [k * 10 for _ in range(20) for k in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7)])
    assert (p.label, p.top10_mass, p.entropy, p.theta) == ("uniform", 0.1, 1.0, None)


def test_drift_of_a_trace_with_itself_and_with_another(spark):
    a = trace_of(spark, [1, 1, 2, 3]).drop("trace_id")
    b = trace_of(spark, [7, 8, 9, 9]).drop("trace_id")
    same, other = traces.drift(a, a).first(), traces.drift(a, b).first()
    assert (same.total_variation, same.jensen_shannon, same.hot_jaccard, same.drifted) == (0.0, 0.0, 1.0, False)
    assert (other.total_variation, other.jensen_shannon, other.hot_jaccard, other.drifted) == (1.0, 1.0, 0.0, True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=30), st.lists(st.integers(0, 6), min_size=2, max_size=30))
def test_drift_is_bounded_and_symmetric(spark, x, y):
    a, b = (trace_of(spark, k).drop("trace_id") for k in (x, y))
    one, two = traces.drift(a, b).first(), traces.drift(b, a).first()
    assert 0 <= one.total_variation <= 1 and 0 <= one.jensen_shannon <= 1
    assert (one.total_variation, one.jensen_shannon, one.hot_jaccard) == (two.total_variation, two.jensen_shannon, two.hot_jaccard)


def test_windows_are_complete_and_overlap(spark):
    got = traces.windowed(trace_of(spark, range(10)), 4, 3).groupBy("window_idx").agg(F.sort_array(F.collect_list("pos")).alias("p")).orderBy("window_idx").collect()
    assert [r.p for r in got] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert traces.windowed(trace_of(spark, range(3)), 4).count() == 0


RECORDS = [(0, 1, 30, "alpha"), (1, 2, 30, "alpha"), (2, 3, 30, "alpine"), (3, 4, 40, "beta")]


def test_record_lookups(spark):
    r = spark.createDataFrame(RECORDS, "slot long, id long, age long, name string")
    ids = lambda d: [x.id for x in d.collect()]
    assert ids(access.range_scan(r, "age", 30, 30, "slot")) == [1, 2, 3] and ids(access.range_scan(r, "age", 40, 30, "slot")) == []
    assert ids(access.prefix_search(r, "name", "al", "slot")) == [1, 2, 3] and ids(access.prefix_search(r, "name", "al", "slot", 2)) == [1, 2]
    assert ids(access.prefix_search(r, "name", "", "slot")) == [1, 2, 3, 4] and ids(access.prefix_search(r, "name", "al", "slot", 0)) == []
    assert ids(access.point_lookup(r, "age", 30, "slot")) == [3] and ids(access.point_lookup(r, "age", 31, "slot")) == []
    assert sorted(ids(access.point_lookup_all(r, "age", "slot"))) == [3, 4]
    assert ids(access.filter_all(r, "age", "id", 30, 30).orderBy("id")) == [1, 2, 3]


def test_replayed_mutations_equal_a_list(spark):
    rng, live, log = random.Random(4), {}, []
    for seq in range(60):
        kind = rng.choice(["insert", "update", "delete"]) if live else "insert"
        slot = len({s for s, *_ in log}) if kind == "insert" else rng.choice(sorted(live))
        value = rng.randrange(100)
        log.append((slot, seq, kind, value))
        live.pop(slot, None) if kind == "delete" else live.__setitem__(slot, value)
    df = spark.createDataFrame(log, "slot long, seq long, kind string, value long")
    assert {r.slot: r.value for r in mutations.replay(df, "slot", "seq", "kind").collect()} == live


def test_inserts_never_reuse_slots(spark):
    r = spark.createDataFrame([(0, "a"), (1, "b")], "slot long, v string")
    left = mutations.delete(r, spark.createDataFrame([(1,)], "slot long"), "slot")
    got = mutations.insert(left, spark.createDataFrame([("7",)], "v string"), "slot", 1, "v")
    assert sorted(tuple(x) for x in got.collect()) == [(0, "a"), (2, "7")]


def test_bitmaps(spark):
    rows = [("a", i) for i in (0, 1, 32767, 32768, 32769, 70000)] + [("b", i) for i in (1, 32768, 5)]
    posted = bitmaps.postings(spark.createDataFrame(rows, "c string, i long"), "c", "i")
    ids = lambda d: sorted(r.id for r in bitmaps.materialise(d).collect())
    assert ids(bitmaps.intersection(posted, "c")) == [1, 32768] and ids(bitmaps.union(posted)) == [0, 1, 5, 32767, 32768, 32769, 70000]


def test_breadth_first_order(spark):
    g = graph.build(spark.createDataFrame([(0, 2), (0, 1), (2, 3), (1, 5), (1, 4), (2, 4), (3, 3)], "src long, dst long"))
    got = [(r.node, r.depth) for r in graph.bfs(g, 0).orderBy("visit_rank").collect()]
    assert got == [(0, 0), (1, 1), (2, 1), (4, 2), (5, 2), (3, 2)]
    assert graph.bfs(g, 0, 1).count() == 3
    with pytest.raises(Exception, match="node out of range"):
        graph.build(spark.createDataFrame([(0, 9)], "src long, dst long"), node_count=5).collect()


def test_held_out_hand_values(spark):
    rows = [("w1", "a", 1.0, 1.0), ("w1", "b", 2.0, 3.0), ("w1", "c", 3.0, 2.0), ("w2", "a", 1.0, 4.0), ("w2", "b", 2.0, 2.0), ("w2", "c", 3.0, 6.0)]
    points = spark.createDataFrame(rows, "w string, label string, predicted double, measured double")
    got = stats.held_out(points, "w", "label", 2).first()
    assert (got.hit_rate, got.mean_regret, got.median_regret, got.mean_recall) == (0.5, 1.0, 1.0, 0.75)


def test_correlations_guard_constant_columns(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0)], "label string, predicted double, measured double").withColumn("w", F.lit(1))
    assert stats.correlations(points, ["w"]).first().spearman is None
    assert stats.kendall(points, ["w"], "label").first().kendall is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_holm_is_monotone(spark, ps):
    t = spark.createDataFrame([(0, str(i), p) for i, p in enumerate(ps)], "f int, label string, p double")
    got = sorted(stats.holm(t, ["f"], "label", "p").collect(), key=lambda r: (r.p, r.label))
    assert [r.adjusted for r in got] == sorted(r.adjusted for r in got) and all(r.adjusted <= 1 for r in got)
    assert [r.rejected for r in got] == sorted((r.rejected for r in got), reverse=True)


@pytest.mark.parametrize("wins, losses", [(0, 0), (5, 0), (3, 7), (40, 2), (1500, 1600)])
def test_sign_test(wins, losses):
    n = wins + losses
    want = None if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n)
    got = stats._sign(wins, losses)
    assert got is None if want is None else math.isclose(got, want, rel_tol=1e-9)


def test_pareto_front_is_not_dominated(spark):
    w = synthesis.commerce()
    ranked = synthesis.rank(w, synthesis.enumerate_candidates(spark, w, synthesis.options(spark, w)))
    cost = lambda r: (r.latency_us, r.memory_mb, r.update_us, r.build_ms)
    all_, front = [r for r in ranked.collect() if r.feasible], synthesis.pareto(ranked).collect()
    for r in all_:
        beaten = any(all(x <= y for x, y in zip(cost(o), cost(r))) and cost(o) != cost(r) for o in all_)
        assert beaten == (r.candidate_id not in {f.candidate_id for f in front})


def test_workloads_are_validated_and_unserved_queries_stop(spark):
    with pytest.raises(ValueError):
        synthesis.Workload(10, {"a": ("int", None)}, [synthesis.Query("point", 1.0, "b")])
    w = synthesis.Workload(10, {"a": ("int", 5)}, [synthesis.Query("prefix", 1.0, "a")])
    assert synthesis.enumerate_candidates(spark, w, synthesis.options(spark, w)).count() == 0


def test_policies_by_hand(spark):
    rows = [("s", p, d, 10, c) for p, costs in enumerate([(1.0, 5.0), (9.0, 1.0), (1.0, 2.0)]) for d, c in zip("ab", costs)]
    costs = spark.createDataFrame(rows, "scenario string, phase int, design string, queries long, per_query double")
    run = lambda *a, **k: {r.policy: (r.total, r.regret, r.switches, r.path) for r in adaptation.policy_costs(costs, "a", *a, **k).collect()}
    got = run(15.0)
    assert got == {"NEVER": (110.0, 55.0, 0, "a>a>a"), "IMMEDIATE": (60.0, 5.0, 2, "a>b>a"), "TRANSITION_AWARE": (55.0, 0.0, 1, "a>b>b"), "OFFLINE_ORACLE": (55.0, 0.0, 1, "a>b>b")}
    assert run(49.0)["TRANSITION_AWARE"][3] == "a>a>a" and run(49.0, cost_weight=1.0)["TRANSITION_AWARE"][3] == "a>b>b"  # 80 against 1.5 * 49 * 1.1
    pairs = {("a", "b"): 15.0, ("b", "a"): 1.0}
    assert run(pairs)["TRANSITION_AWARE"][3] == "a>b>a" and run(pairs, cooldown=1)["TRANSITION_AWARE"][3] == "a>b>b"
    assert run(pairs)["OFFLINE_ORACLE"][0] == 46.0


def test_recommendations_that_changed_are_made_anew(spark):
    flags = "blocked boolean, candidate_changed boolean, route_changed boolean, drifted boolean, distribution_changed boolean"
    rows = [(True, True, True, True, True), (False, True, False, False, False), (False, False, True, False, False), (False, False, False, True, False), (False, False, False, False, True), (False, False, False, False, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {flags}")
    assert [r.action for r in evaluation.watch_action(df).orderBy("i").collect()] == ["BLOCKED", "RESYNTHESIZE", "RESYNTHESIZE", "REMEASURE", "REMEASURE", "KEEP"]
    assert [r.freshness for r in evaluation.freshness(df).orderBy("i").collect()] == ["BLOCKED", "SUPERSEDED", "SUPERSEDED", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "CURRENT"]
    entries = spark.createDataFrame([("a", True, "x"), ("a", False, "x"), ("b", True, "x"), ("c", True, "x"), ("c", True, "x"), ("d", True, "x"), ("d", True, "y")], "c string, ok boolean, s string")
    assert {r.c: r.state for r in evaluation.campaign_state(entries, ["c"], "ok", "s", 2).collect()} == {"a": "incomplete_or_failed", "b": "partial", "c": "complete:x", "d": "mixed"}


def test_paths_are_normalised(spark):
    rows = [("/a//12/x", "/a/:int/x"), ("", "/"), ("/" + "f" * 64, "/:sha256"), ("/0b0c0d0e-1111-2222-3333-444455556666/", "/:uuid"), ("/" + "z" * 81, "/:opaque"), ("/" + "9" * 21, "/" + "9" * 21)]
    df = spark.createDataFrame(rows, "p string, want string")
    assert df.where(stats.normalised_path(F.col("p")) != F.col("want")).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=40))
def test_kendall_and_quantiles_against_all_pairs(spark, xy):
    points = spark.createDataFrame([("w", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "w string, label int, predicted double, measured double")
    sign = lambda a: (a > 0) - (a < 0)
    s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(xy) for b in xy[:i]]
    c, d = sum(x * y > 0 for x, y in s), sum(x * y < 0 for x, y in s)
    below = math.sqrt((c + d + sum(x == 0 and y != 0 for x, y in s)) * (c + d + sum(x != 0 and y == 0 for x, y in s)))
    assert stats.kendall(points, ["w"], "label").first().kendall == (round((c - d) / below, 8) if below else None)
    got = ordered.quantiles(points, ["w"], "predicted", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    v, at = sorted(x for x, _ in xy), 0.37 * (len(xy) - 1)
    assert math.isclose(got.b, v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)), abs_tol=1e-9) and (got.a, got.c) == (v[0], v[-1])
    rng = random.Random(len(xy))
    y = [rng.randrange(50) for _ in range(300)]
    assert stats._inversions(np.array(y)) == sum(a > b for i, a in enumerate(y) for b in y[i:])


def test_stable_threshold(spark):
    rows = [(1, 0.99, 1.0), (2, 0.9, 0.95), (3, 0.9, 0.99), (4, 0.9, 1.0), (5, 0.8, 1.1)]
    t = spark.createDataFrame([("f", *r) for r in rows] + [("g", 1, 0.5, 0.5)], "family string, scale int, median_ratio double, worst_ratio double")
    assert {r.family: r.threshold for r in calibration.stable_threshold(t, ["family"], "scale").collect()} == {"f": 2, "g": None}


def test_ledger(spark):
    import hashlib

    entries, previous = [], integrity.ZEROS
    for i in range(6):
        h = hashlib.sha256("\n".join([previous, f"t{i}", "k", "s", "{}"]).encode()).hexdigest()
        entries.append((i, f"t{i}", "k", "s", "{}", previous, h))
        previous = h
    schema = "sequence long, timestamp string, kind string, subject string, payload string, previous_hash string, entry_hash string"
    assert integrity.ledger_verdict(spark.createDataFrame(entries, schema)).first().first_break is None
    first = integrity.ledger_append(spark.createDataFrame([("l", *e[:5]) for e in entries[:2]], "l string, sequence long, timestamp string, kind string, subject string, payload string"), ["l"])
    last = first.where("sequence = 1").select("l", "entry_hash")
    more = integrity.ledger_append(spark.createDataFrame([("l", *e[:5]) for e in entries[2:]], "l string, sequence long, timestamp string, kind string, subject string, payload string"), ["l"], last)
    assert sorted(tuple(r)[1:] for r in first.unionByName(more).collect()) == entries
    entries[3] = (*entries[3][:4], "{1}", *entries[3][5:])
    assert integrity.ledger_verdict(spark.createDataFrame(entries, schema)).first().first_break == 3


@pytest.mark.parametrize(
    "text, format, keys",
    [
        ("1, 2, 2\n3 4", "text", [1, 2, 2, 3, 4]),
        ("timestamp,key,latency_us\n1,7,3\n2,+8,4\n", "csv", [7, 8]),
        ("key\n5\n6\n", "csv", [5, 6]),
        ('{"events":[{"request":{"key":9}},{"request":{"key":3.0}}]}', "json", [9, 3]),
        ("[4, 5, 4]", "json", [4, 5, 4]),
        ('[{"id": 1, "x": 2}, {"id": 3}]', "json", [1, 3]),
    ],
)
def test_trace_intake(spark, tmp_path, text, format, keys):
    (tmp_path / "t").write_text(text)
    path = str(tmp_path / "t")
    assert intake.detect_format(text) == format
    good, bad = intake.read_trace(spark, path, key_field="request.key" if "request" in text else None)
    assert [r.key for r in good.orderBy("pos").collect()] == keys and bad.count() == 0


def test_several_files_are_one_trace(spark, tmp_path):
    parts = {"text": ["1 2 3\n", "4\n\n5 6"], "csv": ["key,x\n7,1\n8,1\n", "key,x\n\n9,1\n"], "json": ["[1, 2]", "[3, 4]"]}
    for format, texts in parts.items():
        (tmp_path / format).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / format / f"part{i}").write_text(text)
        good, bad = intake.read_trace(spark, str(tmp_path / format))
        keys = {"text": [1, 2, 3, 4, 5, 6], "csv": [7, 8, 9], "json": [1, 2, 3, 4]}[format]
        assert [(r.pos, r.key) for r in good.orderBy("pos").collect()] == list(enumerate(keys)) and bad.count() == 0


def test_trace_intake_refuses(spark, tmp_path):
    for name, text in (("a", "1 2 x 3"), ("b", "id,item_id\n1,2\n3,4\n"), ("c", '[1, {"key": 2}]'), ("d", "5"), ("e", "9007199254740993 1")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            intake.read_trace(spark, str(tmp_path / name), format={"a": "text", "d": "text", "e": "text"}.get(name))
    good, bad = intake.read_trace(spark, str(tmp_path / "a"), format="text", allow_invalid=True)
    assert [(r.pos, r.key) for r in good.orderBy("pos").collect()] == [(0, 1), (1, 2), (2, 3)] and [r.raw for r in bad.collect()] == ["x"]


def test_sign_flips_of_large_groups(spark):
    values = [("far", 1.0 + k % 3) for k in range(60)] + [("even", float(k % 2 * 2 - 1)) for k in range(40)] + [("edge", x / 10) for x in range(-7, 14)]
    values += [("small", 1.0)] * 4 + [(None, 1.0)] * 21 + [("none", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.p_value for r in stats.sign_flip(df, ["g"], "v").collect()}
    counts = {0: 1}  # exact distribution of the signed sums of "edge", in tenths
    for x in range(-7, 14):
        nxt = {}
        for s, n in counts.items():
            for y in (s + x, s - x):
                nxt[y] = nxt.get(y, 0) + n
        counts = nxt
    edge = sum(n for s, n in counts.items() if s >= sum(range(-7, 14))) / 2**21
    assert got["far"] == got[None] == round(1 / 2001, 8) and abs(got["even"] - 0.563) < 0.05 and abs(got["edge"] - edge) < 0.05
    assert got["small"] == 0.0625 and got["none"] is None and len(got) == 6
    again = stats.sign_flip(df.repartition(7), ["g"], "v").collect()
    assert {r.g: r.p_value for r in again} == got


def test_verifiers_and_pairs_of_every_quantity(spark, sf_dir):
    from pyspark.sql import Window

    from tracewright import catalogue, registry

    catalogue.load()
    lines = registry.table(spark, sf_dir, "lineitem")
    pairs = registry.QUERIES["complete_pairs_whole"](spark, sf_dir)
    assert pairs.where("l_quantity <> 7").count() > 0 and registry.QUERIES["complete_pairs"](spark, sf_dir).count() > 0
    counted = registry.QUERIES["shared_verifiers_whole"](spark, sf_dir)
    own = lines.where("l_quantity <> 11").select("l_returnflag", "l_suppkey", "l_orderkey").distinct().withColumn("c", F.count("*").over(Window.partitionBy("l_returnflag", "l_suppkey"))).where("c > 1")
    assert own.count() > 0 and own.join(counted, ["l_returnflag", "l_suppkey"], "left_anti").count() == 0


def test_artifacts_and_samples(spark, tmp_path):
    store = str(tmp_path / "artifacts")
    artifacts.store(spark.createDataFrame([("a",), ("b",), ("a",)], "content string"), store)
    artifacts.store(spark.createDataFrame([("b",), ("c",)], "content string"), store)
    there = spark.read.parquet(store)
    assert sorted(r.content for r in there.collect()) == ["a", "b", "c"] and artifacts.corrupted(there).count() == 0
    done = spark.createDataFrame([("done",)], "state string")
    assert sorted(r.size_bytes for r in artifacts.inventory(there, done).collect()) == [1, 1, 1]
    for stored, state in ((there, "PENDING"), (there.withColumn("content", F.upper("content")), "done")):
        with pytest.raises(ValueError):
            artifacts.inventory(stored, spark.createDataFrame([(state,)], "state string"))
    sample = dict(sample_id="1", condition_id="c", workload_id="w", repetition_index=0, metric="m", value=1.5, measurement_source="s", protocol_id="p", machine_fingerprint="f")
    (tmp_path / "s.jsonl").write_text(json.dumps(sample) + "\n" + json.dumps(sample | {"sample_id": "2"}))
    assert artifacts.read_samples(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "r.jsonl").write_text(json.dumps(sample) + "\n" + json.dumps(sample))
    with pytest.raises(ValueError):
        artifacts.read_samples(spark, str(tmp_path / "r.jsonl"))
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    identity = artifacts.write_snapshot(df, str(tmp_path / "snap"))
    assert mutations.exclusive(artifacts.read_snapshot(spark, str(tmp_path / "snap"), identity), df).count() == 0
    with pytest.raises(ValueError):
        artifacts.read_snapshot(spark, str(tmp_path / "snap"), "other")


SWEEP = [f"{op},{c},5,{seed},1,{10 * seed + c},7" for op in measurements.SWEEP_OPERATIONS for c in (8, 16) for seed in (1, 2, 3)]


def sweep_file(path, rows, header="operation,cardinality,repetitions,seed,dense_containers,ns_per_op,result_size"):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_sweeps_are_read_and_reduced(spark, tmp_path):
    rows = measurements.read_sweep(spark, sweep_file(tmp_path / "sweep.csv", SWEEP), samples=3)
    found = {(r.cardinality, r.operation): (r.n, r.min, r.max, r.median) for r in calibration.sweep(rows, ["cardinality", "operation"], "ns_per_op").collect()}
    assert found == {(c, op): (3, 10 + c, 30 + c, 20 + c) for c in (8, 16) for op in measurements.SWEEP_OPERATIONS}


@pytest.mark.parametrize(
    "rows",
    [[], SWEEP[1:], SWEEP + SWEEP[:1], SWEEP[:-1] + ["union,16,5,3,1,-1,7"], SWEEP[:-1] + ["union,16,5,3,1,NaN,7"], SWEEP[:-1] + ["union,16,6,3,1,46,7"], SWEEP[:-1] + ["merge,16,5,3,1,46,7"], SWEEP[:-1] + ["union,16,5,x,1,46,7"], SWEEP[:-1] + ["union,16,5,3"]],
)
def test_broken_sweeps_raise(spark, tmp_path, rows):
    with pytest.raises(ValueError):
        measurements.read_sweep(spark, sweep_file(tmp_path / "sweep.csv", rows))


def test_sweeps_need_their_fields_and_samples(spark, tmp_path):
    with pytest.raises(ValueError):
        measurements.read_sweep(spark, sweep_file(tmp_path / "a.csv", SWEEP, "operation,cardinality,repetitions,seed,dense_containers,ns,result_size"))
    with pytest.raises(ValueError):
        measurements.read_sweep(spark, sweep_file(tmp_path / "b.csv", SWEEP), samples=4)


def test_calibration_profiles(spark, tmp_path):
    one = {"primitive": "tree", "operation": "point", "ns_per_op": 12.5, "repetitions": 2, "samples_ns": [12.0, 13.0], "access_distribution": {"kind": "zipf", "exponent": 1.1}}
    two = {"primitive": "tree", "operation": "build", "ns_per_op": 90.0}
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok/a.json").write_text(json.dumps({"seed": 7, "n": 100, "measurements": [one, two]}, indent=1))
    (tmp_path / "ok/b.json").write_text(json.dumps({"profile_id": "p", "measurements": [one | {"ns_per_op": 11.0, "access_distribution": {"exponent": 1.1, "kind": "zipf"}}]}))
    rows = measurements.read_profiles(spark, str(tmp_path / "ok"))
    assert sorted((r.profile_id, r.record_count, r.operation, r.repetitions) for r in rows.collect()) == [("p", 0, "point", 2), ("smoke-7-100", 100, "build", 1), ("smoke-7-100", 100, "point", 2)]
    best = calibration.best_match(rows.where("operation = 'point'"), rows).collect()
    assert [(r.ns_per_op, json.loads(r.distribution)) for r in best] == [(11.0, {"exponent": "1.1", "kind": "zipf"})]
    for i, broken in enumerate(([], [two | {"access_distribution": {"kind": "zipf"}}], [one | {"samples_ns": [1.0]}], [two | {"ns_per_op": 0}], [two | {"implementation_id": "a b"}], [two | {"operation": None}])):
        (tmp_path / f"{i}.json").write_text(json.dumps({"measurements": broken}))
        with pytest.raises(ValueError):
            measurements.read_profiles(spark, str(tmp_path / f"{i}.json"))
