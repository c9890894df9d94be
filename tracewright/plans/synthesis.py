"""Design synthesis: which index serves each query of a workload, at what predicted cost, within which limits.

A workload is a small driver-side document; candidates are rows. Everything after the document is one plan: capability join,
costs as expressions, an enumeration by joins on the query index, constraints as filters and Pareto dominance as an anti-join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query

# Primitive, capabilities with base latency in microseconds, bytes a record, build ns a record, update microseconds.
PRIMITIVES = [
    ("robin_hood_hash", {"point": 0.09, "insert": 0.16, "update": 0.17, "delete": 0.18}, 36.0, 52.0, 0.17),
    ("sorted_array", {"point": 0.28, "range": 0.24}, 20.0, 115.0, 8.0),
    ("ordered_tree", {"point": 0.45, "range": 0.35, "insert": 0.62, "update": 0.68, "delete": 0.73}, 52.0, 180.0, 0.68),
    ("radix_trie", {"prefix": 0.22, "point": 0.31}, 46.0, 145.0, 0.75),
    ("bitmap", {"filter": 0.11}, 2.5, 36.0, 0.24),
    ("csr_graph", {"graph": 0.42}, 16.0, 125.0, 50.0),
]
MUTATIONS = ("insert", "update", "delete")
STRING_TYPES = ("str", "string", "text", "char")
EXHAUSTIVE_LIMIT, BEAM, PARETO_LIMIT = 4096, 128, 64


@dataclass
class Query:
    kind: str
    weight: float
    field: str | None = None
    selectivity: float | None = None
    prefix_length: int | None = None
    distribution: str = "uniform"


@dataclass
class Workload:
    """A validated document: positive weights, known fields, fields where the kind needs one."""

    record_count: int
    fields: dict[str, tuple[str, int | None]]  # type and cardinality
    queries: list[Query]
    max_memory_mb: float | None = None
    max_latency_us: float | None = None
    max_build_ms: float | None = None
    update_rate: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: {"latency": 1.0, "memory": 0.15, "update": 0.2, "build": 0.05})

    def __post_init__(self) -> None:
        if not 1 <= self.record_count <= 10**9 or not 1 <= len(self.fields) <= 64 or not 1 <= len(self.queries) <= 32:
            raise ValueError("record, field or query count out of range")
        for q in self.queries:
            if not (q.weight > 0 and math.isfinite(q.weight)):
                raise ValueError("weights must be finite and above 0")
            if q.kind in ("point", "range", "filter", "prefix") and q.field not in self.fields:
                raise ValueError(f"{q.kind} needs a known field")
            if q.selectivity is None and q.kind in ("range", "filter"):
                q.selectivity = 0.05


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [(name, kind, base, size, build, update) for name, kinds, size, build, update in PRIMITIVES for kind, base in kinds.items()]
    return spark.createDataFrame(rows, "primitive string, kind string, base double, bytes_per_record double, build_ns double, update_us double")


def query_rows(spark: SparkSession, workload: Workload) -> DataFrame:
    rows = [
        (i, q.kind, q.field, (workload.fields.get(q.field) or ("", None))[0], (workload.fields.get(q.field) or ("", None))[1], q.weight, q.selectivity, q.prefix_length, q.distribution)
        for i, q in enumerate(workload.queries)
    ]
    schema = "query_index int, kind string, field string, type string, cardinality long, weight double, selectivity double, prefix_length int, distribution string"
    return spark.createDataFrame(rows, schema)


def latency(records: int) -> Column:
    """Predicted microseconds a query, by primitive; columns base, primitive, kind, selectivity, prefix_length."""
    n = max(records, 2)
    log = F.lit(max(math.log2(n) / 20, 0.25))
    s = F.coalesce("selectivity", F.lit(0.01))
    base, ranged = F.col("base"), F.when(F.col("kind") == "range", s * n).otherwise(0.0)
    return (
        F.when(F.col("primitive") == "robin_hood_hash", base * (1 + 0.02 * log))
        .when(F.col("primitive") == "ordered_tree", base * log + ranged * 4e-5)
        .when(F.col("primitive") == "sorted_array", base * log + ranged * 2.5e-5)
        .when(F.col("primitive") == "radix_trie", base * F.greatest(F.coalesce("prefix_length", F.lit(4)) / 4, F.lit(0.5)))
        .when(F.col("primitive") == "bitmap", base + s * n * 1.2e-5)
        .otherwise(base * max(math.sqrt(n) / 300, 1))
    )


def options(spark: SparkSession, workload: Workload, calibration: DataFrame | None = None) -> DataFrame:
    """Rows (query_index, primitive, costs): what may serve each query. A trie needs a string-like field; a bitmap a cardinality
    of at most max(100,000, records // 3). Measured latency (primitive, operation, distribution, ns_per_op, stdev_ns at this
    record count) replaces the prior where there is one."""
    rows = query_rows(spark, workload).join(F.broadcast(capabilities(spark)), "kind")  # fixed 15 rows
    stringy = F.lit(False)
    for t in STRING_TYPES:
        stringy |= F.contains(F.lower("type"), F.lit(t))
    fits = ((F.col("primitive") != "radix_trie") | stringy) & (
        (F.col("primitive") != "bitmap") | F.col("cardinality").isNull() | (F.col("cardinality") <= max(100_000, workload.record_count // 3))
    )
    out = rows.where(fits).withColumns({"latency_us": latency(workload.record_count), "uncertainty": F.when(F.col("distribution") == "uniform", 0.5).otherwise(0.8), "source": F.lit("prior")})
    if calibration is not None:
        measured = calibration.select("primitive", F.col("operation").alias("kind"), "distribution", (F.col("ns_per_op") / 1000).alias("_us"), F.coalesce(F.least(F.lit(0.6), F.greatest(F.lit(0.08), 2 * F.col("stdev_ns") / F.col("ns_per_op"))), F.lit(0.2)).alias("_u"))
        out = out.join(measured, ["primitive", "kind", "distribution"], "left")
        out = out.withColumns({"latency_us": F.coalesce("_us", "latency_us"), "uncertainty": F.coalesce("_u", "uncertainty"), "source": F.when(F.col("_us").isNotNull(), "calibrated").otherwise(F.col("source"))}).drop("_us", "_u")
    return out


def _prefix_cost(workload: Workload) -> list[Column]:
    """Beam order: mean latency of the queries chosen so far, far worse over the memory limit, then memory, then the choice."""
    over = F.lit(0.0) if workload.max_memory_mb is None else F.when(F.col("memory_mb") > workload.max_memory_mb, 1e6).otherwise(0.0)
    return [F.col("weighted_us") / F.col("weight") + over, F.col("memory_mb"), F.array_join("choice", "|")]


def enumerate_candidates(spark: SparkSession, workload: Workload, choices: DataFrame, strategy: str = "auto", beam: int = BEAM) -> DataFrame:
    """Combinations of one option a query. ``exhaustive`` joins them all; ``beam`` and ``greedy`` keep the best prefixes of each of
    the at most 32 steps; ``auto`` is exhaustive up to 4,096 combinations."""
    per = {r.query_index: r["count"] for r in choices.groupBy("query_index").count().collect()}
    if any(i not in per for i in range(len(workload.queries))):
        return spark.createDataFrame([], "choice array<string>, weighted_us double, weight double, memory_mb double, build_ms double, update_us double, uncertainty double, sources array<string>")
    if strategy == "auto":
        strategy = "exhaustive" if math.prod(per.values()) <= EXHAUSTIVE_LIMIT else "beam"
    width = {"exhaustive": None, "beam": beam, "greedy": 1}[strategy]
    n = workload.record_count
    serves = ~F.col("kind").isin(*MUTATIONS)
    step = choices.select(
        "query_index", F.concat(F.col("query_index").cast("string"), F.lit(":"), "primitive").alias("_c"), (F.col("latency_us") * F.col("weight")).alias("_l"), F.col("weight").alias("_w"),
        F.when(serves, F.col("bytes_per_record") * n / 2**20).otherwise(0.0).alias("_m"), F.when(serves, F.col("build_ns") * n / 1e6).otherwise(0.0).alias("_b"),
        F.when(serves, F.col("update_us")).otherwise(0.0).alias("_u"), F.col("uncertainty").alias("_e"), F.col("source").alias("_s"),
    )
    got = None
    for i in sorted(per):
        here = step.where(F.col("query_index") == i).drop("query_index")
        if got is None:
            got = here.select(F.array("_c").alias("choice"), F.col("_l").alias("weighted_us"), F.col("_w").alias("weight"), F.col("_m").alias("memory_mb"), F.col("_b").alias("build_ms"), F.col("_u").alias("update_us"), F.col("_e").alias("uncertainty"), F.array("_s").alias("sources"))
        else:  # at most 6 options of one query
            met = got.crossJoin(F.broadcast(here))
            got = met.select(F.concat("choice", F.array("_c")).alias("choice"), *[(F.col(a) + F.col(b)).alias(a) for a, b in (("weighted_us", "_l"), ("weight", "_w"), ("memory_mb", "_m"), ("build_ms", "_b"), ("update_us", "_u"))], F.greatest("uncertainty", "_e").alias("uncertainty"), F.concat("sources", F.array("_s")).alias("sources"))
        if width:
            got = got.orderBy(*_prefix_cost(workload)).limit(width)
    return got


def rank(workload: Workload, found: DataFrame) -> DataFrame:
    """Costs, limits, score and id of each candidate, ordered by (not feasible, score, memory, id)."""
    limit = lambda value, column: F.lit(value) if value else F.greatest(F.lit(1.0), F.col(column))
    w = workload.weights
    out = found.withColumn("latency_us", F.col("weighted_us") / F.col("weight"))
    broken = [
        F.when(F.col(c) > v, f"{c} > {v}") if v is not None else F.lit(None).cast("string")
        for c, v in (("memory_mb", workload.max_memory_mb), ("latency_us", workload.max_latency_us), ("build_ms", workload.max_build_ms))
    ]
    score = (
        w["latency"] * F.col("latency_us") + w["memory"] * F.col("memory_mb") / limit(workload.max_memory_mb, "memory_mb")
        + w["update"] * F.col("update_us") * math.log10(1 + workload.update_rate) + w["build"] * F.col("build_ms") / limit(workload.max_build_ms, "build_ms")
    )
    out = out.withColumns({"rejections": F.filter(F.array(*broken), lambda x: x.isNotNull()), "_score": score})
    ranked = out.select(
        F.substring(F.sha2(F.array_join("choice", "|"), 256), 1, 12).alias("candidate_id"), F.array_join("choice", "|").alias("choice"), *[F.round(c, 6).alias(c) for c in ("latency_us", "memory_mb", "update_us", "build_ms")],
        F.round("_score", 9).alias("score"), F.round("uncertainty", 4).alias("uncertainty"), (F.size("rejections") == 0).alias("feasible"), F.array_join("rejections", "; ").alias("rejections"),
        F.when(F.forall("sources", lambda x: x == "prior"), "prior").when(F.forall("sources", lambda x: x == "calibrated"), "calibrated").otherwise("mixed").alias("evidence"),
    )
    return ranked.orderBy(~F.col("feasible"), "score", "memory_mb", "candidate_id")


def pareto(candidates: DataFrame, costs: tuple[str, ...] = ("latency_us", "memory_mb", "update_us", "build_ms"), limit: int = PARETO_LIMIT) -> DataFrame:
    """Feasible candidates that no other matches on all costs and beats on one; the first ``limit`` by score. Candidates that agree in
    all costs dominate alike, so dominators are distinct cost vectors."""
    feasible = candidates.where("feasible")
    others = feasible.select(*[F.col(c).alias(f"_{c}") for c in costs]).distinct()
    no_worse, better = F.lit(True), F.lit(False)
    for c in costs:
        no_worse &= F.col(f"_{c}") <= F.col(c)
        better |= F.col(f"_{c}") < F.col(c)
    return feasible.join(others, no_worse & better, "left_anti").orderBy("score", "latency_us", "memory_mb", "candidate_id").limit(limit)


def ambiguous(ranked: DataFrame) -> DataFrame:
    """Feasible candidates whose score interval, score * (1 +- uncertainty), reaches below the winner's upper end."""
    winner = ranked.where("feasible").orderBy("score", "memory_mb", "candidate_id").limit(1).select((F.col("score") * (1 + F.col("uncertainty"))).alias("_upper"))
    low = F.greatest(F.lit(0.0), F.col("score") * (1 - F.col("uncertainty")))
    return ranked.where("feasible").crossJoin(F.broadcast(winner)).select("candidate_id", "score", F.round(low, 9).alias("lower"), F.round(F.col("score") * (1 + F.col("uncertainty")), 9).alias("upper"), (low <= F.col("_upper")).alias("ambiguous"))  # one row


def measurement_targets(ranked: DataFrame, queries: DataFrame, top: int = 12) -> DataFrame:
    """What to measure first: each (primitive, operation) of the ambiguous candidates by the largest uncertainty / (1 + gap to the winner's score), and
    0.25 more where a cost is a prior; with the number of candidates that it decides."""
    open_ = ambiguous(ranked).where("ambiguous").select("candidate_id")
    winner = ranked.where("feasible").orderBy("score", "memory_mb", "candidate_id").limit(1).select(F.col("score").alias("_w"))
    met = ranked.join(open_, "candidate_id", "left_semi").crossJoin(F.broadcast(winner))  # one row
    close = F.col("uncertainty") / (1 + F.greatest(F.lit(0.0), F.col("score") - F.col("_w")))
    parts = met.select("candidate_id", close.alias("_c"), (F.col("evidence") != "calibrated").alias("_p"), F.explode(F.split("choice", r"\|")).alias("a"))
    placed = parts.select("*", F.split_part("a", F.lit(":"), F.lit(1)).cast("int").alias("query_index"), F.split_part("a", F.lit(":"), F.lit(2)).alias("primitive"))
    named = placed.join(F.broadcast(queries.select("query_index", F.col("kind").alias("operation"))), "query_index")  # 32 rows at most
    priority = F.max("_c") + F.when(F.max("_p"), 0.25).otherwise(0.0)
    return named.groupBy("primitive", "operation").agg(F.countDistinct("candidate_id").alias("candidates"), F.round(priority, 6).alias("priority")).orderBy(F.desc("priority"), "primitive", "operation").limit(top)


def measured_choice(candidates: DataFrame, measured: DataFrame) -> DataFrame:
    """The candidate with the least measured latency; ties by id."""
    both = candidates.join(measured, "candidate_id")
    return both.agg(F.min_by(F.struct("candidate_id", "measured"), F.struct("measured", "candidate_id")).alias("_w")).select("_w.*")


def experiment_matrix(spark: SparkSession, study: str, axes: dict[str, list], limit: int = 100_000) -> DataFrame:
    """A row a combination of axis values, with an id made from them."""
    if math.prod(len(v) for v in axes.values()) > limit:
        raise ValueError(f"more than {limit} experiments")
    out = spark.createDataFrame([(study,)], "study string")
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(str(v),) for v in values], f"`{name}` string"))  # bounded by the check above
    return out.withColumn("experiment_id", F.substring(F.sha2(F.concat_ws("|", "study", *[F.concat(F.lit(f"{a}="), F.col(a)) for a in sorted(axes)]), 256), 1, 16))


def fingerprint(queries: DataFrame) -> DataFrame:
    """Share of the weight by kind, distribution and field, each with whether it is the dominant one (first inserted wins ties)."""
    total = queries.agg(F.sum("weight").alias("_t"))
    each = queries.select("query_index", "weight", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(c, F.lit("-")).alias("item")) for c in ("kind", "distribution", "field")])).alias("x"))
    sums = each.groupBy("x.part", "x.item").agg(F.sum("weight").alias("_w"), F.min("query_index").alias("_first")).crossJoin(F.broadcast(total))  # one row
    best = sums.groupBy("part").agg(F.max_by("item", F.struct("_w", -F.col("_first"))).alias("_best"))
    return sums.join(best, "part").select("part", "item", F.round(F.col("_w") / F.col("_t"), 8).alias("share"), (F.col("item") == F.col("_best")).alias("dominant"))


def coverage(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """Per primitive the share of the workload's weight that it can serve, and the kinds it cannot."""
    names = capabilities(spark).select("primitive").distinct()
    served = queries.crossJoin(F.broadcast(names)).join(F.broadcast(capabilities(spark).select("primitive", "kind", F.lit(True).alias("_ok"))), ["primitive", "kind"], "left")  # 6 primitives
    return served.groupBy("primitive").agg(
        F.round(F.sum(F.when(F.col("_ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), 8).alias("supported"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("kind")))), ",").alias("unsupported")
    )


def commerce() -> Workload:
    """The example: a shop's catalogue of 5,000 products."""
    fields = {"product_id": ("uint64", 5000), "price": ("double", 1200), "category": ("uint32", 32), "title": ("string", 3500)}
    queries = [Query("point", 0.35, "product_id"), Query("range", 0.25, "price", 0.04), Query("filter", 0.20, "category", 0.03125), Query("prefix", 0.20, "title", prefix_length=12)]
    return Workload(5000, fields, queries, max_memory_mb=1.0, update_rate=9.0)


_VALUES = ", ".join(f"('{n}', '{k}', {b}, {s}, {c}, {u})" for n, kinds, s, c, u in PRIMITIVES for k, b in kinds.items())
_QUERIES = "(0, 'point', 'product_id', 0.35, NULL, NULL), (1, 'range', 'price', 0.25, 0.04, NULL), (2, 'filter', 'category', 0.20, 0.03125, NULL), (3, 'prefix', 'title', 0.20, NULL, 12)"
_OPTIONS = f"""c(primitive, kind, base, size, build, upd) AS (VALUES {_VALUES}), q(i, kind, field, weight, s, p) AS (VALUES {_QUERIES}), k AS (SELECT greatest(log2(5000) / 20, 0.25)::DOUBLE AS l),
o AS (SELECT i, primitive, kind, field, weight::DOUBLE AS weight, size::DOUBLE * 5000 / 1048576 AS mem, build::DOUBLE * 5000 / 1e6 AS bld, upd::DOUBLE AS upd, CASE primitive WHEN 'robin_hood_hash' THEN base::DOUBLE * (1 + 0.02 * l)
 WHEN 'ordered_tree' THEN base::DOUBLE * l + CASE WHEN kind = 'range' THEN s::DOUBLE * 5000 * 4e-5 ELSE 0 END WHEN 'sorted_array' THEN base::DOUBLE * l + CASE WHEN kind = 'range' THEN s::DOUBLE * 5000 * 2.5e-5 ELSE 0 END
 WHEN 'radix_trie' THEN base::DOUBLE * greatest(coalesce(p, 4) / 4, 0.5) WHEN 'bitmap' THEN base::DOUBLE + coalesce(s::DOUBLE, 0.01) * 5000 * 1.2e-5 ELSE base::DOUBLE * greatest(sqrt(5000) / 300, 1) END AS us
 FROM q JOIN c USING (kind), k WHERE primitive <> 'radix_trie' OR field = 'title')"""
_RANKED = f"""{_OPTIONS}, x AS (SELECT '0:' || a.primitive || '|1:' || b.primitive || '|2:' || d.primitive || '|3:' || e.primitive AS choice, (a.us * a.weight + b.us * b.weight + d.us * d.weight + e.us * e.weight) / (a.weight + b.weight + d.weight + e.weight) AS lat,
 a.mem + b.mem + d.mem + e.mem AS mem, a.upd + b.upd + d.upd + e.upd AS upd, a.bld + b.bld + d.bld + e.bld AS bld FROM o a, o b, o d, o e WHERE a.i = 0 AND b.i = 1 AND d.i = 2 AND e.i = 3),
r AS (SELECT substr(sha256(choice), 1, 12) AS candidate_id, choice, round(lat, 6) AS latency_us, round(mem, 6) AS memory_mb, round(upd, 6) AS update_us, round(bld, 6) AS build_ms,
 round(lat + 0.15 * mem + 0.2 * upd * log10(10) + 0.05 * bld / greatest(1, bld), 9) AS score, 0.5::DOUBLE AS uncertainty, mem <= 1 AS feasible, CASE WHEN mem > 1 THEN 'memory_mb > 1.0' ELSE '' END AS rejections, 'prior' AS evidence FROM x)"""


def _ranked(spark) -> DataFrame:
    w = commerce()
    return rank(w, enumerate_candidates(spark, w, options(spark, w)))


@query("synthesis_options", f"WITH {_OPTIONS} SELECT i AS query_index, primitive, round(us, 8) AS latency_us FROM o")
def _options_query(spark, sf_dir):
    return options(spark, commerce()).select("query_index", "primitive", F.round("latency_us", 8).alias("latency_us"))


@query("synthesis_candidates", f"WITH {_RANKED} FROM r")
def _candidates_query(spark, sf_dir):
    return _ranked(spark)


@query(
    "synthesis_pareto",
    f"""WITH {_RANKED} SELECT * FROM r WHERE feasible AND NOT EXISTS (SELECT 1 FROM r o WHERE o.feasible AND o.latency_us <= r.latency_us AND o.memory_mb <= r.memory_mb AND o.update_us <= r.update_us AND o.build_ms <= r.build_ms
AND (o.latency_us < r.latency_us OR o.memory_mb < r.memory_mb OR o.update_us < r.update_us OR o.build_ms < r.build_ms))""",
)
def _pareto_query(spark, sf_dir):
    return pareto(_ranked(spark))


_STEP = "SELECT {0}choice || '|{1}:' || primitive AS choice, s.lat + us * weight AS lat, s.w + weight AS w, s.mem + o.mem AS mem, s.upd + o.upd AS upd, s.bld + o.bld AS bld FROM s{2} s, o WHERE i = {1} ORDER BY (s.lat + us * weight) / (s.w + weight) + CASE WHEN s.mem + o.mem > 1 THEN 1e6 ELSE 0 END, s.mem + o.mem, 1 LIMIT 3"
_BEAM = f"{_OPTIONS}, s0 AS (SELECT '0:' || primitive AS choice, us * weight AS lat, weight AS w, mem, upd, bld FROM o WHERE i = 0 ORDER BY us + CASE WHEN mem > 1 THEN 1e6 ELSE 0 END, mem, 1 LIMIT 3), " + ", ".join(f"s{i} AS ({_STEP.format('s.', i, i - 1)})" for i in (1, 2, 3))


@query(
    "synthesis_beam",
    f"""WITH {_BEAM} SELECT substr(sha256(choice), 1, 12) AS candidate_id, choice, round(lat / w, 6) AS latency_us, round(mem, 6) AS memory_mb, round(upd, 6) AS update_us, round(bld, 6) AS build_ms,
 round(lat / w + 0.15 * mem + 0.2 * upd * log10(10) + 0.05 * bld / greatest(1, bld), 9) AS score, 0.5::DOUBLE AS uncertainty, mem <= 1 AS feasible, CASE WHEN mem > 1 THEN 'memory_mb > 1.0' ELSE '' END AS rejections, 'prior' AS evidence FROM s3""",
)
def _beam_query(spark, sf_dir):
    w = commerce()  # 8 combinations, of which a beam of 3 keeps 3
    return rank(w, enumerate_candidates(spark, w, options(spark, w), "beam", 3))


@query("synthesis_greedy", f"WITH {_RANKED} SELECT r.* FROM r ORDER BY latency_us, memory_mb, choice LIMIT 1")
def _greedy_query(spark, sf_dir):
    w = commerce()
    return rank(w, enumerate_candidates(spark, w, options(spark, w), "greedy"))


@query(
    "synthesis_intervals",
    f"WITH {_RANKED}, f AS (FROM r WHERE feasible), w AS (SELECT score * 1.5 AS u FROM f ORDER BY score, memory_mb, candidate_id LIMIT 1) SELECT candidate_id, score, round(greatest(0, score * 0.5), 9) AS lower, round(score * 1.5, 9) AS upper, score * 0.5 <= u AS ambiguous FROM f, w",
)
def _intervals_query(spark, sf_dir):
    return ambiguous(_ranked(spark))


@query(
    "measurement_targets",
    f"""WITH {_RANKED}, f AS (FROM r WHERE feasible), w AS (SELECT score AS s, score * 1.5 AS u FROM f ORDER BY score, memory_mb, candidate_id LIMIT 1), p AS (SELECT candidate_id, 0.5 / (1 + greatest(0, score - s)) AS c, unnest(string_split(choice, '|')) AS a FROM f, w WHERE score * 0.5 <= u)
SELECT split_part(a, ':', 2) AS primitive, q.kind AS operation, count(DISTINCT candidate_id) AS candidates, round((max(c) + 0.25)::DOUBLE, 6) AS priority FROM p JOIN q ON q.i = split_part(a, ':', 1)::INT GROUP BY 1, 2 ORDER BY priority DESC, primitive, operation LIMIT 12""",
)
def _targets_query(spark, sf_dir):
    return measurement_targets(_ranked(spark), query_rows(spark, commerce()))


@query("workload_fingerprint", f"WITH q(i, kind, field, weight, s, p) AS (VALUES {_QUERIES}), e AS (SELECT i, 'kind' AS part, kind AS item, weight FROM q UNION ALL SELECT i, 'distribution', 'uniform', weight FROM q UNION ALL SELECT i, 'field', field, weight FROM q), g AS (SELECT part, item, sum(weight)::DOUBLE AS w, min(i) AS f FROM e GROUP BY 1, 2) SELECT part, item, round(w / (SELECT sum(weight) FROM q), 8) AS share, row_number() OVER (PARTITION BY part ORDER BY w DESC, f) = 1 AS dominant FROM g")
def _fingerprint_query(spark, sf_dir):
    return fingerprint(query_rows(spark, commerce()))


@query("capability_coverage", f"WITH c(primitive, kind, base, size, build, upd) AS (VALUES {_VALUES}), q(i, kind, field, weight, s, p) AS (VALUES {_QUERIES}), n AS (SELECT DISTINCT primitive FROM c), j AS (SELECT n.primitive, q.kind, q.weight, c.kind IS NOT NULL AS ok FROM n CROSS JOIN q LEFT JOIN c ON c.primitive = n.primitive AND c.kind = q.kind) SELECT primitive, round(sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight), 8)::DOUBLE AS supported, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (NOT ok), '') AS unsupported FROM j GROUP BY 1")
def _coverage_query(spark, sf_dir):
    return coverage(spark, query_rows(spark, commerce()))


@query("experiment_matrix", "SELECT 'size' AS study, n::VARCHAR AS n, d AS d, substr(sha256('size|d=' || d || '|n=' || n), 1, 16) AS experiment_id FROM (VALUES (1000), (10000), (100000)) a(n), (VALUES ('uniform'), ('zipf')) b(d)")
def _matrix_query(spark, sf_dir):
    return experiment_matrix(spark, "size", {"n": [1000, 10000, 100000], "d": ["uniform", "zipf"]})
