"""Roll-ups of whole studies: hold-outs, strata, replications, gates, factor contrasts, campaigns; and trace generators with known labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import quantiles, with_median
from ..registry import query, table
from . import traces
from .statistics import confusion


def percentage_errors(rows: DataFrame, by: list[str], predicted: str, measured: str) -> DataFrame:
    """Mean, median and largest absolute percentage error (a fraction) over measured <> 0."""
    ape = F.abs(F.col(predicted) - F.col(measured)) / F.abs(F.nullif(F.col(measured), F.lit(0.0)))
    each = rows.withColumn("_ape", ape)
    basic = each.groupBy(*by).agg(F.count("_ape").alias("n"), F.round(F.avg("_ape"), 8).alias("mape"), F.round(F.max("_ape"), 8).alias("max_ape"))
    return with_median(basic, each, by, "_ape", "_m").select(*by, "n", "mape", F.round("_m", 8).alias("median_ape"), "max_ape")


def leaks(holdout: DataFrame, training: DataFrame, source: str) -> DataFrame:
    """Hold-out rows whose source also taught the model."""
    return holdout.join(training.select(source).distinct(), source, "left_semi")


def spread(rows: DataFrame, stratum: str, value: str) -> DataFrame:
    """How far strata are apart: least and largest stratum mean, and the gap."""
    means = rows.groupBy(stratum).agg(F.avg(value).alias("_m"))
    return means.agg(F.count("*").alias("strata"), F.round(F.min("_m"), 6).alias("least"), F.round(F.max("_m"), 6).alias("largest"), F.round(F.max("_m") - F.min("_m"), 6).alias("spread"))


def gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Whether each row keeps all limits (column -> comparison and value), and which it breaks. A missing metric breaks its limit."""
    tests = {c: (F.col(c) <= v) if op == "<=" else (F.col(c) >= v) for c, (op, v) in limits.items()}
    broken = F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items()]), lambda x: x.isNotNull())
    return metrics.withColumns({"passed": F.size(broken) == 0, "broken": F.array_join(broken, ",")})


def skyline(rows: DataFrame, by: list[str], costs: tuple[str, str]) -> DataFrame:
    """Rows that no other of their group matches on both costs and beats on one. One running minimum over the first cost's distinct values."""
    a, b = costs
    least = rows.groupBy(*by, a).agg(F.min(b).alias("_b"))
    before = F.min("_b").over(W.partitionBy(*by).orderBy(a).rowsBetween(W.unboundedPreceding, -1))
    front = least.withColumn("_before", before).where("_before IS NULL OR _b < _before").drop("_before")
    return rows.join(front, [*by, a]).where(F.col(b) == F.col("_b")).drop("_b")


def search_quality(found: DataFrame, exhaustive: DataFrame, key: str, score: str, by: list[str], costs: tuple[str, str]) -> DataFrame:
    """A heuristic's best score against the exhaustive one (never below it), whether both chose the same, the share of candidates that it left out, and
    how many of the exhaustive Pareto front are on its own."""
    best = lambda d, name: d.groupBy(*by).agg(F.min_by(F.struct(score, key), F.struct(score, key)).alias(name), F.count("*").alias(f"{name}n"))
    front, own = skyline(exhaustive, by, costs).select(*by, key), skyline(found, by, costs).select(*by, key, F.lit(1).alias("_on"))
    cover = front.join(own, [*by, key], "left").groupBy(*by).agg(F.avg(F.coalesce("_on", F.lit(0)).cast("double")).alias("_c"))
    out = best(exhaustive, "_e").join(best(found, "_h"), by, "left").join(cover, by)
    regret = F.greatest(F.lit(0.0), F.col("_h")[score] - F.col("_e")[score])
    return out.select(
        *by, F.coalesce(F.col("_h")[key] == F.col("_e")[key], F.lit(False)).alias("same_winner"), F.when(F.col("_h").isNotNull(), F.round(regret, 6)).alias("regret"),
        F.round(1 - F.coalesce("_hn", F.lit(0)) / F.col("_en"), 8).alias("reduction"), F.round("_c", 8).alias("pareto_coverage"),
    )


def factor_contrasts(rows: DataFrame, row_factor: str, column_factor: str, scale: str, value: str) -> DataFrame:
    """Medians of each cell, and each (row, column) series' slope of the median over the scale."""
    cells = quantiles(rows, [row_factor, column_factor, scale], value, {"_m": 0.5})
    return cells.groupBy(row_factor, column_factor).agg(F.count("*").alias("cells"), F.round(F.regr_slope("_m", F.col(scale).cast("double")), 6).alias("slope"), F.round(F.avg("_m"), 6).alias("mean_of_medians"))


def weighted_latency(queries: DataFrame, by: list[str], weight: str, median_ns: str) -> DataFrame:
    """Weighted mean of measured medians in microseconds."""
    return queries.groupBy(*by).agg(F.round(F.sum(F.col(weight) * F.col(median_ns) / 1000) / F.sum(weight), 6).alias("latency_us"))


def campaign_state(rows: DataFrame, by: list[str], success: str, state: str, expected: int) -> DataFrame:
    """incomplete_or_failed if an entry failed, else partial below the expected number, else what a single kind of evidence makes of it, else mixed."""
    g = rows.groupBy(*by).agg(F.min(success).alias("_ok"), F.array_sort(F.collect_set(F.when(F.col(success), F.col(state)))).alias("_s"), F.count("*").alias("n"))
    label = F.when(~F.col("_ok"), "incomplete_or_failed").when(F.col("n") < expected, "partial").when(F.size("_s") == 1, F.concat(F.lit("complete:"), F.col("_s")[0])).otherwise("mixed")
    return g.select(*by, "n", label.alias("state"))


def shared_verifiers(attestations: DataFrame, lineage: str, attestation: str, verifier: str) -> DataFrame:
    """Verifiers that stand behind more than one attestation of a lineage; consensus needs none."""
    return attestations.groupBy(lineage, verifier).agg(F.countDistinct(attestation).alias("n")).where("n > 1")


def _changed() -> tuple[Column, Column]:
    """Whether what was chosen has changed, and whether what it rests on has. A missing flag counts as no change."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flag("candidate_changed") | flag("route_changed"), flag("drifted") | flag("distribution_changed")


def freshness(status: DataFrame) -> DataFrame:
    """Rows (blocked, candidate_changed, route_changed, drifted, distribution_changed) to what a decision is worth for the windows that it was held
    against: BLOCKED, SUPERSEDED, REVIEW_REQUIRED or CURRENT, the first that applies. Age alone expires nothing."""
    choice, ground = _changed()
    return status.withColumn("freshness", F.when(F.col("blocked"), "BLOCKED").when(choice, "SUPERSEDED").when(ground, "REVIEW_REQUIRED").otherwise("CURRENT"))


def watch_action(status: DataFrame) -> DataFrame:
    """The same rows to BLOCKED, RESYNTHESIZE (a changed winner or route, drift or not), REMEASURE (drift, or another distribution) or KEEP."""
    choice, ground = _changed()
    return status.withColumn("action", F.when(F.col("blocked"), "BLOCKED").when(choice, "RESYNTHESIZE").when(ground, "REMEASURE").otherwise("KEEP"))


def _uniform(seed: int, salt: str, *columns: str) -> Column:
    """A number in [0, 1) from a hash: the same on any cluster and in any order."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def generate(spark: SparkSession, kind: str, accesses: int, keys: int, seed: int = 1337, theta: float = 0.99, hot_fraction: float = 0.1, hot_probability: float = 0.8) -> DataFrame:
    """A trace (pos, key) of known kind. Hot keys are round(keys * fraction), at least one; cold accesses draw from the others only.
    Zipf accesses invert the continuous law, so no table of the keys is needed."""
    pos = spark.range(accesses).withColumnRenamed("id", "pos")
    u, v = _uniform(seed, "u", "pos"), _uniform(seed, "v", "pos")
    if kind == "sequential":
        return pos.select("pos", (F.col("pos") % keys).alias("key"))
    if kind == "uniform":
        return pos.select("pos", F.floor(u * keys).alias("key"))
    if kind == "hotspot":
        hot = max(1, round(keys * hot_fraction))
        return pos.select("pos", F.when(u < hot_probability, F.floor(v * hot)).otherwise(hot + F.floor(v * max(1, keys - hot))).alias("key"))
    if kind != "zipf":
        raise ValueError(f"no such kind: {kind}")
    # inverse of the continuous Zipf law over [1, keys + 1), then its floor: no table, so keys may be many
    top = F.lit(float(keys + 1))
    rank = F.exp(u * F.log(top)) if theta == 1 else F.pow(u * (F.pow(top, F.lit(1 - theta)) - 1) + 1, F.lit(1 / (1 - theta)))
    return pos.select("pos", ((F.floor(rank) - 1) * 1000).alias("key"))  # apart, so that neighbours are no sequence


def classifier_validation(spark: SparkSession, accesses: int = 4000, keys: int = 200, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Generated traces of each kind against the profile's labels, as a confusion matrix."""
    all_ = None
    for kind in ("uniform", "sequential", "hotspot", "zipf"):
        for s in seeds:
            one = generate(spark, kind, accesses, keys, s, theta=1.2, hot_probability=0.9).select(F.lit(f"{kind}-{s}").alias("trace_id"), "pos", F.col("key").cast("long").alias("key"))
            all_ = one if all_ is None else all_.unionByName(one)
    labels = traces.profile(all_).select(F.split_part("trace_id", F.lit("-"), F.lit(1)).alias("expected"), F.col("label").alias("predicted"))
    return confusion(labels, "expected", "predicted")


def _units(spark, sf_dir) -> DataFrame:
    unit = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("measured"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("predicted")).join(unit, "p_partkey")


_UNITS = "u AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice AS predicted, measured FROM part JOIN (SELECT l_partkey, round(avg(l_extendedprice / l_quantity), 4) AS measured FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"
_APE = "abs(predicted - measured) / abs(measured)"


@query("mape_holdout", f"WITH {_UNITS} SELECT p_type, count(*) AS n, round(avg({_APE}), 8) AS mape, round(median({_APE}), 8) AS median_ape, round(max({_APE}), 8) AS max_ape FROM u WHERE measured <> 0 GROUP BY 1")
def _mape(spark, sf_dir):
    return percentage_errors(_units(spark, sf_dir), ["p_type"], "predicted", "measured")


@query("holdout_leaks", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _leaks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return leaks(orders.where("o_orderstatus = 'P'").drop("o_orderstatus"), orders.where("o_orderstatus = 'F'"), "o_custkey")


@query("stratified_spread", f"WITH {_UNITS}, m AS (SELECT p_type, avg({_APE}) AS m FROM u GROUP BY 1) SELECT count(*) AS strata, round(min(m), 6) AS least, round(max(m), 6) AS largest, round(max(m) - min(m), 6) AS spread FROM m")
def _spread(spark, sf_dir):
    return spread(_units(spark, sf_dir).withColumn("ape", F.abs(F.col("predicted") - F.col("measured")) / F.abs("measured")), "p_type", "ape")


@query(
    "holdout_gate",
    f"WITH {_UNITS}, g AS (SELECT p_type, count(*) AS n, round(avg({_APE}), 8) AS mape, round(median({_APE}), 8) AS median_ape, round(max({_APE}), 8) AS max_ape FROM u GROUP BY 1) "
    "SELECT *, mape <= 0.4 AND n >= 340 AS passed, concat_ws(',', CASE WHEN NOT mape <= 0.4 THEN 'mape' END, CASE WHEN NOT n >= 340 THEN 'n' END) AS broken FROM g",
)
def _gate(spark, sf_dir):
    return gate(percentage_errors(_units(spark, sf_dir), ["p_type"], "predicted", "measured"), {"mape": ("<=", 0.4), "n": (">=", 340)})


@query(
    "search_quality",
    f"""WITH {_UNITS}, h AS (FROM u WHERE p_size <= 25), front AS (SELECT p_brand, p_partkey FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.p_brand = u.p_brand AND o.measured <= u.measured AND o.p_size <= u.p_size AND (o.measured < u.measured OR o.p_size < u.p_size))),
own AS (SELECT p_brand, p_partkey FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.p_brand = h.p_brand AND o.measured <= h.measured AND o.p_size <= h.p_size AND (o.measured < h.measured OR o.p_size < h.p_size))),
c AS (SELECT f.p_brand, avg((own.p_partkey IS NOT NULL)::INT) AS c FROM front f LEFT JOIN own USING (p_brand, p_partkey) GROUP BY 1),
e AS (SELECT p_brand, min(measured) AS o, arg_min(p_partkey, (measured, p_partkey)) AS w, count(*) AS n FROM u GROUP BY 1), g AS (SELECT p_brand, min(measured) AS o, arg_min(p_partkey, (measured, p_partkey)) AS w, count(*) AS n FROM h GROUP BY 1)
SELECT p_brand, coalesce(g.w = e.w, false) AS same_winner, round(greatest(0, g.o - e.o), 6) AS regret, round(1 - coalesce(g.n, 0) / e.n, 8) AS reduction, round(c, 8) AS pareto_coverage FROM e LEFT JOIN g USING (p_brand) JOIN c USING (p_brand)""",
)
def _quality(spark, sf_dir):
    u = _units(spark, sf_dir)
    return search_quality(u.where("p_size <= 25"), u, "p_partkey", "measured", ["p_brand"], ("measured", "p_size"))


@query(
    "factor_contrasts",
    "WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, l_linestatus, count(*) AS cells, round(regr_slope(m, l_linenumber), 6) AS slope, round(avg(m), 6) AS mean_of_medians FROM c GROUP BY 1, 2",
)
def _factors(spark, sf_dir):
    return factor_contrasts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")


@query("weighted_latency", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice / 1000) / sum(l_quantity), 6) AS latency_us FROM lineitem GROUP BY 1")
def _weighted(spark, sf_dir):
    return weighted_latency(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("campaign_state", "SELECT o_custkey, count(*) AS n, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'incomplete_or_failed' WHEN count(*) < 3 THEN 'partial' WHEN count(DISTINCT o_orderstatus) = 1 THEN 'complete:' || min(o_orderstatus) ELSE 'mixed' END AS state FROM orders GROUP BY 1")
def _campaign(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") != "P")
    return campaign_state(orders, ["o_custkey"], "ok", "o_orderstatus", 3)


@query("shared_verifiers", "SELECT l_linenumber, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1")
def _verifiers(spark, sf_dir):
    return shared_verifiers(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_orderkey", "l_suppkey")


@query("shared_verifiers_whole", "SELECT l_returnflag, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1")
def _verifiers_whole(spark, sf_dir):
    return shared_verifiers(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_suppkey")


_FLAGS = "s AS (SELECT event_id, event_type = 'error' AS blocked, user_id % 7 = 0 AS candidate_changed, user_id % 11 = 0 AS route_changed, value > 100 AS drifted, user_id % 5 = 0 AS distribution_changed FROM events)"


def _flags(spark, sf_dir) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_type") == "error").alias("blocked"), (user % 7 == 0).alias("candidate_changed"), (user % 11 == 0).alias("route_changed"), (F.col("value") > 100).alias("drifted"), (user % 5 == 0).alias("distribution_changed")
    )


@query("decision_freshness", f"WITH {_FLAGS} SELECT event_id, CASE WHEN blocked THEN 'BLOCKED' WHEN candidate_changed OR route_changed THEN 'SUPERSEDED' WHEN drifted OR distribution_changed THEN 'REVIEW_REQUIRED' ELSE 'CURRENT' END AS freshness FROM s")
def _freshness(spark, sf_dir):
    return freshness(_flags(spark, sf_dir)).select("event_id", "freshness")


@query("watch_action", f"WITH {_FLAGS} SELECT event_id, CASE WHEN blocked THEN 'BLOCKED' WHEN candidate_changed OR route_changed THEN 'RESYNTHESIZE' WHEN drifted OR distribution_changed THEN 'REMEASURE' ELSE 'KEEP' END AS action FROM s")
def _watch(spark, sf_dir):
    return watch_action(_flags(spark, sf_dir)).select("event_id", "action")


@query("replication_spread", f"WITH {_UNITS}, s AS (SELECT p_brand, avg({_APE}) AS m FROM u GROUP BY 1) SELECT count(*) AS strata, round(min(m), 6) AS least, round(max(m), 6) AS largest, round(max(m) - min(m), 6) AS spread FROM s")
def _replication(spark, sf_dir):
    return spread(_units(spark, sf_dir).withColumn("ape", F.abs(F.col("predicted") - F.col("measured")) / F.abs("measured")), "p_brand", "ape")


@query("classifier_validation")
def _validation(spark, sf_dir):
    return classifier_validation(spark)
