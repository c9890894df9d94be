"""Access traces: rows (trace_id, pos, key) with positions from 0 without gaps. Profiles, drift, windows and phases.

No step needs the whole trace in one task: adjacency is a join on pos + 1, ranks come from the histogram of frequencies (it has at
most about sqrt(2n) rows, and long tails are summed ``CHUNK`` ranks at a time), and windows are exploded and grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.access import positions
from ..registry import query, table

SEQUENTIAL, HOTSPOT, ZIPF_THETA, ZIPF_FIT = 0.80, 0.70, (0.5, 2.5), 0.85
DRIFT = 0.20
CHUNK = 1 << 16  # ranks of a row


def frequencies(trace: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, key, n, first): how often each key occurs, and where first."""
    return trace.groupBy(*by, "key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def _levels(freq: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, m, b): how many keys occur n times, and how many more often. A row a distinct frequency, about sqrt(2 accesses) at most."""
    ties = freq.groupBy(*by, "n").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ties.withColumn("b", before)


def _rank_logs(levels: DataFrame) -> DataFrame:
    """Add, for ranks b + 1 to b + m, the sums _x of ln(rank) and _xx of its square; ``CHUNK`` ranks a row."""
    cut = levels.withColumn("_lo", F.explode(F.expr(f"sequence(b + 1, b + m, {CHUNK}L)")))
    own = "sequence(_lo, least(_lo + {0} - 1, b + m))".format(CHUNK)
    add = lambda value: F.expr(f"aggregate({own}, cast(0 as double), (t, r) -> t + {value})")
    return cut.withColumns({"_x": add("ln(r)"), "_xx": add("ln(r) * ln(r)"), "_w": F.least(F.lit(CHUNK), F.col("b") + F.col("m") - F.col("_lo") + 1)})


def classify(sequential: Column, top: Column, theta: Column, fit: Column) -> Column:
    return (
        F.when(sequential >= SEQUENTIAL, "sequential")
        .when(top >= HOTSPOT, "hotspot")
        .when(theta.between(*ZIPF_THETA) & (fit >= ZIPF_FIT), "zipf")
        .otherwise("uniform")
    )


def profile(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a trace: accesses, distinct keys, unique ratio, top-key mass, sequential ratio, entropy, Zipf fit and label.

    The Zipf fit is null with fewer than four keys or one frequency. Floats are rounded to 8 digits after the label is found."""
    by = by or ["trace_id"]
    freq = frequencies(trace, by)
    totals = freq.groupBy(*by).agg(F.sum("n").alias("accesses"), F.count("*").alias("unique_keys"), F.countDistinct("n").alias("_levels"))
    p, y, k = F.col("n") / F.col("accesses"), F.log("n"), F.col("_w").cast("double")
    take = lambda share: F.greatest(F.lit(1), F.ceil(F.col("unique_keys") * share))
    inside = lambda share: F.least(F.col("_w"), F.greatest(F.lit(0).cast("long"), take(share) - F.col("_lo") + 1))  # noqa: E731  ranks of the row among the top
    sums = (
        _rank_logs(_levels(freq, by)).join(totals, by)
        .groupBy(*by, "accesses", "unique_keys", "_levels")
        .agg(
            F.sum(-p * F.log(p) * k).alias("_h"), F.sum(F.col("n") * inside(0.01)).alias("_top1"), F.sum(F.col("n") * inside(0.10)).alias("_top10"),
            F.sum(k).alias("_k"), F.sum("_x").alias("_sx"), F.sum("_xx").alias("_sxx"), F.sum(y * k).alias("_sy"), F.sum(y * y * k).alias("_syy"), F.sum(y * F.col("_x")).alias("_sxy"),
        )
    )
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("_k")
    xy, xx, yy = cov("_sx", "_sy", "_sxy"), cov("_sx", "_sx", "_sxx"), cov("_sy", "_sy", "_syy")
    stats = sums.withColumns({"_slope": F.try_divide(xy, xx), "_r2": F.try_divide(xy * xy, xx * yy)})
    after = trace.select(*by, (F.col("pos") - 1).alias("pos"), F.col("key").alias("_next"))
    steps = trace.join(after, [*by, "pos"]).groupBy(*by).agg((F.count_if(F.col("_next") == F.col("key") + 1) / F.count("*")).alias("_seq"))
    fits = (F.col("unique_keys") >= 4) & (F.col("_levels") > 1)
    full = stats.join(steps, by, "left").withColumns(
        {
            "sequential_ratio": F.coalesce("_seq", F.lit(0.0)),
            "top1_mass": F.col("_top1") / F.col("accesses"),
            "top10_mass": F.col("_top10") / F.col("accesses"),
            "entropy": F.when(F.col("unique_keys") > 1, F.col("_h") / F.log("unique_keys")).otherwise(0.0),
            "theta": F.when(fits, F.greatest(F.lit(0.0), -F.col("_slope"))),
            "fit": F.when(fits, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_r2")))),
        }
    )
    full = full.withColumn("label", classify(F.col("sequential_ratio"), F.col("top10_mass"), F.col("theta"), F.col("fit")))
    floats = ["sequential_ratio", "top1_mass", "top10_mass", "entropy", "theta", "fit"]
    return full.select(*by, "accesses", "unique_keys", F.round(F.col("unique_keys") / F.col("accesses"), 8).alias("unique_ratio"), *[F.round(c, 8).alias(c) for c in floats], "label")


def shares(weights: DataFrame, by: list[str], item: str, weight: str) -> DataFrame:
    """Add ``p``: each item's share of its group's weight."""
    total = weights.groupBy(*by).agg(F.sum(weight).alias("_t"))
    return weights.join(total, by).withColumn("p", F.col(weight) / F.col("_t")).drop("_t")


def drift(left: DataFrame, right: DataFrame, threshold: float = DRIFT) -> DataFrame:
    """Total variation, Jensen-Shannon divergence in units of ln 2, hot-key overlap and the drift flag of two traces (pos, key).

    Hot keys are the tenth of the keys, at least one, that occur most; equal counts rank by first appearance."""

    def side(trace: DataFrame, name: str) -> DataFrame:
        one = trace.withColumn("_one", F.lit(1))
        freq = shares(frequencies(one, ["_one"]), ["_one"], "key", "n")
        take = freq.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.10)).alias("_take"))
        levels = _levels(freq.select("_one", "n"), ["_one"]).crossJoin(F.broadcast(take))  # one row
        whole = levels.select("n", (F.col("b") + F.col("m") <= F.col("_take")).alias("_all"), (F.col("_take") - F.col("b")).alias("_left")).where("_left > 0")
        met = freq.join(whole, "n", "left").select("key", "p", "first", F.coalesce("_all", F.lit(False)).alias("_all"), "_left")
        cut = positions(met.where("NOT _all AND _left > 0"), "first").select(F.col("key").alias("_key"), (F.col("position") < F.col("_left")).alias("_in"))  # keys of the one frequency that the cut falls in
        hot = met.join(cut, F.col("key") == F.col("_key"), "left").withColumn("hot", F.col("_all") | F.coalesce("_in", F.lit(False)))
        return hot.select("key", F.col("p").alias(f"p_{name}"), F.col("hot").alias(f"hot_{name}"))

    p, q = F.coalesce("p_a", F.lit(0.0)), F.coalesce("p_b", F.lit(0.0))
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    ha, hb = F.coalesce("hot_a", F.lit(False)), F.coalesce("hot_b", F.lit(False))
    both = side(left, "a").join(side(right, "b"), "key", "full")
    out = both.agg(
        (F.sum(F.abs(p - q)) / 2).alias("_tv"),
        (F.sum(half(p) + half(q)) / 2 / F.log(F.lit(2.0))).alias("_js"),
        F.count_if(ha & hb).alias("_both"),
        F.count_if(ha | hb).alias("_any"),
    )
    return out.select(
        F.round("_tv", 8).alias("total_variation"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_js"))), 8).alias("jensen_shannon"),
        F.round(F.try_divide("_both", "_any"), 8).alias("hot_jaccard"),
        (F.col("_tv") >= threshold).alias("drifted"),
    )


def windowed(trace: DataFrame, size: int = 500, step: int | None = None) -> DataFrame:
    """Rows (trace_id, window_idx, pos, key): complete windows [i * step, i * step + size) only; they overlap if step < size."""
    step = step or size
    n = trace.groupBy("trace_id").agg(F.count("*").alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step))
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_n") - size) / step))
    inside = trace.join(n, "trace_id").withColumns({"_f": first, "_l": last}).where("_f <= _l AND _n >= " + str(size))
    return inside.select("trace_id", F.explode(F.sequence("_f", "_l")).alias("window_idx"), "pos", "key")


def window_profiles(trace: DataFrame, size: int = 500, step: int | None = None) -> DataFrame:
    """The profile of every complete window."""
    return profile(windowed(trace, size, step), ["trace_id", "window_idx"])


def phase_boundaries(trace: DataFrame, size: int = 500, step: int | None = None, threshold: float = DRIFT) -> DataFrame:
    """Total variation between each window and the one before; a boundary where it reaches the threshold."""
    freq = windowed(trace, size, step).groupBy("trace_id", "window_idx", "key").agg((F.count("*") / size).alias("p"))
    now = freq.where("window_idx > 0").select("trace_id", "window_idx", "key", F.col("p").alias("p_now"))
    last = freq.groupBy("trace_id").agg(F.max("window_idx").alias("_last"))
    before = freq.join(last, "trace_id").where("window_idx < _last").select("trace_id", (F.col("window_idx") + 1).alias("window_idx"), "key", F.col("p").alias("p_before"))
    both = now.join(before, ["trace_id", "window_idx", "key"], "full")
    tv = F.sum(F.abs(F.coalesce("p_now", F.lit(0.0)) - F.coalesce("p_before", F.lit(0.0)))) / 2
    return both.groupBy("trace_id", "window_idx").agg(tv.alias("_tv")).select("trace_id", "window_idx", F.round("_tv", 8).alias("total_variation"), (F.round("_tv", 8) >= threshold).alias("boundary"))


def mix_drift(observed: DataFrame, expected: DataFrame, threshold: float = 0.18) -> DataFrame:
    """Rows (component, item, weight) twice: total variation a component, and whether the largest reaches the threshold.

    A component that only one side knows is unknown and doesn't count as drift."""
    a = shares(observed, ["component"], "item", "weight").select("component", "item", F.col("p").alias("p_a"))
    b = shares(expected, ["component"], "item", "weight").select("component", "item", F.col("p").alias("p_b"))
    known = observed.select("component").distinct().join(expected.select("component").distinct(), "component", "left_semi")
    gap = F.sum(F.abs(F.coalesce("p_a", F.lit(0.0)) - F.coalesce("p_b", F.lit(0.0)))) / 2
    each = a.join(b, ["component", "item"], "full").join(known, "component", "left_semi").groupBy("component").agg(F.round(gap, 8).alias("total_variation"))
    worst = each.agg(F.max("total_variation").alias("_w"))
    return each.crossJoin(F.broadcast(worst)).withColumn("drifted", F.col("_w") >= threshold).drop("_w")  # one row


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit(0).alias("trace_id"), F.col("event_id").alias("pos"), F.col("user_id").alias("key"))


def _profile_sql(rows: str, by: str) -> str:
    return f"""
WITH t AS ({rows}),
f AS (SELECT {by}, key, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC) AS rank, sum(n) OVER (PARTITION BY {by}) AS acc, count(*) OVER (PARTITION BY {by}) AS u FROM f),
s AS (SELECT {by}, acc::BIGINT AS accesses, u AS unique_keys, -sum(n / acc * ln(n / acc)) AS h, count(DISTINCT n) AS levels,
        sum(n) FILTER (rank <= greatest(1, ceil(u * 0.01))) / acc AS top1, sum(n) FILTER (rank <= greatest(1, ceil(u * 0.10))) / acc AS top10,
        regr_slope(ln(n), ln(rank)) AS slope, regr_r2(ln(n), ln(rank)) AS r2 FROM r GROUP BY {by}, acc, u),
q AS (SELECT {by}, avg((nxt = key + 1)::INT) AS seq FROM (SELECT {by}, key, lead(key) OVER (PARTITION BY {by} ORDER BY pos) AS nxt FROM t) WHERE nxt IS NOT NULL GROUP BY ALL),
w AS (SELECT s.*, coalesce(seq, 0) AS seq, CASE WHEN u4 THEN greatest(0, -slope) END AS theta, CASE WHEN u4 THEN least(1, greatest(0, r2)) END AS fit,
        CASE WHEN unique_keys > 1 THEN h / ln(unique_keys) ELSE 0.0 END AS entropy FROM (SELECT *, unique_keys >= 4 AND levels > 1 AS u4 FROM s) s LEFT JOIN q USING ({by}))
SELECT {by}, accesses, unique_keys, round(unique_keys / accesses, 8) AS unique_ratio, round(seq, 8) AS sequential_ratio, round(top1, 8) AS top1_mass, round(top10, 8) AS top10_mass,
  round(entropy, 8) AS entropy, round(theta, 8) AS theta, round(fit, 8) AS fit,
  CASE WHEN seq >= 0.8 THEN 'sequential' WHEN top10 >= 0.7 THEN 'hotspot' WHEN theta BETWEEN 0.5 AND 2.5 AND fit >= 0.85 THEN 'zipf' ELSE 'uniform' END AS label FROM w"""


_TRACE = "SELECT 0 AS trace_id, event_id AS pos, user_id AS key FROM events"
_TYPED = "SELECT event_type AS trace_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, user_id AS key FROM events"
_WINDOWED = f"SELECT trace_id, i AS window_idx, pos, key FROM ({_TRACE}) t JOIN (SELECT unnest(range(0, (n - 500) // 250 + 1)) AS i FROM (SELECT count(*) AS n FROM events)) w ON pos >= i * 250 AND pos < i * 250 + 500"


@query("trace_profile", _profile_sql(_TRACE, "trace_id"))
def _trace_profile(spark, sf_dir):
    return profile(_events(spark, sf_dir))


@query("trace_profile_by_type", _profile_sql(_TYPED, "trace_id"))
def _trace_by_type(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    placed = positions(events.select(F.col("event_type").alias("trace_id"), "event_id", F.col("user_id").alias("key")), "event_id", by=["trace_id"], name="pos")
    return profile(placed.select("trace_id", "pos", "key"))


@query("trace_windows", _profile_sql(_WINDOWED, "trace_id, window_idx"))
def _trace_windows(spark, sf_dir):
    return window_profiles(_events(spark, sf_dir), 500, 250)


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    trace = _events(spark, sf_dir)
    middle = trace.agg((F.count("*") / 2).alias("_m"))
    marked = trace.crossJoin(F.broadcast(middle))  # one row
    return marked.where("pos < _m").select("pos", "key"), marked.where("pos >= _m").select("pos", "key")


_HALVES = "m AS (SELECT count(*) / 2 AS m FROM events), t AS (SELECT event_id AS pos, user_id AS key, event_id < m AS early FROM events, m)"


@query(
    "trace_drift",
    f"""WITH {_HALVES}, f AS (SELECT early, key, count(*) AS n, min(pos) AS first FROM t GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY early) AS p, row_number() OVER (PARTITION BY early ORDER BY n DESC, first) <= greatest(1, ceil(count(*) OVER (PARTITION BY early) * 0.10)) AS hot FROM f),
j AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q, coalesce(a.hot, false) AS ha, coalesce(b.hot, false) AS hb FROM (FROM r WHERE early) a FULL JOIN (FROM r WHERE NOT early) b USING (key)),
s AS (SELECT sum(abs(p - q)) / 2 AS tv, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2) AS js,
        count(*) FILTER (ha AND hb) / count(*) FILTER (ha OR hb) AS jac FROM j)
SELECT round(tv, 8) AS total_variation, round(least(1, greatest(0, js)), 8) AS jensen_shannon, round(jac, 8) AS hot_jaccard, tv >= 0.2 AS drifted FROM s""",
)
def _trace_drift(spark, sf_dir):
    return drift(*_halves(spark, sf_dir))


@query(
    "phase_boundaries",
    """WITH n AS (SELECT count(*) // 500 AS k FROM events), f AS (SELECT event_id // 500 AS w, user_id AS key, count(*) / 500 AS p FROM events, n WHERE event_id // 500 < k GROUP BY ALL),
j AS (SELECT w, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM f WHERE w > 0) a FULL JOIN (SELECT w + 1 AS w, key, p FROM f, n WHERE w < k - 1) b USING (w, key))
SELECT 0 AS trace_id, w AS window_idx, round(sum(abs(p - q)) / 2, 8) AS total_variation, round(sum(abs(p - q)) / 2, 8) >= 0.2 AS boundary FROM j GROUP BY w""",
)
def _phases(spark, sf_dir):
    return phase_boundaries(_events(spark, sf_dir), 500)


@query(
    "operation_mix_drift",
    f"""WITH {_HALVES}, w AS (SELECT 'operation' AS component, event_type AS item, event_id < m AS early, count(*) AS n FROM events, m GROUP BY ALL
UNION ALL SELECT 'parity', (user_id % 2)::VARCHAR, event_id < m, count(*) FROM events, m GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY component, early) AS p FROM w),
j AS (SELECT component, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (FROM s WHERE early) a FULL JOIN (FROM s WHERE NOT early) b USING (component, item)),
g AS (SELECT component, round(sum(abs(p - q)) / 2, 8) AS total_variation FROM j GROUP BY 1)
SELECT component, total_variation, (SELECT max(total_variation) FROM g) >= 0.18 AS drifted FROM g""",
)
def _mix(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    middle = events.agg((F.count("*") / 2).alias("_m"))
    items = events.crossJoin(F.broadcast(middle)).select(  # one row
        (F.col("event_id") < F.col("_m")).alias("early"),
        F.explode(F.array(F.struct(F.lit("operation").alias("component"), F.col("event_type").alias("item")), F.struct(F.lit("parity").alias("component"), (F.col("user_id") % 2).cast("string").alias("item")))).alias("x"),
    )
    weights = items.groupBy("early", "x.component", "x.item").agg(F.count("*").alias("weight"))
    return mix_drift(weights.where("early").drop("early"), weights.where("NOT early").drop("early"))


@query(
    "key_frequency",
    "SELECT user_id AS key, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
)
def _frequency(spark, sf_dir):
    return frequencies(_events(spark, sf_dir), ["trace_id"]).drop("trace_id")
