"""Evaluation statistics over grouped predictions, measurements and pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import average_ranks, quantiles, same, with_median
from ..registry import query, table

TOLERANCE = 1e-12
GRID = 32  # ranges of a number that Kendall's tau counts by


def prediction_errors(points: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, predicted, measured) to MAE, RMSE, bias, largest error and MAPE (a fraction, over measured <> 0)."""
    e = F.col("predicted") - F.col("measured")
    return points.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(e), 6).alias("bias"),
        F.round(F.max(F.abs(e)), 6).alias("max_error"),
        F.round(F.avg(F.when(F.col("measured") != 0, F.abs(e / F.nullif("measured", F.lit(0.0))))), 8).alias("mape"),
    )


def _corr(x: str, y: str) -> Column:
    """Pearson's coefficient, null without variance (corr() raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(points: DataFrame, by: list[str]) -> DataFrame:
    """Pearson and Spearman a group; null with fewer than two points or no variance."""
    ranked = average_ranks(average_ranks(points, by, "predicted", "_p"), by, "measured", "_m")
    return ranked.groupBy(*by).agg(
        F.round(_corr("predicted", "measured"), 8).alias("pearson"), F.round(_corr("_p", "_m"), 8).alias("spearman")
    )


def _inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], bit by bit: among values that agree in the higher bits, ones that come before zeros."""
    r = np.unique(y, return_inverse=True)[1]
    total, group = 0, np.zeros(len(r), np.int64)
    for bit in reversed(range(int(r.max(initial=0)).bit_length())):
        one = r >> bit & 1
        ones = np.cumsum(one)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.repeat(ones[starts] - one[starts], np.diff(np.r_[starts, len(r)]))
        total += int((ones - base)[one == 0].sum())
        order = np.lexsort((one, group))
        r, group = r[order], 2 * group[order] + one[order]
    return total


def kendall(points: DataFrame, by: list[str], label: str) -> DataFrame:
    """Kendall's tau-b a group, without its pairs: all pairs less ties less twice the discordant ones.

    Each group is a grid of ``GRID`` ranges of either number. Discordant pairs of cells that differ in both are counted from the cells; those
    within a column or a row of cells by counting inversions, a column or row at a time, so no task holds a group."""
    known = points.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("predicted").cast("double").alias("x"), F.col("measured").cast("double").alias("y")).dropna(subset=["x", "y"])
    keys = [f"_k{i}" for i in range(len(by))]
    shares = [i / GRID for i in range(1, GRID)]
    bounds = known.groupBy(*keys).agg(F.percentile_approx("x", shares, 1000).alias("_qx"), F.percentile_approx("y", shares, 1000).alias("_qy"))
    renamed = bounds.select(*[F.col(k).alias(k.replace("_k", "_j")) for k in keys], "_qx", "_qy")
    cell = lambda q, v: F.size(F.filter(q, lambda b: b < F.col(v)))
    binned = known.join(renamed, same(keys, "_j")).select(*keys, "x", "y", cell("_qx", "x").alias("i"), cell("_qy", "y").alias("j"))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((GRID, GRID))
        grid[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["c"].to_numpy()
        below = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid  # of one i, with a larger j
        return pdf.iloc[:1][keys].assign(d=float((grid[1:] * np.cumsum(below, axis=0)[:-1]).sum()))

    def within(first: str, second: str):
        def each(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([first, second], kind="stable")
            return pdf.iloc[:1][keys].assign(d=float(_inversions(pdf[second].to_numpy())))

        return each

    schema = ", ".join(f"{k} {known.schema[k].dataType.simpleString()}" for k in keys) + ", d double"
    cells = binned.groupBy(*keys, "i", "j").agg(F.count("*").alias("c")).groupBy(*keys).applyInPandas(counted, schema)
    columns = binned.groupBy(*keys, "i").applyInPandas(within("x", "y"), schema)
    rows = binned.groupBy(*keys, "j").applyInPandas(within("i", "y"), schema)
    discordant = cells.unionByName(columns).unionByName(rows).groupBy(*keys).agg(F.sum("d").alias("_d"))
    pairs = lambda *on: known.groupBy(*keys, *on).agg((F.count("*").cast("double") * (F.count("*") - 1) / 2).alias("t")).groupBy(*keys).agg(F.sum("t").alias("t"))
    out = discordant
    for name, on in (("_all", ()), ("_tx", ("x",)), ("_ty", ("y",)), ("_txy", ("x", "y"))):
        other = pairs(*on).select(*[F.col(k).alias(k.replace("_k", "_j")) for k in keys], F.col("t").alias(name))
        out = out.join(other, same(keys, "_j")).drop(*[k.replace("_k", "_j") for k in keys])
    top = F.col("_all") - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.col("_d")
    below = F.sqrt((F.col("_all") - F.col("_tx")) * (F.col("_all") - F.col("_ty")))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.round(F.when(below > 0, top / below), 8).alias("kendall"))


def selection(points: DataFrame, by: list[str], label: str, k: int = 3) -> DataFrame:
    """Top-1 hit, regret and top-k recall of choosing the least predicted; ties go by label."""
    least = lambda c: F.min_by(F.struct(F.col(label).alias("l"), "measured"), F.struct(c, label))
    ends = points.groupBy(*by).agg(least("predicted").alias("_a"), least("measured").alias("_b"), F.count("*").alias("_n"))
    first = lambda c: points.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(c, label))).where(F.col("_r") <= k).select(*by, label)  # noqa: E731  Spark keeps k a task before it shuffles
    met = first("predicted").join(first("measured"), [*by, label]).groupBy(*by).agg(F.count("*").alias("_m"))
    out = ends.join(met, by, "left").select(
        *by, F.col("_a.l").alias("selected"), F.col("_b.l").alias("oracle"), F.col("_a.measured").alias("_s"), F.col("_b.measured").alias("_o"),
        (F.coalesce("_m", F.lit(0)) / F.least(F.lit(k), F.col("_n"))).alias("_recall"),
    )
    regret = F.greatest(F.lit(0.0), F.col("_s") - F.col("_o"))
    return out.select(
        *by, "selected", "oracle", (F.col("selected") == F.col("oracle")).alias("hit"), F.round(regret, 6).alias("regret"),
        F.round(F.try_divide(regret, F.col("_o")), 8).alias("relative_regret"), F.round("_recall", 8).alias("topk_recall"),
    )


def held_out(points: DataFrame, workload: str, label: str, k: int = 3) -> DataFrame:
    """One row over all workloads: hit rate, mean and median regret, mean recall, means of the defined correlations."""
    each = selection(points, [workload], label, k).join(correlations(points, [workload]), workload).join(kendall(points, [workload], label), workload)
    return each.agg(
        F.count("*").alias("workloads"), F.round(F.avg(F.col("hit").cast("double")), 8).alias("hit_rate"), F.round(F.avg("regret"), 6).alias("mean_regret"),
        F.round(F.median("regret"), 6).alias("median_regret"), F.round(F.avg("topk_recall"), 8).alias("mean_recall"),
        F.round(F.avg("spearman"), 6).alias("mean_spearman"), F.round(F.avg("kendall"), 6).alias("mean_kendall"),
    )


def leave_one_out(points: DataFrame, workload: str, label: str, k: int = 3) -> DataFrame:
    """Mean recall and hit rate without each workload, from group sums rather than a copy of the data a workload."""
    each = selection(points, [workload], label, k)
    totals = each.agg(F.count("*").alias("_n"), F.sum("topk_recall").alias("_r"), F.sum(F.col("hit").cast("int")).alias("_h"))
    out = each.crossJoin(F.broadcast(totals))  # one row
    rest = F.col("_n") - 1
    return out.select(
        F.col(workload).alias("omitted"), F.round(F.try_divide(F.col("_r") - F.col("topk_recall"), rest), 6).alias("mean_recall"),
        F.round(F.try_divide(F.col("_h") - F.col("hit").cast("int"), rest), 6).alias("hit_rate"),
    )


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, both standard deviations (the sample's is 0 for one row), extremes and interpolated quantiles."""
    basic = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stddev"),
        F.round(F.stddev_pop(value), 6).alias("stddev_pop"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    found = quantiles(rows, by, value, shares).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[F.round(c, 6).alias(c) for c in shares])
    return basic.join(found, same(by), "left").select(*by, "n", "mean", "median", "stddev", "stddev_pop", "min", "p95", "p99", "max")


def relative_mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median distance from the median, by the median."""
    middle = quantiles(rows, by, value, {"_m": 0.5})
    away = rows.join(middle, by).withColumn("_away", F.abs(F.col(value) - F.col("_m")))
    return middle.join(quantiles(away, by, "_away", {"_d": 0.5}), by).select(*by, F.round(F.try_divide("_d", "_m"), 8).alias("relative_mad"))


def holm(tests: DataFrame, family: list[str], label: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Holm-Bonferroni in each family: adjusted p and whether it is rejected. Ties in p go by label."""
    order = W.partitionBy(*family).orderBy(p, label)
    left = F.count("*").over(W.partitionBy(*family)) - F.row_number().over(order) + 1
    stepped = tests.withColumns({"_left": left})
    running = order.rowsBetween(W.unboundedPreceding, 0)
    return stepped.withColumns(
        {
            "adjusted": F.round(F.max(F.least(F.lit(1.0), F.col(p) * F.col("_left"))).over(running), 8),
            "rejected": F.min(F.col(p) <= alpha / F.col("_left")).over(running),
        }
    ).select(*tests.columns, "adjusted", "rejected")


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test, null without wins and losses. Binomial sums go through logarithms of factorials, so counts of a few
    thousand are no limit."""

    def exact(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for w, l in it:
            yield pd.Series([_sign(int(a), int(b)) for a, b in zip(w, l)], dtype="object").astype("float64")

    return F.pandas_udf(exact, "double")(wins, losses)


def _sign(wins: int, losses: int) -> float | None:
    n, k = wins + losses, min(wins, losses)
    if not n:
        return None
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def paired(pairs: DataFrame, by: list[str], lower_is_better: bool = True) -> DataFrame:
    """Rows (by, baseline, treatment): wins, ties, losses, improvements (above 0 is better), their share of the baseline, the ratio of the geometric
    means, effect size and sign test."""
    gain = F.col("baseline") - F.col("treatment") if lower_is_better else F.col("treatment") - F.col("baseline")
    rows = pairs.withColumn("_d", gain)
    d = F.col("_d")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d > TOLERANCE).alias("wins"), F.count_if(F.abs(d) <= TOLERANCE).alias("ties"), F.count_if(d < -TOLERANCE).alias("losses"),
        F.round(F.avg(d), 6).alias("mean_improvement"), F.round(F.avg(d / F.abs(F.nullif("baseline", F.lit(0.0)))), 8).alias("mean_relative_improvement"),
        F.round(F.exp(F.avg(F.when((F.col("baseline") > 0) & (F.col("treatment") > 0), F.log(F.col("treatment") / F.nullif("baseline", F.lit(0.0)))))), 8).alias("geometric_ratio"),
        F.round(F.try_divide(F.avg(d), F.stddev_samp(d)), 8).alias("effect_size"),
    )
    out = with_median(out, rows, by, "_d", "_m").withColumns({"median_improvement": F.round("_m", 6), "win_rate": F.round(F.try_divide("wins", F.col("wins") + F.col("losses")), 8)}).drop("_m")
    return out.withColumn("sign_p", F.round(sign_test(F.col("wins"), F.col("losses")), 8))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, rounds: int = 2000, seed: int = 1337, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean. In each round every value counts as often as a Poisson number of mean 1 says, drawn by a hash of the value,
    its place among equal ones and the round: the usual resampling for data of any size. Values are dealt to tasks once a block of 32 rounds."""
    tied = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    each = tied.select(*by, "_x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_c"))
    words = each.select(*by, "_x", "_c", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // 32) - 1))).alias("_w"))
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]).tolist()

    def drawn(k: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), "_w", F.lit(k), "_x", "_c"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        return reduce(lambda a, b: a + b, [(u >= p).cast("int") for p in steps])

    sums = words.groupBy(*by, "_w").agg(*[F.struct(F.sum(F.col("_x") * drawn(k)).alias("s"), F.sum(drawn(k)).alias("n")).alias(f"_{k}") for k in range(32)])
    means = sums.select(*by, "_w", F.posexplode(F.array(*[F.col(f"_{k}") for k in range(32)])).alias("_k", "_s")).where(F.col("_w") * 32 + F.col("_k") < rounds)
    means = means.select(*by, F.try_divide("_s.s", "_s.n").alias("_mean"))  # as many rows a group as rounds
    ends = quantiles(means, by, "_mean", {"low": (1 - level) / 2, "high": (1 + level) / 2})
    return rows.groupBy(*by).agg(F.avg(value).alias("mean")).join(ends, by)


def sign_flip(rows: DataFrame, by: list[str], value: str, rounds: int = 2000, seed: int = 1337) -> DataFrame:
    """One-sided sign-flip randomisation of the mean: exact for at most 20 values a group, else ``rounds`` draws of all signs and
    (hits + 1) / (rounds + 1). Null values count for nothing; a group without values has a null p_value.

    All 2^n sign patterns are rows of a range, exploded against the small group's array. Signs of larger groups are bits of hashes of
    the value's place among equal ones, so draws don't depend on the order of rows; 32 rounds are summed at once and no group is collected."""
    if rounds < 1000:
        raise ValueError("rounds must be at least 1000")
    counted = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    least = counted.where("_n <= 20").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    same = lambda: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.lit(True))
    small = rows.join(least, same(), "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_v")).withColumn("_n", F.size("_v")).where("_n > 0")
    flips = small.where("_n <= 20").select(*by, "_v", "_n", F.explode(F.expr("sequence(0L, shiftleft(1L, _n) - 1)")).alias("_mask"))
    stat = F.expr("aggregate(transform(_v, (x, i) -> if((shiftright(_mask, i) & 1) = 1, -x, x)), cast(0 as double), (a, x) -> a + x) / _n")
    seen = F.expr("aggregate(_v, cast(0 as double), (a, x) -> a + x) / _n")
    exact = flips.groupBy(*by).agg(F.round(F.avg((stat >= seen - 1e-15).cast("double")), 8).alias("p_value"))
    tied = rows.where(F.col(value).isNotNull()).join(least, same(), "left_anti").groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    each = tied.select(*by, "_x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_c"))
    words = each.select(*by, "_x", "_c", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // 32) - 1))).alias("_w"))
    bits = F.xxhash64(F.lit(seed), "_w", "_x", "_c")
    signed = [F.sum(F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.col("_x")).otherwise(-F.col("_x"))).alias(f"_s{k}") for k in range(32)]
    sums = words.groupBy(*by, "_w").agg(F.sum("_x").alias("_t"), F.count("*").alias("_n"), *signed)
    hit = lambda k: ((F.col("_w") * 32 + k < rounds) & (F.col(f"_s{k}") / F.col("_n") >= F.col("_t") / F.col("_n") - 1e-15)).cast("long")
    drawn = sums.groupBy(*by).agg(F.round((F.sum(reduce(lambda a, b: a + b, map(hit, range(32)))) + 1) / (rounds + 1), 8).alias("p_value"))
    known = exact.unionByName(drawn).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "p_value")
    return counted.select(*by).join(known, same(), "left").select(*by, "p_value")


def normal_equations(rows: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Least squares with an intercept: the sums are Spark's, the solution of the small system numpy's. Adds r2 and n."""
    names = ["1", *xs]
    column = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    sums = [F.sum(column(a) * column(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(column(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(names)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")]
    r = rows.dropna(subset=[y, *xs]).agg(*sums).first()
    xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    xy = np.array([r[f"y{i}"] for i in range(len(names))], float)
    beta = np.linalg.solve(xx, xy)
    residual, total = r["yy"] - beta @ xy, r["yy"] - xy[0] ** 2 / r["n"]
    return {"intercept": beta[0], **dict(zip(xs, beta[1:])), "r2": 1 - residual / total, "n": r["n"]}


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Rows (expected, predicted, n, accuracy): the matrix in long form, with each expected label's accuracy."""
    cells = rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(expected))
    right = F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0)).over(W.partitionBy(expected))
    return cells.withColumn("accuracy", F.round(right / total, 8))


def normalised_path(path: Column) -> Column:
    """A request's path with digests, UUIDs, whole numbers and overlong segments replaced, so that paths are few."""
    segment = lambda x: (
        F.when(x.rlike("^[0-9a-fA-F]{64}$"), ":sha256").when(x.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), ":uuid").when(x.rlike("^[0-9]{1,20}$"), ":int").when(F.length(x) > 80, ":opaque").otherwise(x)
    )
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), segment), "/"))


def route_metrics(requests: DataFrame, limit: int = 64) -> DataFrame:
    """Rows (method, path, status, first_seen, duration) to requests, 4xx and 5xx answers, mean and largest duration a method and normalised path; routes
    beyond the ``limit`` first seen fold into ``/:other`` of their method."""
    named = requests.withColumn("path", normalised_path(F.col("path")))
    status = F.col("status")
    each = named.groupBy("method", "path").agg(
        F.min("first_seen").alias("_f"), F.count("*").alias("n"), F.count_if((status >= 400) & (status < 500)).alias("x4"), F.count_if(status >= 500).alias("x5"), F.sum("duration").alias("_d"), F.max("duration").alias("_m")
    )
    listed = each.orderBy("_f", "method", "path").limit(limit).select(F.col("method").alias("_km"), F.col("path").alias("_kp"))
    met = each.join(F.broadcast(listed), (F.col("method") == F.col("_km")) & (F.col("path") == F.col("_kp")), "left").withColumn("path", F.coalesce("_kp", F.lit("/:other")))
    return met.groupBy("method", "path").agg(
        F.sum("n").alias("requests"), F.sum("x4").alias("errors_4xx"), F.sum("x5").alias("errors_5xx"), F.round(F.sum("_d") / F.sum("n"), 3).alias("duration_mean"), F.round(F.max("_m"), 3).alias("duration_max")
    )


def _points(spark, sf_dir) -> DataFrame:
    """Brands as workloads, parts as candidates: list price predicts the mean line price a unit."""
    unit = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("measured"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("predicted"))
    return part.join(unit, "p_partkey").withColumn("measured", F.round("measured", 4))


_POINTS = "p AS (SELECT p_partkey, p_brand, p_retailprice AS predicted, round(measured, 4) AS measured FROM part JOIN (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS measured FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"
_SELECTION = f"""{_POINTS},
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY predicted, p_partkey) AS rp, row_number() OVER (PARTITION BY p_brand ORDER BY measured, p_partkey) AS rm FROM p),
s AS (SELECT p_brand, max(p_partkey) FILTER (rp = 1) AS selected, max(p_partkey) FILTER (rm = 1) AS oracle, max(measured) FILTER (rp = 1) AS s, max(measured) FILTER (rm = 1) AS o,
        count(*) FILTER (rp <= 3 AND rm <= 3) / least(3, count(*)) AS recall FROM r GROUP BY 1)"""
_RANKS = "k AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY predicted) + (count(*) OVER (PARTITION BY p_brand, predicted) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY measured) + (count(*) OVER (PARTITION BY p_brand, measured) - 1) / 2 AS b FROM p)"
_KENDALL = """pr AS (SELECT a.p_brand, sign(a.predicted - b.predicted) AS x, sign(a.measured - b.measured) AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey),
kc AS (SELECT p_brand, count(*) FILTER (x * y > 0) AS c, count(*) FILTER (x * y < 0) AS d, count(*) FILTER (x = 0 AND y <> 0) AS tx, count(*) FILTER (x <> 0 AND y = 0) AS ty FROM pr GROUP BY 1),
kd AS (SELECT p_brand, round(CASE WHEN (c + d + tx) * (c + d + ty) > 0 THEN (c - d) / sqrt(((c + d + tx) * (c + d + ty))::DOUBLE) END, 8) AS kendall FROM kc)"""


@query(
    "prediction_error",
    f"WITH {_POINTS} SELECT p_brand, count(*) AS n, round(avg(abs(predicted - measured)), 6) AS mae, round(sqrt(avg((predicted - measured) ** 2)), 6) AS rmse, round(avg(predicted - measured), 6) AS bias, "
    "round(max(abs(predicted - measured)), 6) AS max_error, round(avg(abs((predicted - measured) / measured)) FILTER (measured <> 0), 8) AS mape FROM p GROUP BY 1",
)
def _errors(spark, sf_dir):
    return prediction_errors(_points(spark, sf_dir), ["p_brand"])


@query("rank_correlation", f"WITH {_POINTS}, {_RANKS} SELECT p_brand, round(corr(predicted, measured), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM k GROUP BY 1")
def _correlations(spark, sf_dir):
    return correlations(_points(spark, sf_dir), ["p_brand"])


@query("kendall_tau_b", f"WITH {_POINTS}, {_KENDALL} SELECT p_brand, kendall FROM kd")
def _kendall(spark, sf_dir):
    return kendall(_points(spark, sf_dir), ["p_brand"], "p_partkey")


@query(
    "selection_regret",
    f"WITH {_SELECTION} SELECT p_brand, selected, oracle, selected = oracle AS hit, round(greatest(0, s - o), 6) AS regret, round(greatest(0, s - o) / nullif(o, 0), 8) AS relative_regret, round(recall, 8) AS topk_recall FROM s",
)
def _selection(spark, sf_dir):
    return selection(_points(spark, sf_dir), ["p_brand"], "p_partkey")


@query(
    "held_out_evaluation",
    f"""WITH {_SELECTION}, {_RANKS}, {_KENDALL}, c AS (SELECT p_brand, round(corr(a, b), 8) AS spearman FROM k GROUP BY 1),
j AS (SELECT *, round(greatest(0, s - o), 6) AS regret, round(recall, 8) AS rec FROM s JOIN c USING (p_brand) JOIN kd USING (p_brand))
SELECT count(*) AS workloads, round(avg((selected = oracle)::INT), 8) AS hit_rate, round(avg(regret), 6) AS mean_regret, round(median(regret), 6) AS median_regret, round(avg(rec), 8) AS mean_recall,
round(avg(spearman), 6) AS mean_spearman, round(avg(kendall), 6) AS mean_kendall FROM j""",
)
def _held_out(spark, sf_dir):
    return held_out(_points(spark, sf_dir), "p_brand", "p_partkey")


@query(
    "leave_one_workload_out",
    f"WITH {_SELECTION} SELECT a.p_brand AS omitted, round(avg(round(b.recall, 8)), 6) AS mean_recall, round(avg((b.selected = b.oracle)::INT), 6) AS hit_rate FROM s a JOIN s b ON a.p_brand <> b.p_brand GROUP BY 1",
)
def _leave_out(spark, sf_dir):
    return leave_one_out(_points(spark, sf_dir), "p_brand", "p_partkey")


@query(
    "quantile_summary",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(coalesce(stddev_samp(l_extendedprice), 0), 6) AS stddev, "
    "round(stddev_pop(l_extendedprice), 6) AS stddev_pop, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, max(l_extendedprice) AS max FROM lineitem GROUP BY 1, 2",
)
def _summary(spark, sf_dir):
    return summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query(
    "relative_mad",
    "SELECT o_orderpriority, round(median(abs(o_totalprice - m)) / m, 8) AS relative_mad FROM orders JOIN (SELECT o_orderpriority, median(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY o_orderpriority, m",
)
def _mad(spark, sf_dir):
    return relative_mad(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


_TESTS = "t AS (SELECT p_brand, p_type, round(min((p_partkey * 37 % 1009) / 1009.0), 8) AS p FROM part GROUP BY 1, 2)"


@query(
    "holm_bonferroni",
    f"""WITH {_TESTS}, o AS (SELECT *, count(*) OVER (PARTITION BY p_brand) - row_number() OVER w + 1 AS l FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY p, p_type))
SELECT p_brand, p_type, p, round(max(least(1.0, p * l)) OVER v, 8) AS adjusted, bool_and(p <= 0.05 / l) OVER v AS rejected FROM o WINDOW v AS (PARTITION BY p_brand ORDER BY p, p_type ROWS UNBOUNDED PRECEDING)""",
)
def _holm(spark, sf_dir):
    p = F.round(F.min((F.col("p_partkey") * 37 % 1009) / F.lit(1009.0)), 8)
    return holm(table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(p.alias("p")), ["p_brand"], "p_type", "p")


_PAIRS = "d AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS baseline, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS treatment FROM lineitem GROUP BY 1, 2), e AS (FROM d WHERE baseline IS NOT NULL AND treatment IS NOT NULL)"


def _pairs(spark, sf_dir) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(mean("F").alias("baseline"), mean("O").alias("treatment")).dropna()


@query(
    "paired_analysis",
    f"""WITH {_PAIRS}, i AS (SELECT *, baseline - treatment AS d FROM e), g AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses,
round(avg(d), 6) AS mean_improvement, round(avg(d / abs(baseline)) FILTER (baseline <> 0), 8) AS mean_relative_improvement, round(exp(avg(ln(treatment / baseline))), 8) AS geometric_ratio,
round(avg(d) / stddev_samp(d), 8) AS effect_size, round(median(d), 6) AS median_improvement FROM i GROUP BY 1)
SELECT *, round(wins / (wins + losses), 8) AS win_rate, round(least(1, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) * 2 FROM range(0, least(wins, losses) + 1) AS x(i))), 8) AS sign_p FROM g""",
)
def _paired(spark, sf_dir):
    return paired(_pairs(spark, sf_dir), ["l_returnflag"])


@query("bootstrap_interval")
def _bootstrap(spark, sf_dir):
    return bootstrap_mean(_pairs(spark, sf_dir).withColumn("d", F.col("baseline") - F.col("treatment")), ["l_returnflag"], "d")


_FLIPS = "f AS (SELECT n_regionkey, n_name, round(avg(c_acctbal), 2) - 4500 AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"


@query(
    "sign_flip_test",
    f"""WITH {_FLIPS}, v AS (SELECT n_regionkey, list(v ORDER BY v) AS v, len(list(v)) AS n FROM f GROUP BY 1), m AS (SELECT *, unnest(range(0, 1 << n)) AS mask FROM v),
s AS (SELECT n_regionkey, list_sum(list_transform(v, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -x ELSE x END)) / n >= list_sum(v) / n - 1e-15 AS hit FROM m)
SELECT n_regionkey, round(avg(hit::INT), 8) AS p_value FROM s GROUP BY 1""",
)
def _sign_flip(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sign_flip(nation.groupBy("n_regionkey", "n_name").agg((F.round(F.avg("c_acctbal"), 2) - 4500).alias("v")), ["n_regionkey"], "v")


@query("sign_flip_monte_carlo")
def _sign_flip_drawn(spark, sf_dir):
    return sign_flip(table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") - 4500).alias("v")), ["c_nationkey"], "v")


@query(
    "linear_fit",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem",
)
def _fit(spark, sf_dir):
    fit = normal_equations(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(fit["l_quantity"]), 6), round(float(fit["intercept"]), 4), round(float(fit["r2"]), 8))], "slope double, intercept double, r2 double")


@query(
    "classifier_confusion",
    """WITH c AS (SELECT CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS expected,
CASE WHEN q >= 130 THEN 'large' WHEN q >= 60 THEN 'medium' ELSE 'small' END AS predicted FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
n AS (SELECT expected, predicted, count(*) AS n FROM c GROUP BY 1, 2)
SELECT *, round(sum(CASE WHEN expected = predicted THEN n ELSE 0 END) OVER w / sum(n) OVER w, 8) AS accuracy FROM n WINDOW w AS (PARTITION BY expected)""",
)
def _confusion(spark, sf_dir):
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "orders").join(size, "o_orderkey")
    band = lambda c, a, b: F.when(c >= a, "large").when(c >= b, "medium").otherwise("small")
    return confusion(rows.select(band(F.col("o_totalprice"), 300000, 100000).alias("expected"), band(F.col("q"), 130, 60).alias("predicted")), "expected", "predicted")


@query(
    "route_metrics",
    """WITH e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type || '/' || CASE WHEN user_id % 2 = 0 THEN ':int' ELSE 'u' || (user_id % 40) END AS path, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status, event_id, value FROM events),
g AS (SELECT method, path, min(event_id) AS f, count(*) AS n, count(*) FILTER (status BETWEEN 400 AND 499) AS x4, count(*) FILTER (status >= 500) AS x5, sum(value) AS d, max(value) AS m FROM e GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY f, method, path) <= 64 THEN path ELSE '/:other' END AS r FROM g)
SELECT method, r AS path, sum(n)::BIGINT AS requests, sum(x4)::BIGINT AS errors_4xx, sum(x5)::BIGINT AS errors_5xx, round(sum(d) / sum(n), 3) AS duration_mean, round(max(m), 3) AS duration_max FROM r GROUP BY 1, 2""",
)
def _routes(spark, sf_dir):
    last = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    requests = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("//"), "event_type", F.lit("/"), last).alias("path"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200).alias("status"), F.col("event_id").alias("first_seen"), F.col("value").alias("duration"),
    )
    return route_metrics(requests)
