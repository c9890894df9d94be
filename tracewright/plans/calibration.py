"""Calibration lookups and coverage, interpolation between scales, and reducers of benchmark sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import quantiles, same, with_median
from ..registry import query, table

SCOPE = ("primitive", "operation", "implementation", "distribution")


def best_match(wanted: DataFrame, measured: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """The best measurement of each wanted scope, nulls equal: most repetitions, then least deviation (unknown last), then least time. The best of
    each scope is found before the join."""
    rank = F.struct(-F.col("repetitions"), F.col("stdev_ns").isNull(), "stdev_ns", "ns_per_op")
    best = measured.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(scope)]).agg(F.min_by(F.struct("repetitions", "stdev_ns", "ns_per_op"), rank).alias("_m"))
    met = wanted.select(*scope).distinct().join(best, same(list(scope)), "left")
    return met.select(*scope, "_m.repetitions", "_m.stdev_ns", "_m.ns_per_op")


def coverage(required: DataFrame, measured: DataFrame, max_age: int) -> DataFrame:
    """Status of each required (primitive, operation, distribution, scale): MATCHED, STALE_ONLY, SCALE_MISMATCH,
    DISTRIBUTION_MISMATCH or MISSING, the first that holds. Measurements are counted by cell, distribution and operation before they are joined."""
    by = ["primitive", "operation", "distribution", "scale"]
    cells = measured.where("distribution is not null").groupBy(*by).agg(F.max((F.col("age") <= max_age).cast("int")).alias("_fresh"))
    kinds = cells.select(*by[:3]).distinct().withColumn("_kind", F.lit(1))
    operations = cells.select(*by[:2]).distinct().withColumn("_operation", F.lit(1))
    met = required.select(*by).distinct().join(cells, by, "left").join(kinds, by[:3], "left").join(operations, by[:2], "left")
    status = F.when(F.col("_fresh") == 1, "MATCHED").when(F.col("_fresh") == 0, "STALE_ONLY").when(F.col("_kind") == 1, "SCALE_MISMATCH").when(F.col("_operation") == 1, "DISTRIBUTION_MISMATCH").otherwise("MISSING")
    return met.select(*by, status.alias("status"))


def coverage_ratio(statuses: DataFrame) -> DataFrame:
    """One row: how many required cells there are, how many are matched, and their share."""
    return statuses.agg(F.count("*").alias("required"), F.count_if(F.col("status") == "MATCHED").alias("matched")).withColumn("ratio", F.round(F.try_divide("matched", "required"), 8))


def interpolation_errors(surface: DataFrame, by: list[str], scale: str, value: str) -> DataFrame:
    """Interior scales of each series (three or more) predicted from their neighbours on log-log axes."""
    order = W.partitionBy(*by).orderBy(scale)
    near = surface.withColumns({"_x0": F.lag(scale).over(order), "_x1": F.lead(scale).over(order), "_y0": F.lag(value).over(order), "_y1": F.lead(value).over(order)})
    inner = near.where("_x0 IS NOT NULL AND _x1 IS NOT NULL")
    share = (F.log(scale) - F.log("_x0")) / (F.log("_x1") - F.log("_x0"))
    predicted = F.exp(F.log("_y0") + share * (F.log("_y1") - F.log("_y0")))
    return inner.select(*by, scale, value, F.round(predicted, 6).alias("predicted"), F.round(F.abs(predicted - F.col(value)) / F.col(value), 8).alias("ape"))


def surface_metrics(errors: DataFrame, by: list[str], value: str) -> DataFrame:
    """MAE, MAPE, log error and how many predictions are within 10, 20 and 50 %."""
    within = lambda x: F.round(F.avg((F.col("ape") <= x).cast("double")), 8).alias(f"within_{int(x * 100)}")
    return errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col(value))), 5).alias("mae"), F.round(F.avg("ape"), 6).alias("mape"),
        F.round(F.sqrt(F.avg(F.pow(F.log(F.col("predicted") / F.col(value)), 2))), 6).alias("rms_log_error"), within(0.1), within(0.2), within(0.5),
    )


def sweep(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and extremes of repeated timings."""
    basic = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_median(basic, rows, by, value).withColumn("median", F.round("median", 6))


def crossover(rows: DataFrame, scale: list[str], side: str, sides: tuple[str, str], value: str) -> DataFrame:
    """Ratio of two representations' medians at each scale, the winner and its advantage in percent."""
    a, b = sides
    medians = quantiles(rows.where(F.col(side).isin(a, b)), [*scale, side], value, {"_m": 0.5})
    wide = medians.groupBy(*scale).pivot(side, [a, b]).agg(F.max("_m")).dropna(subset=[a, b])
    ratio = F.col(a) / F.col(b)
    return wide.select(
        *scale, F.round(ratio, 8).alias("ratio"), F.when(F.col(a) < F.col(b), a).when(F.col(b) < F.col(a), b).otherwise("tie").alias("winner"),
        F.round((F.greatest(a, b) / F.least(a, b) - 1) * 100, 6).alias("advantage_percent"),
    )


def stable_threshold(ratios: DataFrame, by: list[str], scale: str, k: int = 3, margin: float = 0.05) -> DataFrame:
    """First point of the first run of k consecutive scales whose median ratio is at most 1 - margin and whose worst is at most 1;
    null if there is none."""
    good = (F.col("median_ratio") <= 1 - margin) & (F.col("worst_ratio") <= 1)
    order = W.partitionBy(*by).orderBy(scale)
    islands = ratios.withColumn("_g", good).withColumn("_i", F.sum(F.when(F.col("_g"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = islands.where("_g").groupBy(*by, "_i").agg(F.min(scale).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    found = runs.groupBy(*by).agg(F.min("_first").alias("threshold"))
    return ratios.select(*by).distinct().join(found, by, "left")


def agreement(rows: DataFrame, by: list[str], checksum: str) -> DataFrame:
    """Whether all implementations of a case came to the same result."""
    return rows.groupBy(*by).agg((F.countDistinct(checksum) == 1).alias("agrees"), F.count("*").alias("n"))


_SURFACE = "s AS (SELECT l_returnflag AS operation, l_quantity AS scale, round(avg(l_extendedprice), 6) AS ns FROM lineitem GROUP BY 1, 2)"


def _surface(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("scale")).agg(F.round(F.avg("l_extendedprice"), 6).alias("ns"))


_INTERP = f"{_SURFACE}, n AS (SELECT *, lag(scale) OVER w AS x0, lead(scale) OVER w AS x1, lag(ns) OVER w AS y0, lead(ns) OVER w AS y1 FROM s WINDOW w AS (PARTITION BY operation ORDER BY scale)), p AS (SELECT operation, scale, ns, exp(ln(y0) + (ln(scale) - ln(x0)) / (ln(x1) - ln(x0)) * (ln(y1) - ln(y0))) AS p FROM n WHERE x0 IS NOT NULL AND x1 IS NOT NULL), e AS (SELECT operation, scale, ns, round(p, 6) AS predicted, round(abs(p - ns) / ns, 8) AS ape FROM p)"


@query("scale_interpolation", f"WITH {_INTERP} FROM e")
def _interpolation(spark, sf_dir):
    return interpolation_errors(_surface(spark, sf_dir), ["operation"], "scale", "ns")


@query(
    "surface_metrics",
    f"WITH {_INTERP} SELECT operation, count(*) AS n, round(avg(abs(predicted - ns)), 5) AS mae, round(avg(ape), 6) AS mape, round(sqrt(avg(ln(predicted / ns) ** 2)), 6) AS rms_log_error, "
    "round(avg((ape <= 0.1)::INT), 8) AS within_10, round(avg((ape <= 0.2)::INT), 8) AS within_20, round(avg((ape <= 0.5)::INT), 8) AS within_50 FROM e GROUP BY 1",
)
def _metrics(spark, sf_dir):
    return surface_metrics(interpolation_errors(_surface(spark, sf_dir), ["operation"], "scale", "ns"), ["operation"], "ns")


_MEASURED = "m AS (SELECT p_brand AS primitive, p_type AS operation, CASE WHEN p_size % 5 > 0 THEN 'impl' || (p_size % 5) END AS implementation, CASE p_size % 2 WHEN 0 THEN 'uniform' ELSE 'zipf' END AS distribution, p_size AS repetitions, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 17 END AS stdev_ns, p_retailprice AS ns_per_op FROM part)"


def _measured(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS primitive", "p_type AS operation", "if(p_size % 5 > 0, concat('impl', p_size % 5), null) AS implementation", "if(p_size % 2 = 0, 'uniform', 'zipf') AS distribution", "p_size AS repetitions",
        "if(p_partkey % 3 > 0, p_partkey % 17, null) AS stdev_ns", "p_retailprice AS ns_per_op", "p_size AS scale", "p_partkey % 10 AS age",
    )


@query(
    "calibration_best_match",
    f"WITH {_MEASURED} SELECT primitive, operation, implementation, distribution, repetitions, stdev_ns, ns_per_op FROM m QUALIFY row_number() OVER (PARTITION BY primitive, operation, implementation, distribution ORDER BY repetitions DESC, stdev_ns NULLS LAST, ns_per_op) = 1",
)
def _best(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return best_match(m, m)


@query(
    "calibration_coverage",
    f"""WITH {_MEASURED}, k AS (SELECT p_brand AS primitive, p_type AS operation, CASE p_size % 2 WHEN 0 THEN 'uniform' ELSE 'zipf' END AS d, p_size AS n, p_partkey % 10 AS age FROM part),
r AS (SELECT * FROM (SELECT DISTINCT p_brand AS primitive FROM part), (SELECT DISTINCT p_type AS operation FROM part), (VALUES ('uniform'), ('zipf'), ('hotspot')) x(distribution), (VALUES (4), (9), (30)) y(scale)),
g AS (SELECT r.primitive, r.operation, distribution, scale, count(*) FILTER (d = distribution AND n = scale AND age <= 4) AS a, count(*) FILTER (d = distribution AND n = scale) AS b, count(*) FILTER (d = distribution) AS c, count(d) AS e FROM r LEFT JOIN k USING (primitive, operation) GROUP BY ALL)
SELECT primitive, operation, distribution, scale, CASE WHEN a > 0 THEN 'MATCHED' WHEN b > 0 THEN 'STALE_ONLY' WHEN c > 0 THEN 'SCALE_MISMATCH' WHEN e > 0 THEN 'DISTRIBUTION_MISMATCH' ELSE 'MISSING' END AS status FROM g""",
)
def _coverage(spark, sf_dir):
    m = _measured(spark, sf_dir)
    axes = spark.createDataFrame([(d, n) for d in ("uniform", "zipf", "hotspot") for n in (4, 9, 30)], "distribution string, scale int")
    required = m.select("primitive").distinct().crossJoin(m.select("operation").distinct()).crossJoin(F.broadcast(axes))  # 25 brands, 6 types, 9 cells
    return coverage(required, m, 4)


@query(
    "calibration_coverage_ratio",
    f"""WITH {_MEASURED}, r AS (SELECT * FROM (SELECT DISTINCT p_brand AS primitive FROM part), (SELECT DISTINCT p_type AS operation FROM part), (VALUES ('uniform'), ('zipf'), ('hotspot')) x(distribution), (VALUES (4), (9), (30)) y(scale)),
k AS (SELECT DISTINCT p_brand AS primitive, p_type AS operation, CASE p_size % 2 WHEN 0 THEN 'uniform' ELSE 'zipf' END AS distribution, p_size AS scale FROM part WHERE p_partkey % 10 <= 4)
SELECT count(*) AS required, count(k.scale) AS matched, round(count(k.scale) / count(*), 8) AS ratio FROM r LEFT JOIN k USING (primitive, operation, distribution, scale)""",
)
def _coverage_ratio(spark, sf_dir):
    return coverage_ratio(_coverage(spark, sf_dir))


_SWEEP = "s AS (SELECT l_linestatus AS side, l_quantity AS scale, l_linenumber AS op, l_extendedprice AS ns FROM lineitem)"


def _sweep(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("scale"), F.col("l_linenumber").alias("op"), F.col("l_extendedprice").alias("ns"))


@query("sweep_medians", f"WITH {_SWEEP} SELECT side, scale, count(*) AS n, round(median(ns), 6) AS median, min(ns) AS min, max(ns) AS max FROM s GROUP BY 1, 2")
def _sweep_query(spark, sf_dir):
    return sweep(_sweep(spark, sf_dir), ["side", "scale"], "ns")


_CROSS = f"{_SWEEP}, w AS (SELECT scale, op, median(ns) FILTER (side = 'F') AS a, median(ns) FILTER (side = 'O') AS b FROM s GROUP BY 1, 2), x AS (SELECT *, round(a / b, 8) AS ratio FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"


@query("representation_crossover", f"WITH {_CROSS} SELECT scale, op, ratio, CASE WHEN a < b THEN 'F' WHEN b < a THEN 'O' ELSE 'tie' END AS winner, round((greatest(a, b) / least(a, b) - 1) * 100, 6) AS advantage_percent FROM x")
def _crossover(spark, sf_dir):
    return crossover(_sweep(spark, sf_dir), ["scale", "op"], "side", ("F", "O"), "ns")


@query(
    "stable_threshold",
    """WITH d AS (SELECT l_quantity AS scale, l_linenumber AS op, median(30000 + 1000 * l_tax) / median(l_extendedprice) AS ratio FROM lineitem GROUP BY 1, 2), g AS (SELECT scale % 3 AS family, scale, median(round(ratio, 8)) AS m, max(round(ratio, 8)) AS w FROM d GROUP BY 1, 2),
i AS (SELECT *, m <= 0.95 AND w <= 1 AS good, sum(CASE WHEN m <= 0.95 AND w <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY family ORDER BY scale) AS i FROM g),
r AS (SELECT family, i, min(scale) AS first FROM i WHERE good GROUP BY 1, 2 HAVING count(*) >= 3) SELECT f.family, min(first) AS threshold FROM (SELECT DISTINCT family FROM g) f LEFT JOIN r USING (family) GROUP BY 1""",
)
def _threshold(spark, sf_dir):
    """A representation whose time hardly depends on the scale against one whose time grows with it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("scale"), F.col("l_linenumber").alias("op"), "l_tax", F.col("l_extendedprice").alias("growing"))
    both = lines.select("scale", "op", F.explode(F.array(F.struct(F.lit("D").alias("side"), (30000 + 1000 * F.col("l_tax")).alias("ns")), F.struct(F.lit("S").alias("side"), F.col("growing").alias("ns")))).alias("x")).select("scale", "op", "x.side", "x.ns")
    x = crossover(both, ["scale", "op"], "side", ("D", "S"), "ns").withColumn("family", F.col("scale") % 3)
    worst = x.groupBy("family", "scale").agg(F.max("ratio").alias("worst_ratio"))
    return stable_threshold(with_median(worst, x, ["family", "scale"], "ratio", "median_ratio"), ["family"], "scale", 3, 0.05)


@query("checksum_agreement", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS agrees, count(*) AS n FROM lineitem GROUP BY 1")
def _agreement(spark, sf_dir):
    return agreement(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")
