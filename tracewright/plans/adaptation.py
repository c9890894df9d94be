"""Adaptation policies over phases, decisions with cooldown, fenced mutations and migration state machines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table


def decide(observations: DataFrame, margin: float = 0.1, cost_weight: float = 1.5) -> DataFrame:
    """Rows (.., sequence, last_switch, cooldown, drifted, benefit, cost) to a decision: cooling down, then no drift, then whether the
    benefit is above cost_weight * cost * (1 + margin). An unknown drift holds nothing back."""
    needed = cost_weight * F.col("cost") * (1 + margin)
    return observations.withColumn(
        "decision",
        F.when(F.col("sequence") <= F.col("last_switch") + F.col("cooldown"), "COOLDOWN").when(~F.col("drifted"), "KEEP").when((F.col("benefit") > needed) & (F.col("benefit") > 0), "ADAPT").otherwise("NOT_WORTH"),
    )


def never_switch(costs: DataFrame, start: str) -> DataFrame:
    """Rows (scenario, phase, design, queries, per_query) to the total cost of staying with ``start``."""
    return costs.where(F.col("design") == start).groupBy("scenario").agg(F.round(F.sum(F.col("queries") * F.col("per_query")), 6).alias("total"))


def _policies(phases: list[tuple[int, dict[str, float]]], start: str, costs: dict[tuple[str, str], float], weight: float, margin: float, cooldown: int) -> dict[str, tuple[float, list[str]]]:
    """Total cost and path of each policy over phases (queries, cost a query of each design)."""

    def move(a: str, b: str) -> float:
        return 0.0 if a == b else costs[a, b]

    def total(path: list[str]) -> float:
        return sum(n * per[d] for (n, per), d in zip(phases, path)) + sum(move(a, b) for a, b in zip([start, *path], path))

    cheapest = [min(per, key=lambda d: (per[d], d)) for _, per in phases]
    now, last, careful = start, None, []
    for k, ((n, per), target) in enumerate(zip(phases, cheapest)):
        gain = max(0.0, n * per[now] - n * per[target])
        if target != now and (last is None or k > last + cooldown) and gain > weight * move(now, target) * (1 + margin):
            now, last = target, k
        careful.append(now)
    reach = {start: (0.0, [])}
    for n, per in phases:  # dynamic programme over the design in use; of equal costs the path that comes first
        reach = {d: min((c + move(e, d) + n * per[d], [*path, d]) for e, (c, path) in reach.items()) for d in sorted(per)}
    paths = {"NEVER": [start] * len(phases), "IMMEDIATE": cheapest, "TRANSITION_AWARE": careful, "OFFLINE_ORACLE": min(reach.values())[1]}
    return {name: (total(path), path) for name, path in paths.items()}


def policy_costs(
    costs: DataFrame, start: str, switch: float | dict[tuple[str, str], float], cost_weight: float = 1.5, margin: float = 0.1, cooldown: int = 0
) -> DataFrame:
    """Total cost, regret against the oracle, switches and path of each policy, a scenario at a time: each decision depends on the one before, a
    scenario has few phases, and scenarios run side by side.

    ``switch`` is one cost, or a cost for each pair of designs; a pair that is needed and missing raises. TRANSITION_AWARE moves to a phase's cheapest
    design if that saves more than cost_weight * cost * (1 + margin), and not within ``cooldown`` phases of its last move."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        phases = [(int(g["queries"].iloc[0]), dict(zip(g["design"], g["per_query"].astype(float)))) for _, g in pdf.sort_values(["phase", "design"]).groupby("phase")]
        designs = {d for _, per in phases for d in per}
        pairs = switch if isinstance(switch, dict) else {(a, b): float(switch) for a in designs for b in designs}
        found = _policies(phases, start, pairs, cost_weight, margin, cooldown)
        best = found["OFFLINE_ORACLE"][0]
        rows = [(pdf["scenario"].iloc[0], p, round(t, 6), round(t - best, 6), sum(a != b for a, b in zip([start, *path], path)), ">".join(path)) for p, (t, path) in found.items()]
        return pd.DataFrame(rows, columns=["scenario", "policy", "total", "regret", "switches", "path"])

    return costs.groupBy("scenario").applyInPandas(run, "scenario string, policy string, total double, regret double, switches int, path string")


def fence(mutations: DataFrame, resource: str, order: str, counter: str, digest: str) -> DataFrame:
    """Status of each attempt at a fenced resource: a lower counter than seen is STALE, the same with the same digest IDEMPOTENT, with
    another CONFLICT, a higher one APPLIED. The digest that counts is the first that came with a counter."""
    before = W.partitionBy(resource).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    first = W.partitionBy(resource, counter).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen, settled = F.max(counter).over(before), F.first(digest).over(first)
    return mutations.withColumns({"_s": seen, "_d": settled}).withColumn(
        "status",
        F.when(F.col("_s").isNull() | (F.col(counter) > F.col("_s")), "APPLIED").when(F.col(counter) < F.col("_s"), "STALE").when(F.col(digest) == F.col("_d"), "IDEMPOTENT").otherwise("CONFLICT"),
    ).drop("_s", "_d")


LEGAL = {None: ("PLANNED",), "PLANNED": ("SHADOW_BUILT", "ABORTED"), "SHADOW_BUILT": ("VERIFIED", "ABORTED"), "VERIFIED": ("COMMITTED", "ABORTED"), "COMMITTED": ("ROLLED_BACK",)}


def illegal_transitions(log: DataFrame, machine: str, order: str, state: str) -> DataFrame:
    """Log rows whose state may not follow the one before it."""
    previous = F.lag(state).over(W.partitionBy(machine).orderBy(order))
    legal: Column = F.lit(False)
    for before, after in LEGAL.items():
        legal |= (F.col("_p").isNull() if before is None else F.col("_p") == before) & F.col(state).isin(*after)
    return log.withColumn("_p", previous).where(~F.coalesce(legal, F.lit(False))).withColumnRenamed("_p", "previous")


def monotone_sessions(steps: DataFrame, session: str, arrival: str, sequence: str) -> DataFrame:
    """Accept a step if its sequence is above every sequence of its session so far."""
    seen = F.max(sequence).over(W.partitionBy(session).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    return steps.withColumn("accepted", F.col(sequence) > F.coalesce(seen, F.lit(-1)))


_COSTS = "c AS (SELECT c_mktsegment AS scenario, year(o_orderdate) AS phase, o_orderpriority AS design, count(*) * 100 AS queries, round(avg(o_totalprice) / 100000, 6) AS per_query FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"


def _costs(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy(F.col("c_mktsegment").alias("scenario"), F.year("o_orderdate").alias("phase"), F.col("o_orderpriority").alias("design")).agg(
        (F.count("*") * 100).alias("queries"), F.round(F.avg("o_totalprice") / 100000, 6).alias("per_query")
    )


def _complete(costs: DataFrame) -> DataFrame:
    """Every design in every phase, so that policies can stay: absent ones cost what the dearest does."""
    grid = costs.select("scenario", "phase").distinct().join(costs.select("scenario", "design").distinct(), "scenario")
    worst = costs.groupBy("scenario", "phase").agg(F.max("per_query").alias("_w"), F.max("queries").alias("_q"))
    out = grid.join(costs.drop("queries"), ["scenario", "phase", "design"], "left").join(worst, ["scenario", "phase"])
    return out.select("scenario", "phase", "design", F.col("_q").alias("queries"), F.coalesce("per_query", "_w").alias("per_query"))


@query("never_switch", f"WITH {_COSTS} SELECT scenario, round(sum(queries * per_query), 6) AS total FROM c WHERE design = '1-URGENT' GROUP BY 1")
def _never(spark, sf_dir):
    return never_switch(_costs(spark, sf_dir), "1-URGENT")


@query("policy_regret")
def _policy(spark, sf_dir):
    return policy_costs(_complete(_costs(spark, sf_dir)), "1-URGENT", 50.0)


@query(
    "adaptation_decision",
    f"""WITH {_COSTS}, g AS (SELECT scenario, phase, min(queries * per_query) AS best, max(queries * per_query) AS worst, row_number() OVER (PARTITION BY scenario ORDER BY phase) AS n FROM c GROUP BY 1, 2)
SELECT scenario, phase, CASE WHEN n <= 2 THEN 'COOLDOWN' WHEN NOT (worst - best) / worst >= 0.2 THEN 'KEEP' WHEN worst - best > best * 0.3 * 1.5 * 1.1 THEN 'ADAPT' ELSE 'NOT_WORTH' END AS decision FROM g""",
)
def _decide(spark, sf_dir):
    spent = F.col("queries") * F.col("per_query")
    g = _costs(spark, sf_dir).groupBy("scenario", "phase").agg(F.min(spent).alias("best"), F.max(spent).alias("worst"))
    o = g.withColumns(
        {
            "sequence": F.row_number().over(W.partitionBy("scenario").orderBy("phase")), "last_switch": F.lit(0), "cooldown": F.lit(2),
            "drifted": (F.col("worst") - F.col("best")) / F.col("worst") >= 0.2, "benefit": F.col("worst") - F.col("best"), "cost": F.col("best") * 0.3,
        }
    )
    return decide(o).select("scenario", "phase", "decision")


@query(
    "fenced_mutations",
    """WITH e AS (SELECT event_id, user_id, (event_id // 100) + (value > 60)::INT AS c, event_type AS d FROM events), s AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
first_value(d) OVER (PARTITION BY user_id, c ORDER BY event_id) AS f FROM e)
SELECT event_id, user_id, c, d, CASE WHEN s IS NULL OR c > s THEN 'APPLIED' WHEN c < s THEN 'STALE' WHEN d = f THEN 'IDEMPOTENT' ELSE 'CONFLICT' END AS status FROM s""",
)
def _fence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor(F.col("event_id") / 100) + (F.col("value") > 60).cast("int")).alias("c"), F.col("event_type").alias("d"))
    return fence(e, "user_id", "event_id", "c", "d")


_STATES = "['PLANNED', 'SHADOW_BUILT', 'VERIFIED', 'COMMITTED', 'ROLLED_BACK']"


@query(
    "illegal_transitions",
    f"""WITH e AS (SELECT o_custkey, o_orderkey, {_STATES}[1 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + (o_orderkey % 7 = 0)::INT) % 5] AS state FROM orders),
l AS (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM e)
SELECT * FROM l WHERE NOT coalesce(CASE previous WHEN 'PLANNED' THEN state IN ('SHADOW_BUILT', 'ABORTED') WHEN 'SHADOW_BUILT' THEN state IN ('VERIFIED', 'ABORTED') WHEN 'VERIFIED' THEN state IN ('COMMITTED', 'ABORTED')
WHEN 'COMMITTED' THEN state = 'ROLLED_BACK' WHEN 'ROLLED_BACK' THEN false ELSE state = 'PLANNED' END, false)""",
)
def _transitions(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1 + (F.col("o_orderkey") % 7 == 0).cast("int")
    state = F.element_at(F.array(*map(F.lit, ("PLANNED", "SHADOW_BUILT", "VERIFIED", "COMMITTED", "ROLLED_BACK"))), (1 + n % 5).cast("int"))
    return illegal_transitions(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", state.alias("state")), "o_custkey", "o_orderkey", "state")


@query(
    "monotone_sessions",
    "WITH s AS (SELECT event_id, user_id, (value * 10)::BIGINT AS seq FROM events) SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM s",
)
def _sessions(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("event_id", "user_id", F.rint(F.col("value") * 10).cast("long").alias("seq"))
    return monotone_sessions(steps, "user_id", "event_id", "seq")
