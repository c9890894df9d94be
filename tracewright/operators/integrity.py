"""Hash-chained ledgers, evidence digests, metadata joins and record verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table

ZEROS = "0" * 64
PART = 1 << 16


def entry_hash(previous: str = "previous_hash"):
    return F.sha2(F.concat_ws("\n", F.col(previous), F.col("timestamp"), F.col("kind"), F.col("subject"), F.col("payload")), 256)


def ledger_append(entries: DataFrame, ledger: list[str], previous: DataFrame | None = None) -> DataFrame:
    """Rows (ledger, sequence, timestamp, kind, subject, payload) with previous_hash and entry_hash: each entry names the hash of the one before it. Each
    ledger goes on from its last entry in ``previous`` (ledger, entry_hash). A hash needs the one before, so an append to one ledger is one row's work."""
    part = F.struct("sequence", "timestamp", "kind", "subject", "payload")
    batch = entries.groupBy(*ledger).agg(F.array_sort(F.collect_list(part)).alias("_e"))
    batch = batch.withColumn("_last", F.lit(None).cast("string")) if previous is None else batch.join(previous.select(*ledger, F.col("entry_hash").alias("_last")), ledger, "left")
    chained = F.expr(
        f"""aggregate(_e, array(coalesce(_last, '{ZEROS}')),
          (h, e) -> concat(h, array(sha2(concat_ws('\n', element_at(h, -1), e.timestamp, e.kind, e.subject, e.payload), 256))))"""
    )
    each = batch.withColumn("_h", chained).select(*ledger, F.posexplode("_e").alias("_i", "_x"), "_h")
    return each.select(*ledger, "_x.*", F.col("_h")[F.col("_i")].alias("previous_hash"), F.col("_h")[F.col("_i") + 1].alias("entry_hash"))


def ledger_breaks(entries: DataFrame, ledger: list[str] | None = None) -> DataFrame:
    """Entries (sequence from 0 without gaps in each ledger) whose hash is not their own, or whose predecessor's is not the one they name."""
    ledger = ledger or []
    before = entries.select(*ledger, (F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("_prev"))
    met = entries.join(before, [*ledger, "sequence"], "left").withColumn("_prev", F.when(F.col("sequence") == 0, ZEROS).otherwise(F.coalesce("_prev", F.lit("missing"))))
    return met.where((F.col("previous_hash") != F.col("_prev")) | (F.col("entry_hash") != entry_hash())).select(*ledger, "sequence", (F.col("entry_hash") != entry_hash()).alias("altered"))


def ledger_verdict(entries: DataFrame, ledger: list[str] | None = None) -> DataFrame:
    """A row a ledger: entries, altered entries, and the first broken sequence (null if the chain holds)."""
    ledger, breaks = ledger or [], ledger_breaks(entries, ledger)
    broken = breaks.groupBy(*ledger).agg(F.min("sequence").alias("first_break"), F.count_if("altered").alias("altered"))
    counted = entries.groupBy(*ledger).agg(F.count("*").alias("entries"))
    met = counted.join(broken, ledger, "left") if ledger else counted.crossJoin(broken)  # a row each
    return met.withColumn("altered", F.coalesce("altered", F.lit(0)))


def evidence_digest(digests: DataFrame, by: list[str], digest: str) -> DataFrame:
    """One hash over a set's distinct digests, whatever their order. A set is the evidence of one claim, which is small."""
    return digests.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(digest)), "\n"), 256).alias("chain"))


def claim_gate(present: DataFrame, required: DataFrame, claim: str, role: str) -> DataFrame:
    """Whether each claim's required roles are all there, and which are missing."""
    met = required.join(present.select(claim, role).distinct().withColumn("_t", F.lit(True)), [claim, role], "left")
    return met.groupBy(claim).agg(F.min(F.coalesce("_t", F.lit(False))).alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_t").isNull(), F.col(role)))), ",").alias("missing"))


def complete_pairs(samples: DataFrame, unit: list[str], condition: str, conditions: list[str]) -> DataFrame:
    """Units with every condition exactly once."""
    return samples.where(F.col(condition).isin(conditions)).groupBy(*unit).agg(F.countDistinct(condition).alias("_d"), F.count("*").alias("_n")).where((F.col("_d") == len(conditions)) & (F.col("_n") == len(conditions))).select(*unit)


def summaries(parents: DataFrame, children: DataFrame, key: str, time: str) -> DataFrame:
    """Parents with how many children they have and the last child's time, latest first."""
    counts = children.groupBy(key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return parents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.col("last").desc_nulls_last(), key)


def unresolved(ambiguous: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    return ambiguous.join(resolutions.select(key), key, "left_anti")


def idempotency(requests: DataFrame, journal: DataFrame, key: str, digest: str, resolutions: DataFrame | None = None) -> DataFrame:
    """Outcome of each request against the journal (one row a key: digest, state) and the resolutions (one row a key: resolution) of failures whose
    side effect was unknown."""
    j = journal.select(key, F.col(digest).alias("_d"), F.col("state").alias("_s"))
    met = requests.join(j, key, "left")
    met = met.withColumn("_r", F.lit(None).cast("string")) if resolutions is None else met.join(resolutions.select(key, F.col("resolution").alias("_r")), key, "left")
    return met.withColumn(
        "outcome",
        F.when(F.col("_s").isNull(), "NEW").when(F.col("_d") != F.col(digest), "CONFLICT").when(F.col("_s") == "COMPLETED", "REPLAY").when(F.col("_s") == "PENDING", "IN_PROGRESS")
        .when(F.col("_r") == "SIDE_EFFECT_PRESENT", "RESOLVED_SIDE_EFFECT").otherwise("AMBIGUOUS"),
    ).drop("_d", "_s", "_r")


def contiguous(log: DataFrame, lineage: list[str], sequence: str, time: str, outcome: str, terminal: str) -> DataFrame:
    """Lineages whose sequence has a gap, whose time does not rise, or that go on after a terminal outcome."""
    order = W.partitionBy(*lineage).orderBy(sequence)
    marked = log.withColumns(
        {
            "_gap": F.col(sequence) != F.lag(sequence).over(order) + 1, "_back": F.col(time) <= F.lag(time).over(order),
            "_ended": F.max((F.col(outcome) == terminal).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)) == 1,
        }
    )
    flags = [F.max(F.coalesce(f"_{c}", F.lit(False))).alias(a) for c, a in (("gap", "has_gap"), ("back", "time_falls"), ("ended", "after_end"))]
    return marked.groupBy(*lineage).agg(*flags).where("has_gap OR time_falls OR after_end")


def verify_records(stored: DataFrame, content: str, size: str, digest: str, fields: dict[str, str]) -> DataFrame:
    """Checks of stored JSON records: byte count, digest, exactly the expected keys, and each named field equal to a column."""
    parsed = F.try_parse_json(content)
    keys = F.json_object_keys(content)
    checks = {
        "size_ok": F.octet_length(content) == F.col(size), "digest_ok": F.sha2(content, 256) == F.col(digest),
        "keys_ok": F.coalesce(F.array_sort(keys) == F.array_sort(F.array(*map(F.lit, fields))), F.lit(False)),
        "fields_ok": F.coalesce(F.forall(F.array(*[F.try_variant_get(parsed, f"$.{k}", "string").eqNullSafe(F.col(c).cast("string")) for k, c in fields.items()]), lambda x: x), F.lit(False)),
    }
    return stored.withColumns(checks).withColumn("verified", F.col("size_ok") & F.col("digest_ok") & F.col("keys_ok") & F.col("fields_ok"))


def _ledgers(spark, sf_dir) -> DataFrame:
    """A ledger a user and ten thousand events; every 97th event is altered afterwards."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ledger"), F.floor(F.col("event_id") / 10000).alias("part"), "event_id", F.col("event_id").cast("string").alias("timestamp"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.col("props").alias("payload")
    )
    numbered = e.withColumn("sequence", (F.row_number().over(W.partitionBy("ledger", "part").orderBy("event_id")) - 1).cast("long")).drop("event_id")
    return ledger_append(numbered, ["ledger", "part"]).withColumn("payload", F.when(F.col("timestamp").cast("long") % 97 == 96, "altered").otherwise(F.col("payload")))


@query(
    "ledger_verify",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS ledger, event_id // 10000 AS part, row_number() OVER (PARTITION BY user_id, event_id // 10000 ORDER BY event_id) - 1 AS sequence, event_id, event_id::VARCHAR AS ts, event_type AS kind, user_id::VARCHAR AS subject, props AS payload FROM events),
c AS (SELECT ledger, part, sequence, event_id, '{ZEROS}' AS prev, sha256(concat_ws(chr(10), '{ZEROS}', ts, kind, subject, payload)) AS h FROM e WHERE sequence = 0
UNION ALL SELECT e.ledger, e.part, e.sequence, e.event_id, c.h, sha256(concat_ws(chr(10), c.h, e.ts, e.kind, e.subject, e.payload)) FROM c JOIN e ON e.ledger = c.ledger AND e.part = c.part AND e.sequence = c.sequence + 1),
l AS (SELECT c.*, e.ts, e.kind, e.subject, CASE WHEN c.event_id % 97 = 96 THEN 'altered' ELSE e.payload END AS payload FROM c JOIN e USING (event_id)),
v AS (SELECT *, h <> sha256(concat_ws(chr(10), prev, ts, kind, subject, payload)) AS bad, prev <> coalesce(lag(h) OVER (PARTITION BY ledger, part ORDER BY sequence), '{ZEROS}') AS torn FROM l)
SELECT ledger, part, count(*) AS entries, min(sequence) FILTER (bad OR torn) AS first_break, count(*) FILTER (bad) AS altered FROM v GROUP BY 1, 2""",
)
def _ledger(spark, sf_dir):
    return ledger_verdict(_ledgers(spark, sf_dir), ["ledger", "part"])


@query("evidence_digest", "SELECT user_id, sha256(string_agg(DISTINCT sha256(event_type), chr(10) ORDER BY sha256(event_type))) AS chain FROM events GROUP BY 1")
def _evidence(spark, sf_dir):
    return evidence_digest(table(spark, sf_dir, "events").select("user_id", F.sha2("event_type", 256).alias("d")), ["user_id"], "d")


@query(
    "claim_gate",
    "WITH r AS (SELECT c_custkey, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS role FROM customer), j AS (SELECT c_custkey, role, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = role) AS ok FROM r) "
    "SELECT c_custkey, bool_and(ok) AS passed, coalesce(string_agg(role, ',' ORDER BY role) FILTER (NOT ok), '') AS missing FROM j GROUP BY 1",
)
def _gate(spark, sf_dir):
    required = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))).alias("role"))
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("role"))
    return claim_gate(present, required, "c_custkey", "role")


@query(
    "complete_pairs",
    "SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 3 AND count(*) = 3",
)
def _complete_pairs(spark, sf_dir):
    return complete_pairs(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_returnflag", ["A", "N", "R"])


@query(
    "complete_pairs_whole",
    "SELECT l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2, 3 HAVING count(DISTINCT l_returnflag) = 3 AND count(*) = 3",
)
def _complete_pairs_whole(spark, sf_dir):
    return complete_pairs(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber", "l_quantity"], "l_returnflag", ["A", "N", "R"])


@query("workload_summaries", "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def _summaries(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return summaries(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_orderdate")


@query("runs_with_artifacts", "SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority = '2-HIGH'")
def _runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_orderdate").join(lines, "o_orderkey").orderBy("o_orderkey", "l_linenumber", "l_partkey")


@query("unresolved", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _unresolved(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return unresolved(pending, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(
    "idempotency_outcomes",
    "WITH j AS (SELECT o_custkey AS k, max(o_orderpriority) AS d, CASE count(*) % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PENDING' ELSE 'AMBIGUOUS' END AS state FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
    "s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') "
    "SELECT c_custkey AS k, '5-LOW' AS d, CASE WHEN state IS NULL THEN 'NEW' WHEN j.d <> '5-LOW' THEN 'CONFLICT' WHEN state = 'COMPLETED' THEN 'REPLAY' WHEN state = 'PENDING' THEN 'IN_PROGRESS' WHEN s.k IS NOT NULL THEN 'RESOLVED_SIDE_EFFECT' ELSE 'AMBIGUOUS' END AS outcome "
    "FROM customer LEFT JOIN j ON j.k = c_custkey LEFT JOIN s ON s.k = c_custkey",
)
def _idempotency(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    state = F.element_at(F.array(*map(F.lit, ("COMPLETED", "PENDING", "AMBIGUOUS"))), (F.count("*") % 3 + 1).cast("int"))
    journal = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("d"), state.alias("state"))
    resolved = orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct().withColumn("resolution", F.lit("SIDE_EFFECT_PRESENT"))
    return idempotency(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("5-LOW").alias("d")), journal, "k", "d", resolved)


@query(
    "lineage_violations",
    """WITH s AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + (value > 150)::INT AS seq FROM events),
m AS (SELECT user_id, seq <> lag(seq) OVER w + 1 AS gap, ts <= lag(ts) OVER w AS back, max((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AS ended FROM (SELECT user_id, seq, max(ts) AS ts, max(event_type) AS event_type FROM s GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
g AS (SELECT user_id, bool_or(coalesce(gap, false)) AS has_gap, bool_or(coalesce(back, false)) AS time_falls, bool_or(coalesce(ended, false)) AS after_end FROM m GROUP BY 1) SELECT * FROM g WHERE has_gap OR time_falls OR after_end""",
)
def _lineage(spark, sf_dir):
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) + (F.col("value") > 150).cast("int")
    log = table(spark, sf_dir, "events").withColumn("seq", seq).groupBy("user_id", "seq").agg(F.max("ts").alias("ts"), F.max("event_type").alias("event_type"))
    return contiguous(log, ["user_id"], "seq", "ts", "event_type", "error")


@query("record_verification", "SELECT event_id, length(props) % 2 = 0 OR event_id % 5 > 0 AS size_ok, event_id % 7 > 0 AS digest_ok, true AS keys_ok, event_id % 3 > 0 AS fields_ok, (length(props) % 2 = 0 OR event_id % 5 > 0) AND event_id % 7 > 0 AND event_id % 3 > 0 AS verified FROM events")
def _verification(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    size = F.octet_length("props") + F.when((F.octet_length("props") % 2 != 0) & (F.col("event_id") % 5 == 0), 1).otherwise(0)
    k = F.get_json_object("props", "$.k").cast("long") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    stored = e.withColumns({"_size": size, "_digest": F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.sha2("props", 256)), "_k": k})
    return verify_records(stored, "props", "_size", "_digest", {"k": "_k"}).select("event_id", "size_ok", "digest_ok", "keys_ok", "fields_ok", "verified")
