"""Access traces from text, CSV and JSON: one column of integer keys in file order, bad rows told apart rather than guessed at.

Files are read by Spark's readers, text and CSV in splits, JSON a file at a time (a JSON file is one value), so any store that Spark reads will do.
Several files follow one another by name. Only the first file's head and a handful of flags come to the driver, to settle format, separator and key
column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY_COLUMNS = ("key", "id", "item_id", "record_id", "object_id", "entity_id")  # fixed: columns that may be meant without a name
SEPARATORS = (",", ";", "\t", "|")
HEAD = 8192
MAX_KEY = (1 << 53) - 1


def _head(spark: SparkSession, path: str) -> str:
    """The beginning of the first file."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return ""
    lines = spark.read.text(files[0]).where("_metadata.file_block_start = 0").select(F.substring("value", 1, HEAD)).limit(100).collect()
    return "\n".join(r[0] for r in lines)[:HEAD]


def detect_format(head: str) -> str:
    """json by its first bracket, text if all tokens are integers, csv if a separator or a known column shows, else text."""
    start = head.lstrip()
    if start[:1] in ("[", "{"):
        return "json"
    tokens = [t for t in re.split(r"[\s,;]+", head.strip()) if t]
    if tokens and all(re.fullmatch(r"[+-]?\d+", t) for t in tokens[:-1] or tokens):
        return "text"
    first = start.splitlines()[0] if start else ""
    return "csv" if any(s in first for s in SEPARATORS) or first.strip() in KEY_COLUMNS else "text"


def integer_key(raw: Column) -> Column:
    """The key as a long, null where it is none: signs are allowed, fractions and anything beyond 2^53 - 1 are not."""
    text = F.trim(raw)
    value = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("long"))
    return F.when(F.abs(value) <= MAX_KEY, value)


def _numbered(raw: DataFrame) -> DataFrame:
    return raw.select("pos", integer_key(F.col("raw")).alias("key"), "raw")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line, _f, _s, _i): lines of all files; file, split and place tell their order."""
    meta = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i")]
    return spark.read.text(path).select(F.col("value").alias("line"), *meta)


def _placed(rows: DataFrame, amount: Column) -> DataFrame:
    """Add _at: the units before each row, file after file by name. They are counted a split at a time, so no task reads more than a split."""
    counted = rows.withColumn("_n", amount.cast("long"))
    sums = counted.groupBy("_f", "_s").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a split
    within = F.coalesce(F.sum("_n").over(W.partitionBy("_f", "_s").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.join(sums.select("_f", "_s", before.alias("_b")), ["_f", "_s"]).withColumn("_at", F.col("_b") + within)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Tokens between white space, commas and semicolons."""
    tokens = _lines(spark, path).withColumn("_t", F.filter(F.split("line", r"[\s,;]+"), lambda x: x != ""))
    each = _placed(tokens, F.size("_t")).select("_at", F.posexplode("_t").alias("_k", "raw"))
    return _numbered(each.withColumn("pos", F.col("_at") + F.col("_k")))


def read_csv(spark: SparkSession, path: str, key_field: str | None = None) -> DataFrame:
    """A named column, the only column, or the one column with a known name."""
    lines = [x for x in _head(spark, path).splitlines() if x.strip()]
    if not lines:
        raise ValueError("empty trace")
    sep = max(SEPARATORS, key=lambda s: lines[0].count(s))
    names = [n.strip().strip('"') for n in lines[0].split(sep)]
    known = [n for n in names if n.lower() in KEY_COLUMNS]
    if key_field is not None and key_field not in names:
        raise ValueError(f"no column {key_field}")
    name = key_field or (names[0] if len(names) == 1 else known[0] if len(known) == 1 else None)
    if name is None:
        raise ValueError("the key column is ambiguous" if known else "no key column")
    header = not re.fullmatch(r"[+-]?\d+", names[names.index(name)])
    rows = _lines(spark, path).where(F.trim(F.regexp_replace("line", r"\r$", "")) != "")
    if header:  # of each file
        first = rows.groupBy("_f").agg(F.min(F.struct("_s", "_i")).alias("_h")).select("_f", "_h._s", "_h._i")
        rows = rows.join(first, ["_f", "_s", "_i"], "left_anti")
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    cell = F.from_csv(F.regexp_replace("line", r"\r$", ""), schema, {"sep": sep})[f"_{names.index(name)}"]
    return _numbered(_placed(rows, F.lit(1)).select(F.col("_at").alias("pos"), cell.alias("raw")))


def read_json(spark: SparkSession, path: str, key_field: str | None = None) -> DataFrame:
    """An array, or an object that holds one under keys, events or records; scalars, or objects with a (dotted) key path. Repeated object
    keys raise."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.col("_metadata.file_path").alias("_f"))
    array = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.keys", "$.events", "$.records")])
    before = F.coalesce(F.sum(F.size(array)).over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    starts = whole.select("_f", before.alias("_b"))
    items = whole.select("_f", F.posexplode(array).alias("_k", "item")).join(starts, "_f").select((F.col("_b") + F.col("_k")).cast("long").alias("pos"), "item")
    kinds = {r[0] for r in items.select(F.when(F.schema_of_variant("item").startswith("OBJECT"), "object").otherwise("scalar").alias("k")).distinct().limit(2).collect()}
    if len(kinds) != 1:
        raise ValueError("an empty trace, or scalars and objects mixed")
    if kinds == {"scalar"}:
        return _numbered(items.select("pos", F.to_json("item").alias("raw")))
    if key_field is None:
        there = items.agg(*[F.count_if(F.try_variant_get("item", f"$.{k}", "variant").isNotNull()).alias(k) for k in KEY_COLUMNS], F.count("*").alias("_n")).first()
        full = [k for k in KEY_COLUMNS if there[k] == there["_n"]]
        if len(full) != 1:
            raise ValueError("the key field is ambiguous" if full else "no key field")
        key_field = full[0]
    raw = F.to_json(F.try_variant_get("item", f"$.{key_field}", "variant"))
    return _numbered(items.select("pos", F.regexp_replace(F.regexp_replace(raw, '^"|"$', ""), r"^([+-]?\d+)\.0+$", "$1").alias("raw")))


def read_trace(spark: SparkSession, path: str, format: str | None = None, key_field: str | None = None, allow_invalid: bool = False, max_keys: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(trace, rejected): rows (pos, key) numbered over the valid rows, and the rows that hold no key. Rejected rows raise unless they
    are allowed; fewer than two keys, or more than ``max_keys``, always do."""
    format = format or detect_format(_head(spark, path))
    rows = {"text": read_text, "csv": read_csv, "json": read_json}[format](spark, path, *([key_field] if format != "text" else []))
    good, bad = rows.where("key IS NOT NULL"), rows.where("key IS NULL").select("pos", "raw")
    counts = rows.agg(F.count("key").alias("good"), F.count("*").alias("all")).first()
    if counts["all"] > counts["good"] and not allow_invalid:
        raise ValueError(f"{counts['all'] - counts['good']} rows hold no integer key")
    if counts["good"] < 2 or (max_keys is not None and counts["good"] > max_keys):
        raise ValueError(f"{counts['good']} keys")
    if counts["all"] > counts["good"]:
        ranged = good.withColumn("_r", F.floor(F.col("pos") / 65536))
        sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        within = F.row_number().over(W.partitionBy("_r").orderBy("pos")) - 1
        good = ranged.join(before.select("_r", "_b"), "_r").withColumn("pos", (F.col("_b") + within).cast("long"))
    return good.select("pos", "key"), bad
