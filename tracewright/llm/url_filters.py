"""URL filtering: a short list of host and path rules first, association rules mined by FP-growth for the rest.

A URL is a set of tokens: its scheme, its domain and top-level domain, the words of the rest of its host, path segments (digits as #), file
ending, query keys and whether it has a fragment. Labelled URLs (here those that a listed rule decides) give transactions of
tokens and label; Spark's FP-growth finds the frequent ones. A rule is a token set that implies a label with enough confidence;
a rule that is no surer than one with a token less is pruned. Rules are found by an inverted index: each is filed under its
rarest token, a URL's tokens are joined with that index, and only the rules met there are compared with the whole set. The
surest rule decides (then support, fewer tokens, block before allow); without one a URL is allowed. Distinct URLs are judged
once each.

The rules are few by the support bound; Spark broadcasts their table only while its size, which it knows as the table is
written, is under the session's limit.

Defined results: a null url, or one without ``://``, has empty host and path, no tokens and no rule; it is allowed. Without labelled
URLs nothing is mined, and an empty table gives no rows. Rules of equal confidence, support, length and verdict go by their tokens, the last in
order first. Repeated rows are judged one by one; a very long url is one row's work. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def listed_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        at = name.index("/")
        fits = (F.concat(F.lit("."), "host").endswith("." + name[:at])) & F.col("path").startswith(name[at:])
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL whose host and path are there already."""
    labels = "split(host, '\\\\.')"
    return F.expr(
        f"""array_sort(array_distinct(filter(concat(
          array(concat('scheme:', lower(substr({url}, 1, instr({url}, '://') - 1))),
                if(size({labels}) > 1, concat('domain:', element_at({labels}, -2), '.', element_at({labels}, -1)), null),
                concat('top:', element_at({labels}, -1)),
                if(rlike(path, '\\\\.[A-Za-z0-9]{{1,5}}$'), concat('ending:', lower(regexp_extract(path, '\\\\.([A-Za-z0-9]{{1,5}})$', 1))), null),
                if(contains({url}, '#'), 'fragment', null)),
          if(size({labels}) > 2, transform(filter(flatten(transform(slice({labels}, 1, size({labels}) - 2), x -> split(x, '-'))), x -> x <> ''), x -> concat('host:', x)), array()),
          transform(filter(split(path, '/'), x -> x <> ''), x -> concat('path:', regexp_replace(x, '[0-9]+', '#'))),
          transform(filter(split(regexp_extract({url}, '[?]([^#]*)', 1), '&'), x -> x <> ''), x -> concat('query:', split(x, '=')[0]))
        ), x -> x is not null AND host <> '')))"""
    )


def _twins(labelled: DataFrame, min_support: float) -> list[list[str]]:
    """Groups of frequent tokens that occur in the same rows. A row has few tokens, so there are at most tokens / min_support frequent ones."""
    row = F.xxhash64(F.monotonically_increasing_id())
    each = labelled.select(row.alias("_u"), F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor("_u").alias("x"), F.sum(F.col("_u").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")
    )
    frequent = each.where(F.col("n") >= min_support * labelled.count())
    groups = frequent.groupBy("n", "x", "s").agg(F.array_sort(F.collect_list("token")).alias("same")).where("size(same) > 1")
    return [r.same for r in groups.collect()]


def _expanded(rules: DataFrame, twins: list[list[str]]) -> DataFrame:
    """Rules with each token that stands for others replaced by each of them in turn."""
    if not twins:
        return rules
    stands = F.create_map(*[x for same in twins for x in (F.lit(same[0]), F.array(*map(F.lit, same)))])
    choices = rules.withColumn("_c", F.transform("antecedent", lambda x: F.coalesce(F.try_element_at(stands, x), F.array(x))))
    every = "aggregate(_c, array(cast(array() as array<string>)), (acc, c) -> flatten(transform(acc, a -> transform(c, t -> concat(a, array(t))))))"
    return choices.withColumn("antecedent", F.explode(F.expr(every))).withColumn("antecedent", F.array_sort("antecedent")).drop("_c")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows (antecedent, verdict, confidence, support) from rows (tokens, verdict), redundant rules pruned.

    Tokens that always occur together would make an itemset of each of their subsets, all of one confidence, of which only single tokens
    are no redundant ones. So one of them stands for all while rules are mined."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    twins = _twins(labelled, min_support)
    left_out = [t for same in twins for t in same[1:]]
    tokens_ = F.array_except("tokens", F.array(*map(F.lit, left_out))) if left_out else F.col("tokens")
    items = labelled.select(F.concat(tokens_, F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where("size(consequent) = 1 AND startswith(consequent[0], 'verdict:') AND NOT exists(antecedent, x -> startswith(x, 'verdict:'))")
    rules = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), F.expr("substr(consequent[0], 9)").alias("verdict"), "confidence", "support"), "rules")
    smaller = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("sure"))
    parts = rules.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("part"))
    redundant = parts.join(smaller, ["part", "verdict"]).where("sure >= confidence").select("antecedent", "verdict").distinct()
    return _expanded(rules.join(redundant, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support"), twins)


def index(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Rules filed under their rarest token, by the number of URLs in ``seen`` (rows of tokens) that have it."""
    counts = seen.select(F.explode("tokens").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n"))
    each = rules.withColumn("anchor", F.explode("antecedent")).join(counts, "anchor")
    rarest = each.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    return materialize(rarest, "index")


def match(urls: DataFrame, indexed: DataFrame, url: str = "url") -> DataFrame:
    """Rows (url, mined, confidence, antecedent) of the distinct urls (with tokens) that a rule decides."""
    met = urls.select(url, "tokens", F.explode("tokens").alias("anchor")).join(indexed, "anchor").where("size(array_except(antecedent, tokens)) = 0")
    rank = F.struct("confidence", "support", -F.size("antecedent"), F.col("verdict"), "antecedent")  # "block" > "allow"
    best = met.groupBy(url).agg(F.max(rank).alias("best"))
    return best.select(url, F.col("best.verdict").alias("mined"), "best.confidence", "best.antecedent")


def judge(pages: DataFrame, rules: tuple = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """Rows (key, host, path, rule, verdict, confidence, antecedent); the last two only where a mined rule decided."""
    rule, verdict = listed_rule(rules)
    parts = with_parts(pages.select(key, url), url).withColumns({"rule": rule, "listed": verdict})
    listed = parts.where("listed is not null").select(tokens(url).alias("tokens"), F.col("listed").alias("verdict"))
    indexed = index(mine(listed), listed)
    open_urls = parts.where("listed is null AND host <> ''").select(url, "host", "path").distinct().withColumn("tokens", tokens(url))
    mined = materialize(match(open_urls, indexed, url), "mined")
    return parts.join(mined, url, "left").select(
        key, "host", "path", "rule", F.coalesce("listed", F.when(F.col("rule").isNull(), F.col("mined")), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("rule").isNull(), F.col("antecedent")).alias("antecedent"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("antecedent", " ").alias("antecedent"))
