"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes too.

Everything is a SQL expression over one row, so a document is never shuffled: the only stage is the scan. A word is
``[^\\x20\\x09-\\x0D]+``. Repeated three-word windows are found by sorting one long per window (its hash above, its
position below) and comparing neighbours, word by word where the hashes agree. Where they agree and the words don't, which only very long texts
see, whole hashes are sorted beside positions.

Defined results: a null text has no words and no lines, all counts are 0 and the base rules reject it, as they reject an
empty one. Equal lines keep their first copy. Repeated rows are judged one by one. Columns of the input whose names
clash with a result's are replaced; all others pass through ``clean_lines``. An empty table gives no rows. A text of any length is judged whole,
within its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents

SPACE = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Parameters of the rules.
MAX_SYMBOL_SHARE = 0.08  # symbols by the non-space characters of a line
MIN_NAV_BARS = 3  # separators " | " that make a line a menu
MIN_SHOUT_WORDS = 3  # words of an all-capitals line
MIN_MARK_RUNS = 2  # runs such as "!!" or "??"
MAX_MENU_WORDS = 2  # words of an unpunctuated line that counts as a menu entry
BOILERPLATE = (
    "all rights reserved|licensed under|license, version|privacy policy|terms of (use|service)|cookie|"
    "enable javascript|subscribe to|sign up|copyright|lorem ipsum|back to top|skip to content"
)
MIN_KEPT_SHARE = 0.5  # characters in surviving lines by those in all lines

LINE_RULES = {
    "symbols": f"length(l) - length(translate(l, '{SYMBOLS}', '')) > {MAX_SYMBOL_SHARE} * length(regexp_replace(l, '{SPACE}', ''))",
    "navigation": f"length(l) - length(translate(l, '|', '')) >= {MIN_NAV_BARS}",
    "shouting": f"upper(l) = l AND lower(l) <> l AND size(split(trim(l), '{SPACE}')) >= {MIN_SHOUT_WORDS}",
    "marks": f"size(split(l, '[!?]{{2,}}')) > {MIN_MARK_RUNS}",
    "boilerplate": f"rlike(lower(l), '{BOILERPLATE}')",
    "menu": f"NOT rlike(l, '[.!?:;,…\"\\'»)]') AND size(split(trim(l), '{SPACE}')) <= {MAX_MENU_WORDS}",
}


def _let(value: str, name: str, body: str) -> str:
    """``value`` computed once and called ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words(bits: str = "") -> str:
    """Words of ``w`` inside three-word windows that occur twice or more. ``bits`` replaces the number of low bits that hold a position."""

    def covered(marks: str) -> str:
        """From pairs of positions that start equal windows (null: no pair; [-1]: windows of one key that differ)."""
        at = f"sort_array(array_distinct(flatten(filter({marks}, x -> x is not null))))"
        total = "aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least(3L, b - a)), 3L, (c, x) -> c + x)"
        return _let(at, "p", f"if(size(p) = 0, 0L, if(p[0] < 0, -1L, {total}))")

    def neighbours(key_a: str, key_b: str, a: str, b: str) -> str:
        same = " AND ".join(f"w[cast({a} as int) + {j}] = w[cast({b} as int) + {j}]" for j in range(3))
        return f"zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if({key_a} = {key_b}, if({same}, array({a}, {b}), array(-1L)), null))"

    window = "xxhash64(w[i], w[i + 1], w[i + 2])"
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> ({window} & ~k) | cast(i as bigint)))"
    whole = f"sort_array(transform(sequence(0, size(w) - 3), i -> struct({window} AS h, cast(i as bigint) AS i)))"
    low = f"shiftleft(1L, {bits or 'cast(ceil(log2(size(w))) as int)'}) - 1"
    fast = _let(low, "k", _let(packed, "s", covered(neighbours("(a & ~k)", "(b & ~k)", "(a & k)", "(b & k)"))))
    slow = _let(whole, "s", covered(neighbours("a.h", "b.h", "a.i", "b.i").replace("array(-1L)", "null")))
    return f"if(size(w) < 4, 0L, {_let(fast, 'n', f'if(n >= 0, n, {slow})')})"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = f"coalesce({text}, '')"
    words = f"filter(split({t}, '{SPACE}'), x -> x <> '')"
    counted = _let(words, "w", f"struct(cast(size(w) as bigint) AS n, {_repeated_words()} AS r)")
    lines = f"filter(split({t}, '\\n'), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))"
    out = df.withColumns(
        {
            "_counted": F.expr(counted),
            "word_chars": F.expr(f"cast(length(regexp_replace({t}, '{SPACE}', '')) as bigint)"),
            "n_symbols": F.expr(f"cast(length({t}) - length(translate({t}, '{SYMBOLS}', '')) as bigint)"),
            "n_dup_lines": F.expr(_let(lines, "q", "cast(size(q) - size(array_distinct(q)) as bigint)")),
        }
    )
    out = out.withColumns({"n_words": F.col("_counted.n"), "n_repeat_words": F.col("_counted.r")}).drop("_counted")
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add cleaned_text, failed_rules (one array per removed line), n_lines, n_removed_lines, line_chars and kept_chars.

    A line is a ``\\n``-split piece with a word. It goes if it fails a rule or equals an earlier line.
    """
    lines = f"filter(split(coalesce({text}, ''), '\\n'), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))"
    failed = ", ".join(f"if({rule}, '{name}', null)" for name, rule in LINE_RULES.items())
    judged = f"transform(d, l -> struct(l AS line, filter(array({failed}), x -> x is not null) AS failed))"
    kept = _let(
        judged,
        "j",
        "struct(array_join(transform(filter(j, x -> size(x.failed) = 0), x -> x.line), '\\n') AS text,"
        " transform(filter(j, x -> size(x.failed) > 0), x -> x.failed) AS failed,"
        " aggregate(filter(j, x -> size(x.failed) = 0), 0L, (c, x) -> c + length(x.line)) AS chars)",
    )
    both = _let(lines, "q", f"struct(size(q) AS n, aggregate(q, 0L, (c, x) -> c + length(x)) AS chars, {_let('array_distinct(q)', 'd', f'struct(size(d) AS n, {kept} AS k)')} AS d)")
    out = df.withColumn("_lines", F.expr(both))
    return out.withColumns(
        {
            "cleaned_text": F.col("_lines.d.k.text"),
            "failed_rules": F.col("_lines.d.k.failed"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_removed_lines": F.expr("cast(_lines.n - _lines.d.n + size(_lines.d.k.failed) as bigint)"),
            "line_chars": F.col("_lines.chars"),
            "kept_chars": F.col("_lines.d.k.chars"),
        }
    ).drop("_lines")


def verdict(min_kept_share: float = MIN_KEPT_SHARE):
    """Column: the document passes the base rules and its surviving lines hold enough of its text."""
    return ~F.col("base_failed") & (F.col("kept_chars") >= min_kept_share * F.col("line_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(word_counts(documents(spark, sf_dir).select("doc_id", "text")))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    return judged.select(*columns, verdict().alias("kept"), "n_lines", "n_removed_lines", "kept_chars")


_RE_SPACE = r"[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_RE_SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS q
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r CROSS JOIN range(3) AS o(j) GROUP BY doc_id),
l AS (
  SELECT doc_id, l,
    (length(l) - length(translate(l, '{SYMBOLS}', '')) > {MAX_SYMBOL_SHARE} * length(regexp_replace(l, '{_RE_SPACE}', '', 'g'))
     OR length(l) - length(translate(l, '|', '')) >= {MIN_NAV_BARS}
     OR (upper(l) = l AND lower(l) <> l AND len(regexp_split_to_array(trim(l), '{_RE_SPACE}')) >= {MIN_SHOUT_WORDS})
     OR len(regexp_split_to_array(l, '[!?]{{2,}}')) > {MIN_MARK_RUNS}
     OR regexp_matches(lower(l), '{BOILERPLATE}')
     OR (NOT regexp_matches(l, '[.!?:;,…"''»)]') AND len(regexp_split_to_array(trim(l), '{_RE_SPACE}')) <= {MAX_MENU_WORDS})) AS failed
  FROM (SELECT doc_id, unnest(list_distinct(q)) AS l FROM d)),
k AS (SELECT doc_id, sum(CASE WHEN failed THEN 0 ELSE length(l) END) AS chars, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS n_failed FROM l GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{_RE_SPACE}', '', 'g')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(q) - len(list_distinct(q)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, coalesce(list_sum(list_transform(q, lambda x: length(x))), 0) AS line_chars,
        coalesce(k.chars, 0) AS kept_chars, len(q) AS n_lines, len(q) - len(list_distinct(q)) + coalesce(n_failed, 0) AS n_removed_lines
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= {MIN_KEPT_SHARE} * line_chars AS kept,
  n_lines, CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(kept_chars AS BIGINT) AS kept_chars
FROM a
"""
