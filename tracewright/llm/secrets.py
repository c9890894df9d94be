"""Secret scans: patterns propose, a random forest trained on labelled findings removes false positives.

Every step is a DataFrame or SQL expression (Spark ML's forest included). One pattern finds the candidates of a text; the pieces
between them give each candidate its neighbouring words. Features: lengths, shares of character classes, transitions
between classes, distinct characters, runs, dictionary coverage, whether it is part of a path, the document's path, and what
words stand before it. ``scan`` only moves candidates, never texts; ``redact`` moves the texts of documents with candidates.

Labelled findings are rows (before, candidate, after, path, label). ``labelled_findings`` builds the default set of
``N_LABELLED`` rows from templates and a hash; any other such table can teach the forest. Tests hold the forest against findings of
other templates.

Defined results: null and empty texts have no candidates. Candidates don't overlap; the leftmost wins. Repeated rows are scanned
one by one. ``redact`` keeps all columns and rows, null texts as they are, and columns of any name (it works on copies of its own). An
empty table gives no rows. A text of any length is scanned whole, within its row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import documents, materialize

N_LABELLED = 9000
TREES, DEPTH, SEED = 24, 8, 17
THRESHOLD = 0.5
MASK = "[SECRET]"
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret"
ASSIGNED = rf"(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
# To the END line; if that is missing, over the headers and the base64 lines. Line breaks may be escaped. Possessive groups don't recurse.
BREAK = r"(?:\s|\\[nr])"
KEY_BLOCK = (
    rf"(?:{ASSIGNED})?-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"
    rf"|(?:{BREAK}++[A-Za-z-]{{1,30}}: [^\n]{{0,100}}+)*+(?:{BREAK}++[A-Za-z0-9+/]{{20,}}+={{0,2}})++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/]{{1,64}}+={{0,2}}(?=[ \t]*+(?:\r?\n|\z)))?+)?+"
)
CANDIDATE = "|".join(
    [
        KEY_BLOCK,
        rf"{ASSIGNED}[^\s\"'<>]{{8,}}+[\"']?",
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
        r"\bgh[pousr]_[A-Za-z0-9]{36,}+",
        r"\bxox[abprs]-[A-Za-z0-9-]{10,}+",
        r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]*+)?",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}",
    ]
)
KINDS = (
    ("private_key", rf"^(?:{ASSIGNED})?-----BEGIN"),
    ("access_key_id", r"^(AKIA|ASIA)[0-9A-Z]{16}$"),
    ("platform_token", r"^(gh[pousr]_|xox[abprs]-)"),
    ("signed_token", r"^eyJ[A-Za-z0-9_-]+\."),
    ("assignment", "^" + ASSIGNED),
)
DICTIONARY = (
    "example sample test testing dummy fake placeholder changeme change your here insert secret password token user name admin root guest "
    "default value string text none null true false key public private access auth login account email address server host local file "
    "path config setting environ process request response session context get set list map object class function method index data base "
    "image assets static build version release final draft copy page home main news blog post article item order product"
).split()
BEFORE = 80
AFTER = 40


def _found(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), F.lit(0))


def _pieces(text: str, found: str) -> Column:
    """The text between candidates; only texts that have any are cut."""
    return F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1))


def _each(found: str, pieces: str) -> Column:
    """Candidates with what stands around them."""

    def own(p: Column) -> Column:
        return F.transform(
            found,
            lambda c, i: F.struct(
                i.alias("ordinal"), F.length(p[i]).cast("long").alias("piece_chars"), F.right(p[i], F.lit(BEFORE)).alias("before"), c.alias("candidate"), F.left(p[i + 1], F.lit(AFTER)).alias("after")
            ),
        )

    return F.element_at(F.transform(F.array(pieces), own), 1)


def _parted(docs: DataFrame, keep: list[Column | str], text: str, path: str | None) -> DataFrame:
    """The columns ``keep``, and _path, _found and _pieces of each text. The pattern runs once over a text without candidates."""
    cut = docs.select(*keep, (F.col(path) if path else F.lit("")).cast("string").alias("_path"), F.col(text).alias("_text"), _found(text).alias("_found"))
    return cut.withColumn("_pieces", _pieces("_text", "_found")).drop("_text")


def candidates(docs: DataFrame, keep: list[Column | str], text: str = "text", path: str | None = "source") -> DataFrame:
    """A row a candidate: the columns ``keep``, ordinal, piece_chars, before, candidate, after, path."""
    cut = _parted(docs, keep, text, path)
    names = cut.columns[: len(keep)]
    return cut.select(*names, "_path", F.explode(_each("_found", "_pieces")).alias("_c")).select(*names, "_c.*", F.col("_path").alias("path"))


def kind(candidate: Column) -> Column:
    out = F.lit("generic")
    for name, pattern in reversed(KINDS):
        out = F.when(candidate.rlike(pattern), name).otherwise(out)
    return out


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numbers for the forest, all doubles."""
    value = F.regexp_replace(F.regexp_replace("candidate", "^" + ASSIGNED, ""), r"[\"']$", "")
    out = found.withColumn("_v", value)
    v, size = F.col("_v"), F.greatest(F.length("_v"), F.lit(1))
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))
    near = F.lower(F.concat(F.coalesce("before", F.lit("")), F.lit(" "), F.regexp_extract("candidate", "^" + ASSIGNED, 0)))
    named = {
        "f_length": F.length("candidate"),
        "f_value_length": F.length("_v"),
        "f_digits": F.regexp_count(v, F.lit("[0-9]")) / size,
        "f_upper": F.regexp_count(v, F.lit("[A-Z]")) / size,
        "f_lower": F.regexp_count(v, F.lit("[a-z]")) / size,
        "f_hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "f_symbols": F.regexp_count(v, F.lit("[^0-9A-Za-z]")) / size,
        "f_transitions": F.regexp_count(v, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / size,
        "f_vowel_steps": F.regexp_count(F.lower(v), F.lit("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]")) / size,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "f_runs": F.regexp_count(v, F.lit(r"(.)\1\1")) / size,
        "f_dictionary": (F.length("_v") - F.length(F.regexp_replace("_v", words, ""))) / size,
        "f_separators": F.regexp_count(v, F.lit("[/_.-]")) / size,
        "f_code": v.rlike(r"[()\[\]{}$<>]"),
        "f_in_path": F.col("before").rlike(r"[/\\.:]$") | F.col("after").rlike(r"^[/\\]|^\.[a-z]{1,5}\b"),
        "f_test_path": F.lower(F.coalesce("path", F.lit(""))).rlike("test|example|sample|fixture|doc|mock"),
        "f_assigned": F.col("candidate").rlike("^" + ASSIGNED),
        "f_quoted": F.col("candidate").rlike(r"[\"']$") | F.col("after").rlike("^[\"']"),
        "f_fixed_form": F.col("candidate").rlike(f"^(AKIA|ASIA|gh[pousr]_|xox|eyJ|(?:{ASSIGNED})?-----BEGIN)"),
        "f_near_key": near.rlike(f"{NAMES}|credential|bearer"),
        "f_near_hash": near.rlike(r"commit|sha-?[0-9]*\b|md5|checksum|digest|hash|uuid|guid|revision|etag|base64|integrity|order|isbn"),
        "f_near_fake": F.lower(F.concat_ws(" ", "before", "candidate", "after")).rlike("example|sample|dummy|fake|placeholder|changeme|your[_-]|xxxx|insert|redacted"),
    }
    out = out.withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in named.items()}).drop("_v")
    return out, list(named)


def labelled_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """Findings with labels, made from templates: random strings where keys stand, and what is taken for them."""
    hex_ = "sha2(concat('h', id), 512)"
    b64 = "translate(base64(unhex(sha2(concat('b', id), 512))), '=', '')"
    alnum = f"regexp_replace({b64}, '[+/]', 'q')"
    caps = f"regexp_replace(upper({alnum}), '[018]', 'K')"
    words = "thing other value about people north water house under story point light night world reader batch cache table order queue label frame store event width count image theme group media".split()
    pick = lambda options, k: f"element_at(array({', '.join(x[4:] if x.startswith('sql:') else repr(x) for x in options)}), 1 + cast(pmod(xxhash64(id, {k}), {len(options)}) as int))"
    w = [f"w{k}" for k in range(5)]
    size = "(16 + cast(pmod(xxhash64(id, 9), 25) as int))"
    name = pick("password token secret api_key access_key pwd client_secret apikey auth_key passwd PASSWORD API_KEY".split(), 7)
    equal = pick(["=", " = ", ": ", ' = "', ': "', '="'], 8)
    shut = "if(pmod(xxhash64(id, 8), 6) >= 3, '\"', '')"
    prose = pick([f"sql:concat({w[0]}, ' ', {w[1]}, ' and ', {w[2]}, ' ')", f"sql:concat('export ', upper({w[0]}), '_')", f"sql:concat({w[0]}, ', ', {w[1]}, '.\n')", "sql:''", f"sql:concat('const ', {w[0]}, ' = {{ ')"], 10)
    call = pick([f"sql:concat({w[0]}, '.', {w[1]}, '(')", "sql:'os.environ[\"'", "sql:'process.env.'", "sql:'${'", f"sql:concat('get_', {w[0]}, '(')", "sql:'settings.'", "sql:'{{ '", "sql:'str = Field('", f"sql:concat({w[0]}, '_', {w[1]}, '[')"], 11)
    body = lambda end: f"concat_ws({end}, '', repeat(concat(substr({b64}, 1, 64), {end}), 1 + cast(pmod(xxhash64(id, 5), 20) as int)), concat(substr({b64}, 65), '='))"
    fakes = ["changeme123", "your_password_here", "example_value_1", "xxxxxxxxxxxxxxxx", "test_secret_key", "placeholder01", "<your-token>", "YOUR_API_KEY", "****************", "insert_key_here", "dummy-token-12", "undefined", "required"]
    digest = pick(["md5 ", "checksum ", "sha256: ", "digest=", "sha1 ", "revision ", "etag: ", "commit ", "blob/", "tree/", "integrity sha512-", "hash "], 12)
    templates = [
        (1, prose, f"concat({name}, {equal}, substr({hex_}, 1, {size}), {shut})"),
        (1, prose, f"concat({name}, {equal}, substr({alnum}, 1, {size}), {shut})"),
        (1, prose, f"concat({name}, {equal}, substr({b64}, 1, {size} + 8), {shut})"),
        (1, prose, f"concat({name}, {equal}, initcap({w[0]}), substr({hex_}, 1, 3), '!', {w[1]}, {shut})"),
        (1, prose, f"concat('AKIA', substr({caps}, 1, 16))"),
        (1, f"concat('key id ', {w[0]}, ': ')", f"concat('ASIA', substr({caps}, 1, 16))"),
        (1, prose, f"concat('ghp_', substr({alnum}, 1, 36))"),
        (1, prose, f"concat('xoxb-', substr({alnum}, 1, 12), '-', substr({alnum}, 20, 24))"),
        (1, prose, f"concat('eyJ', substr({alnum}, 1, 30), '.', substr({alnum}, 31, 40))"),
        (1, f"concat({prose}, 'bearer credential ')", f"substr({alnum}, 1, {size} + 6)"),
        (1, f"concat({prose}, {pick(['Authorization: Bearer ', 'credential ', 'access key ', 'the token is ', 'secret '], 13)})", f"substr({alnum}, 1, {size} + 8)"),
        (1, prose, "'-----BEGIN RSA PRIVATE KEY-----'"),
        (1, prose, f"concat('-----BEGIN RSA PRIVATE KEY-----', {body('char(10)')}, char(10), '-----END RSA PRIVATE KEY-----')"),
        (1, prose, f"concat('-----BEGIN PRIVATE KEY-----', {body('char(10)')})"),
        (1, prose, f"concat('private_key\": \"-----BEGIN PRIVATE KEY-----', {body("concat(char(92), 'n')")}, '-----END PRIVATE KEY-----')"),
        (0, f"concat({prose}, {digest})", f"substr({hex_}, 1, {pick(['sql:32', 'sql:40', 'sql:64', 'sql:128'], 14)})"),
        (0, f"concat({prose}, {digest})", f"substr({b64}, 1, {pick(['sql:43', 'sql:64', 'sql:86'], 14)})"),
        (0, f"concat({prose}, {pick(['id ', 'uuid: ', 'request ', 'trace_id=', 'session/', ''], 15)})", f"concat(substr({hex_}, 1, 8), '-', substr({hex_}, 9, 4), '-4', substr({hex_}, 13, 3), '-', substr({hex_}, 16, 4), '-', substr({hex_}, 20, 12))"),
        (0, prose, f"concat({name}, {equal}, {pick(fakes, 16)}, {shut})"),
        (0, prose, f"concat({name}, {equal}, {call}, {w[2]}, {pick([')', ']', '}', '', '\")', ' }}', '...)'], 17)})"),
        (0, prose, f"concat({name}, {equal}, {call}, upper({w[2]}), '_', upper({w[3]}), {pick([')', ']', '}', '', '\"]', ');'], 17)})"),
        (0, prose, f"concat({name}, {equal}, {w[0]}, '_', {w[1]}, '_', {w[2]}, {shut})"),
        (0, prose, f"concat({name}, {equal}, {w[0]}, initcap({w[1]}), initcap({w[2]}), {pick([';', ',', '', ')'], 18)})"),
        (0, prose, f"concat({name}, {equal}, '/', {w[0]}, '/', {w[1]}, '/', {w[2]}, {pick(['.txt', '.json', '', '.key'], 18)}, {shut})"),
        (0, f"concat('see https://host.example/', {w[3]}, '/')", f"concat({w[0]}, '-', {w[1]}, '-', {w[2]}, '-20', lpad(id % 30, 2, '0'), '-', {w[3]})"),
        (0, f"concat({prose}, {pick(['assets/', 'static/js/', 'img/', 'docs/', 'build-'], 19)})", f"concat({w[0]}, '-', {w[1]}, '_', {w[2]}, '-v', id % 9, '-', substr({hex_}, 1, 8))"),
        (0, prose, "concat('AKIA', element_at(array('IOSFODNN7EXAMPLE', 'XXXXXXXXXXXXXXXX', 'EXAMPLEKEYID0000'), 1 + cast(id % 3 as int)))"),
        (0, f"concat({prose}, {pick(['order ', 'invoice ', 'account no. ', 'isbn ', 'phone ', 'part '], 20)})", f"substr(conv(substr({hex_}, 1, 15), 16, 10) || conv(substr({hex_}, 16, 15), 16, 10), 1, 22)"),
        (0, prose, f"concat({w[0]}, initcap({w[1]}), 'By', initcap({w[2]}), id % 9, initcap({w[3]}), {pick(['Factory', 'Test', 'Handler', 'View'], 21)})"),
        (0, prose, f"concat({pick(['test_', 'use_', 'max_', 'is_'], 21)}, {w[0]}, '_', {w[1]}, '_', {w[2]}, '_', id % 100)"),
        (0, "'<img src=data:image/png;base64,'", f"concat({b64}, {b64})"),
        (0, f"concat({prose}, {pick(['/usr/local/', 'C:/', './', 'lib/', 'com/'], 22)})", f"concat({w[0]}, '/', {w[1]}, '/', {w[2]}, '/', {w[3]}, id % 7)"),
    ]
    case = lambda part: "CASE " + " ".join(f"WHEN id % {len(templates)} = {i} THEN {t[part]}" for i, t in enumerate(templates)) + " END"
    path = "element_at(array('src/main/app.conf', 'tests/fixture.txt', 'web', 'notes', 'docs/example.md', ''), 1 + cast(pmod(xxhash64(id, 6), 6) as int))"
    after = pick([f"sql:concat(' ', {w[3]}, ' ', {w[2]})", "sql:'\n'", "sql:''", f"sql:concat('; // ', {w[4]})", f"sql:concat(', ', {w[3]})"], 23)
    rows = spark.range(n).selectExpr("id", *[f"{pick(words, k)} AS w{k}" for k in range(5)])
    return rows.selectExpr(f"{case(1)} AS before", f"{case(2)} AS candidate", f"{after} AS after", f"{path} AS path", f"cast({case(0)} as double) AS label")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    rows, names = features(materialize(labelled, "findings"))  # else each feature holds the templates' expression again
    ready = VectorAssembler(inputCols=names, outputCol="_features").transform(rows).select("_features", "label")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)


def scored(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add kind, score and is_secret; drop the features."""
    rows, names = features(found)
    out = model.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(rows))
    out = out.withColumns({"kind": kind(F.col("candidate")), "score": F.round(vector_to_array("probability")[1], 6)})
    return out.select(*found.columns, "kind", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Rows (key, ordinal, start, length, kind, score, is_secret); start and length in code points."""
    found = scored(candidates(docs, [F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key")], text, path), model)
    before = W.partitionBy("_row").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("piece_chars") + F.length("candidate")).over(before) - F.length("candidate")
    return found.select(F.col("_key").alias(key), F.col("ordinal").cast("long").alias("ordinal"), start.alias("start"), F.length("candidate").cast("long").alias("length"), "kind", "score", "is_secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str | None = "source", mask: str = MASK) -> DataFrame:
    """The same rows and columns, every secret in ``text`` replaced by ``mask``. Texts are scanned once and written with their candidates; those
    without any stay where they are."""
    row = F.monotonically_increasing_id().alias("_row")
    held = materialize(_parted(docs, [row, F.struct(*docs.columns).alias("_doc")], text, path), "scanned")
    some = held.where(F.size("_found") > 0)
    found = scored(some.select("_row", "_path", F.explode(_each("_found", "_pieces")).alias("_c")).select("_row", "_c.*", F.col("_path").alias("path")), model)
    now = F.struct("ordinal", F.when(F.col("is_secret"), mask).otherwise(F.col("candidate")).alias("now"))
    whole = found.groupBy("_row").agg(F.array_sort(F.collect_list(now)).alias("_now"))
    filled = F.concat(F.transform("_now", lambda x: x["now"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with("_pieces", filled, lambda a, b: F.concat(a, b)), "")
    changed = some.join(whole, "_row").select(*[(joined if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])
    return held.where(F.size("_found") == 0).select("_doc.*").unionByName(changed)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), train(labelled_findings(spark)))
