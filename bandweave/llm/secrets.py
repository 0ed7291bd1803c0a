"""Secret scan with a random forest for false-positive removal, in DataFrame operations only.

A text's candidates are found by one pattern: known key formats, values assigned to names like password or token, and
opaque runs of 16 and more characters with a digit, each also directly after '=' or ':'. Each is described by columns: length, shares and transitions of
character classes, coverage by dictionary words, the words before and after it, and the path. A random forest
(Spark's DataFrame implementation) trained on labelled findings scores it; findings under the threshold are false
positives and marked so.

labelled_findings() makes a labelled table of `n` findings (a parameter) from seeded digests, by SQL: keys and passwords in
the forms in which they leak against what scanners confuse with them (revisions, checksums, UUIDs, card and order
numbers, placeholders, identifiers, data URIs, download paths, values in test fixtures). Give train() findings of your own to
replace it.

Cases: a null or empty text has no candidates. Equal values in a text are separate findings, by place. Rows that
repeat give their findings once each. A null path is an empty one. An empty table gives an empty result. Other columns are
ignored. Texts are scanned whole; the words around a candidate are 48 characters before and 24 after it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginnings of key formats (fixed values).
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29\\.|eyJ|SG\\.|npm_|pypi-"
NAMES = "passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
#: Names that a value of any characters is taken after, in either case and quoted or not, with '=', ':', '==', '::' or ':=' and up
#: to 32 blanks on each side of it (Java's look-behind needs a bound). Cheap look-behinds first.
ASSIGNED = (
    "(?<=[=:]|[=: \\t][ \\t])(?<=[=:][ \\t]{0,32})"
    "(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \\t]{0,32}[=:]{1,2}[ \\t]{0,32})"
)
RUN = "(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]{16})"
CANDIDATE = (
    f"{RUN}(?:{PREFIXES})[A-Za-z0-9_.-]{{11,}}[A-Za-z0-9_-]"
    f"|{ASSIGNED}[\"']?[^\\s\"'<>]{{5,}}[^\\s\"'<>.,;:?)]"
    f"|{RUN}(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}={{0,2}}"
)
#: Words that make up placeholders and identifiers rather than keys.
DICTIONARY = "your|here|example|sample|test|dummy|fake|change|me|placeholder|password|passwd|secret|token|key|api|user|name|admin|default|none|null|todo|xxx+|abc|123456?7?8?9?0?|qwerty|value|string|insert|config|controller|service|manager|account|handler|factory|package|release|download|version|linux|windows|image|data|file|path|index|table|column|client|server|request|response|http|https|www|com|org|the|and|with|for|from|this|that"
SHARES = {"digits": "[0-9]", "lower": "[a-z]", "upper": "[A-Z]", "marks": "[^A-Za-z0-9]"}
MOVES = {"letter_digit": "[A-Za-z](?=[0-9])", "digit_letter": "[0-9](?=[A-Za-z])", "lower_upper": "[a-z](?=[A-Z])", "upper_lower": "[A-Z](?=[a-z])", "vowel_consonant": "(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])", "consonant_vowel": "(?i)[bcdfghjklmnpqrstvwxyz](?=[aeiou])", "same": "(.)(?=\\1)"}
FLAGS = {
    "prefix": ("value", f"^(?:{PREFIXES})"), "hexadecimal": ("value", "^[0-9a-f]+$"), "uuid": ("value", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    "name_before": ("before", f"(?i)(?:{NAMES})[^\\n]{{0,12}}$"), "assigned": ("before", "[=:]\\s*[\"']?$"),
    "digest_before": ("before", "(?i)(?:commit|revision|rev|sha-?\\d*|md5|checksum|digest|hash|uuid|guid|etag|integrity)\\W{0,4}$"), "data_before": ("before", "(?i)(?:base64,|data:|href=.?|src=.?|https?:\\S*|/)$"),
    "number_before": ("before", "(?i)(?:order|invoice|card|isbn|phone|account|number|no\\.?|id)\\W{0,4}$"), "quoted": ("after", "^[\"']"),
    "test_path": ("path", "(?i)(?:^|[/_.-])(?:tests?|fixtures?|examples?|samples?|mocks?|docs?)(?:$|[/_.-])"), "config_path": ("path", "(?i)(?:\\.env|\\.ya?ml|\\.ini|\\.conf|\\.properties|config|settings)"), "lock_path": ("path", "(?i)(?:\\.lock|lock\\.json|\\.sum|\\.svg|\\.map)$"),
}
FEATURES = ("length", "variety", "dictionary", *SHARES, *MOVES, *FLAGS)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, value, before, after, path) of all candidates of docs (doc_id, text, path); start counts code points
    from 0. The text is cut at its candidates, so their places are sums of lengths; sums go by runs of 256, and the words around are
    taken from the nearest cuts, so the work grows with the text and no text is copied for its candidates."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("_found")).where(F.size("_found") > 0)
    cut = found.select("doc_id", "path", "_found", F.split("text", CANDIDATE, -1).alias("_rest"), F.sequence(F.lit(0), F.size("_found") - 1).alias("_i"))
    # What lies between the beginnings of a candidate and the one before it, and as text, the last 48 and first 24 characters.
    steps = "transform(_i, i -> cast(length(_rest[i]) + if(i > 0, length(_found[greatest(i - 1, 0)]), 0) as bigint))"
    left = "transform(_i, i -> concat(if(i > 0, right(_found[greatest(i - 1, 0)], 48), ''), right(_rest[i], 48)))"
    right = "transform(_i, i -> concat(left(_rest[i + 1], 24), if(i + 1 < size(_found), left(_found[least(i + 1, size(_found) - 1)], 24), '')))"
    cut = cut.selectExpr("doc_id", "path", "_found", "_i", f"{steps} as _steps", f"{left} as _left", f"{right} as _right")
    cut = cut.withColumn("_runs", F.expr("transform(sequence(0, (size(_i) - 1) div 256), r -> aggregate(slice(_steps, cast(r * 256 + 1 as int), 256), 0L, (x, y) -> x + y))"))
    cut = cut.withColumn("_begin", F.expr("transform(sequence(0, size(_runs) - 1), r -> aggregate(slice(_runs, 1, r), 0L, (x, y) -> x + y))"))
    # A candidate has 6 characters or more, so 8 cuts before it and 4 after it reach far enough.
    each = F.expr("""transform(_i, i -> struct(
        _begin[i div 256] + aggregate(slice(_steps, cast(i div 256 * 256 + 1 as int), i % 256 + 1), 0L, (x, y) -> x + y) as at, _found[i] as raw,
        right(array_join(slice(_left, greatest(i - 8, 0) + 1, least(i, 8) + 1), ''), 48) as before, left(array_join(slice(_right, i + 1, 5), ''), 24) as after))""")
    one = cut.select("doc_id", "path", F.explode(each).alias("c")).select("doc_id", "path", "c.*").withColumn("quote", F.regexp_extract("raw", "^[\"']?", 0))
    return one.select("doc_id", (F.col("at") + F.length("quote")).alias("start"), F.expr("substring(raw, 1 + length(quote))").alias("value"), F.expr("right(concat(before, quote), 48)").alias("before"), "after", "path")


def described(findings: DataFrame) -> DataFrame:
    """findings (value, before, after, path) with FEATURES."""
    size = F.greatest(F.length("value"), F.lit(1)).cast("double")
    columns = {"length": size, "variety": F.size(F.array_distinct(F.split("value", ""))) / size, "dictionary": 1 - F.length(F.regexp_replace(F.lower("value"), DICTIONARY, "")) / size}
    columns |= {n: F.regexp_count("value", F.lit(p)) / size for n, p in (SHARES | MOVES).items()}
    columns |= {n: F.col(c).rlike(p).cast("double") for n, (c, p) in FLAGS.items()}
    return findings.withColumns(columns)


#: (label, value, text before, text after, path): SQL over h (64 hexadecimal digits), g (64 more), b (43 mixed-case characters), w
#: (a word) and i (a number).
TEMPLATES = (
    (1, "substr(h, 1, 40)", "concat(w, ' token = \"')", "concat('\" ', w)", "concat('src', i % 40)"),
    (1, "concat('AKIA', translate(substr(h, 1, 16), '0123456789abcdef', 'QW3ERTY7UPASDFGH'))", "concat(w, ' ', w, ' ')", "concat(' ', w)", "concat('src', i % 40)"),
    (1, "substr(h, 1, 18)", "concat(w, ' password=')", "concat(' ', w)", "concat('src', i % 40)"),
    (1, "substr(b, 1, 32)", "'api_key: \"'", "'\"'", "'app/config.yml'"),
    (1, "concat('ghp_', translate(substr(b, 1, 36), '+/', 'aB'))", "concat(w, ' ')", "' '", "'deploy.sh'"),
    (1, "concat('sk_live_', translate(substr(b, 1, 24), '+/', 'aB'))", "concat('STRIPE=', '')", "''", "'.env'"),
    (1, "substr(b, 1, 40)", "'secret_access_key = '", "''", "'settings.ini'"),
    (1, "translate(b, '+/', '-_')", "'Authorization: Bearer '", "'\"'", "'client.py'"),
    (1, "concat(substr(b, 1, 8), i % 100, '!', substr(g, 1, 4))", "concat(w, ' password:')", "' '", "'notes.txt'"),
    (1, "substr(h, 1, 32)", "concat(w, ' secret: ')", "concat(' ', w)", "concat('src', i % 40)"),
    (0, "substr(h, 1, 40)", "concat(w, ' commit ')", "concat(' ', w)", "concat('src', i % 40)"),
    (0, "substr(h, 1, 32)", "concat(w, ' md5: ')", "''", "'CHECKSUMS.txt'"),
    (0, "h", "'sha256:'", "'\"'", "'package-lock.json'"),
    (0, "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "concat(w, ' id: ')", "concat(' ', w)", "concat('src', i % 40)"),
    (0, "translate(substr(h, 1, 16), 'abcdef', '402513')", "concat(w, ' ', w, ' ')", "concat(' ', w)", "concat('src', i % 40)"),
    (0, "translate(substr(h, 1, 18), 'abcdef', '402513')", "concat(w, ' order ')", "concat(' ', w)", "'orders.csv'"),
    (0, "concat('changeme', i % 1000)", "concat(w, ' password=')", "' '", "'README.md'"),
    (0, "concat('your-token-here-', lpad(i % 1000, 4, '0'))", "'token = \"'", "'\"'", "'docs/setup.md'"),
    (0, "concat('xxxxxxxxxxxx', i % 10000)", "'secret='", "''", "'example.env'"),
    (0, "concat('testUserAccount', i % 100, 'Controller')", "concat(w, ' ')", "'('", "'src/users.java'"),
    (0, "concat('default_config_value_', i % 100, '_key')", "concat(w, ' ')", "' ='", "'settings.py'"),
    (0, "concat(b, substr(b, 5, 30))", "'data:image/png;base64,'", "'\"'", "'logo.svg'"),
    (0, "concat('releases/download/v', i % 10, '/package-name-', i % 50)", "'https://host/'", "''", "'install.sh'"),
    (0, "concat('20240131T2359591', lpad(i % 100000, 5, '0'))", "concat(w, ' ')", "' '", "'app.log'"),
    (0, "substr(h, 1, 40)", "'token = \"'", "'\"'", "'tests/fixtures/auth_test.py'"),
    (0, "substr(b, 1, 40)", "'secret = '", "''", "'examples/sample.yml'"),
    (0, "substr(h, 1, 20)", "concat(w, ' ', w, ' build ')", "concat(' ', w)", "concat('src', i % 40)"),
    (0, "concat(w, w, w, w, i % 100)", "concat(w, ' ')", "concat(' ', w)", "concat('src', i % 40)"),
)


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 29) -> DataFrame:
    """(value, before, after, path, label): n findings, made in equal parts by TEMPLATES."""
    words = "split('the of and with value then over data when list more open under table point', ' ')"
    base = spark.range(n).selectExpr("id as i", f"sha2(concat('{seed}h', id), 256) as h", f"sha2(concat('{seed}g', id), 256) as g", f"substr(base64(unhex(sha2(concat('{seed}b', id), 256))), 1, 43) as b", f"element_at({words}, cast(pmod(xxhash64({seed}, id), 15) as int) + 1) as w")
    which = f"pmod(i, {len(TEMPLATES)})"
    case = lambda k: f"case {which} " + " ".join(f"when {j} then {t[k]}" for j, t in enumerate(TEMPLATES)) + " end"
    return base.selectExpr(f"{case(1)} as value", f"{case(2)} as before", f"{case(3)} as after", f"{case(4)} as path", f"cast({case(0)} as double) as label")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="error")


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 1) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, path, label), sorted into one partition so that it is the same
    each time; the labelled table is small by its parameter."""
    rows = described(findings.coalesce(1).sortWithinPartitions("value", "before", "after", "path", "label"))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw_prediction", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64)
    return forest.fit(assembler().transform(rows).select("_features", "label"))


def scored(findings: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """findings with `score`, the forest's share for a secret."""
    out = model.transform(assembler().transform(described(findings)))
    return out.withColumn("score", vector_to_array("_probability")[1]).drop("_features", "_prediction", "_probability", "_raw_prediction", *FEATURES)


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, rule, value_sha256, score, is_secret) of all candidates; values leave only as digests."""
    rule = F.when(F.col("value").rlike(f"^(?:{PREFIXES})"), "format").when(F.col("before").rlike(f"(?i)(?:{NAMES})[^\\n]{{0,12}}$"), "named").otherwise("opaque")
    return scored(candidates(docs, path), model).select("doc_id", "start", F.length("value").cast("long").alias("length"), rule.alias("rule"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def scan_documents(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """scan() with a forest trained here, on labelled findings given or made."""
    return scan(docs, train(labelled_findings(docs.sparkSession) if findings is None else findings))
