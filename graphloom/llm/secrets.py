"""Secret scan: candidates by pattern, false positives removed by a random forest, with DataFrame functions only.

Generators propose private key blocks, tokens of known forms, long mixed strings, whatever is assigned to a secret-like name,
and passwords in URLs; the forest does the rejecting. It judges length, character transitions, dictionary coverage, the
path and the neighbouring words. It learns from labelled findings, a bounded table that this module writes itself, as no
table holds any. The dictionary is the words that most documents hold, counted over all of them, beside the usual words
of code; the transitions are those between the letters of its words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, fresh, small_side, written
from .spans import Generator, matched, placed

MARK = "<SECRET>"
THRESHOLD = 0.5
FINDINGS = 6000
DICTIONARY_WORDS = 2000  # the most frequent words of the documents
# Forms of well-known credentials, words before a secret, words that speak against one, words of everyday code.
_KNOWN_FORM = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----END)[\s\S])*+(?:-----END [A-Z ]*PRIVATE KEY-----)?"
SECRET_WORDS = "token|secret|passphrase|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential|client[_-]?secret"
HARMLESS_WORDS = "commit|revision|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|etag|build|version|integrity|fingerprint|session id|order|tracking"
CODE_WORDS = (
    "example sample test your my the and token secret password passwd pass changeme change dummy placeholder insert here put enter xxx abc key api value none null nil true false undefined "
    "user name admin default string env environ getenv config settings process self this get load read fetch prompt input required optional var secrets vault access private client fake mock redacted hidden "
    "me us replace replaced with please todo fixme fill in out provide provided add use some foo bar baz hello world demo temp null hunter letmein qwerty"
).split()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "A-Za-z0-9_+/-"
#: A whole name that holds a word for a secret; atomic from its start, so that a name is read once however long it is.
_NAME = rf"(?<![\w-])(?>[\w-]*?(?:{SECRET_WORDS}|key|credentials)[\w-]*+)"
_LEAD = rf"(?i){_NAME}[\"']?\s*+(?::=|=>|[:=])\s*+(?:(?:bearer|basic|token)\s++)?[\"']?|(?i)bearer\s++"
GENERATORS = [
    Generator("block", _BLOCK, needs="PRIVATE KEY-----"),
    Generator("token", rf"(?<![{_TOKEN}])(?:(?:{_KNOWN_FORM})(?![{_TOKEN}])|(?=[A-Za-z_+/-]*[0-9])[{_TOKEN}]{{16,}}+={{0,2}}+)", like=rf"[{_TOKEN}]{{14}}"),
    Generator("assigned", r"(?-i)[^\s\"'<>,;]{6,}+", like=rf"(?i){_NAME}[\"']?\s*+[:=]|bearer\s", lead=f"(?:{_LEAD})"),
    Generator("url", r"[^\s/@:\"'<>]{3,}+(?=@)", needs="://", lead=r"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:"),
]
FEATURES = ["block", "url", "known_form", "length", "digits", "upper", "signs", "transitions", "likely_letters", "distinct", "runs", "hex", "coverage", "code_coverage", "speaks", "harmless", "assignment", "quoted", "test_path", "path_like", "reference"]


@dataclass(frozen=True)
class Language:
    """What is usual in the documents: their most frequent words, and the log-probabilities of letters after letters in them."""

    words: tuple[str, ...]
    transitions: dict[str, float]


def language(docs: DataFrame, n: int = DICTIONARY_WORDS, text: str = "text") -> Language:
    """The n words (4 to 20 letters, lower case) that most rows of docs hold, and their letter transitions; from all rows."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]{4,20}"), F.lit(0)))
    top = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()
    counts = Counter()
    for row in top:
        for pair in zip(row["word"], row["word"][1:], strict=False):
            counts["".join(pair)] += row["n"]
    first = Counter()
    for pair, k in counts.items():
        first[pair[0]] += k
    return Language(tuple(r["word"] for r in top), {p: math.log(k / first[p[0]]) for p, k in counts.items()})


def _features(df: DataFrame, path: str, usual: Language) -> DataFrame:
    """df (kind, value, before, after, path) with the columns FEATURES."""
    v, before = F.col("value"), F.lower("before")
    n = F.greatest(F.length(v), F.lit(1))
    changes = F.regexp_count(v, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    words = F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    letters = F.greatest(F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.lit(1))
    known = lambda vocabulary: F.aggregate(F.filter(F.transform(words, F.lower), lambda w: w.isin(list(vocabulary))), F.lit(0), lambda a, w: a + F.length(w)) / letters
    pairs = F.regexp_extract_all(F.lower(v), F.lit("(?=([a-z]{2}))."), F.lit(1))
    likely = F.lit([usual.transitions.get(a + b, -8.0) for a in _LETTERS for b in _LETTERS])
    place = lambda p: (F.ascii(p) - ord("a")) * len(_LETTERS) + F.ascii(F.substr(p, F.lit(2))) - ord("a")
    mean_likely = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(likely, place(p))) / F.size(pairs)).otherwise(-4.0)
    columns = {
        "block": F.col("kind") == "block", "url": F.col("kind") == "url", "known_form": v.rlike(f"^(?:{_KNOWN_FORM})$"), "length": F.least(n, F.lit(200)), "digits": F.length(F.regexp_replace(v, "[^0-9]", "")) / n,
        "upper": F.length(F.regexp_replace(v, "[^A-Z]", "")) / n, "signs": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")) / n, "transitions": changes / n, "likely_letters": mean_likely,
        "distinct": F.size(F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)))) / n, "runs": F.regexp_count(v, F.lit(r"(.)\1")) / n, "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": known(usual.words), "code_coverage": known(CODE_WORDS),
        "speaks": (F.col("kind") == "assigned") | before.rlike(rf"(?:{SECRET_WORDS}|key)[\w \"'-]*[:=> \"']*$"), "harmless": before.rlike(rf"\b(?:{HARMLESS_WORDS})\b"), "assignment": before.rlike(r"[:=]\s*[\"']?$"), "quoted": before.rlike(r"[\"']$"),
        "test_path": F.coalesce(F.lower(path).rlike(r"(?:^|[/_.-])(?:tests?|examples?|docs?|fixtures?|samples?|mocks?)(?:[/_.-]|$)"), F.lit(False)), "path_like": F.length(F.regexp_replace(v, "[^/_=-]", "")) * 6 > n,
        "reference": v.rlike(r"^(?:\$|%|\{|\*{3}|\.{3}|[A-Za-z_.]+[(\[])"),
    }
    return df.withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in columns.items()})


def findings(spark: SparkSession, usual: Language, n: int = FINDINGS) -> DataFrame:
    """(label, kind, value, before, after, path): labelled findings made from numbered rows; label 1 is a secret.

    Credentials of a known form and private keys are secrets wherever they stand; random strings, passwords and phrases are
    where a name speaks for them; hashes, identifiers, paths, placeholders and references aren't.
    """
    i = F.col("id")
    part = lambda seed, size: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(size)).cast("int")
    pick = lambda seed, *values: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in values)), part(seed, len(values)) + 1)
    raw = F.sha1(F.concat(i.cast("string"), F.lit("a")))
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(i.cast("string"), 256))), "=+$", "")
    safe = F.translate(base, "+/", "-_")
    plain = F.translate(base, "+/", "xY")
    letters = F.translate(F.lower(base), "0123456789+/", "qwzxkvjpbgmc")
    vocabulary = [w for w in usual.words if w not in CODE_WORDS][:400] or ["lorem", "ipsum", "dolor"]
    usual_word = lambda seed: F.element_at(F.lit(list(vocabulary)), part(seed, len(vocabulary)) + 1)
    code_word = pick("w1", "example", "sample", "your", "test", "dummy", "changeme", "insert", "placeholder", "my", "fake")
    digits = lambda seed, size: F.lpad(part(seed, 10**size).cast("string"), size, "0")
    mixed = pick("mx", plain, letters, F.lower(plain), F.concat(usual_word("m1"), usual_word("m2"), usual_word("m3"), usual_word("m4"), plain), F.concat(F.lit("abcdefghijklmnop"), plain), F.translate(plain, "0123456789", "abcdefghij"))
    known = pick("f", F.concat(F.lit("AKIA"), F.upper(F.left(raw, F.lit(16)))), F.concat(F.lit("AKIA"), F.upper(F.left(mixed, F.lit(16)))), F.concat(pick("gh", "ghp_", "gho_", "ghs_"), F.left(mixed, F.lit(36))), F.concat(pick("xo", "xoxb-", "xoxp-"), digits("x1", 9), F.lit("-"), digits("x2", 9), F.lit("-"), F.left(plain, F.lit(24))), F.concat(pick("xo2", "xoxb-", "xoxa-"), F.left(mixed, F.lit(20))), F.concat(pick("sk", "sk-", "sk-live-", "sk-proj-"), F.left(mixed, F.lit(32))), F.concat(F.lit("eyJ"), F.left(safe, F.lit(20)), F.lit(".eyJ"), F.left(safe, F.lit(30)), F.lit("."), F.right(safe, F.lit(28))))
    block = F.concat(F.lit("-----BEGIN "), pick("bt", "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), base, F.lit("\n"), base, F.when(part("cut", 3) == 0, F.lit("")).otherwise(F.lit("\n-----END PRIVATE KEY-----")))
    random = pick("r", raw, F.upper(raw), base, F.left(base, F.lit(24)), F.left(plain, F.lit(10)), F.left(letters, F.lit(24)), F.left(plain, F.lit(16)), raw)
    phrase = pick("ph", F.concat(usual_word("p1"), usual_word("p2"), usual_word("p3")), F.concat(F.initcap(usual_word("p1")), F.lit("!"), digits("pd", 4), usual_word("p2")), F.concat(F.left(letters, F.lit(8)), usual_word("p1"), F.left(letters, F.lit(4))), F.concat(usual_word("p1"), digits("pd", 3), F.lit("#"), F.left(plain, F.lit(3))), F.concat(usual_word("p1"), usual_word("p2"), usual_word("p3"), usual_word("p4")))
    uuid = F.concat_ws("-", F.left(raw, F.lit(8)), F.substring(raw, 9, 4), F.substring(raw, 13, 4), F.substring(raw, 17, 4), F.right(raw, F.lit(12)))
    placeholder = pick("pl", F.concat(code_word, pick("j", "_", "-", "_"), pick("w2", "token", "key", "password", "secret"), F.lit("_here")), F.concat(code_word, F.lit("_"), pick("w2", "token", "key", "password"), F.lit("_"), digits("k", 3)), F.lit("x" * 16), F.concat(F.lit("${"), F.upper(pick("w2", "token", "key", "password")), F.lit("}")), F.concat(pick("fn", "get_", "load_", "os.environ.get("), pick("w2", "token", "key"), F.lit("()")), pick("lit", "changeme", "password", "undefined", "required", "********", "<redacted>"), F.concat(F.lit("your-"), pick("w2", "token", "api-key", "password"), F.lit("-example")), F.concat(code_word, digits("k", 3)), F.concat(pick("w4", "changeme", "password", "test", "demo", "foobar", "example"), digits("k", 4)), F.upper(F.concat(code_word, F.lit("_"), pick("w5", "with", "replace", "fill_in", "me", "some"), F.lit("_"), pick("w2", "token", "key", "password", "value"))), F.concat(pick("w5", "replace", "put", "use", "todo"), F.lit("-"), pick("w6", "me", "with", "some", "the"), F.lit("-"), pick("w2", "token", "key", "password", "value")), F.concat(usual_word("p1"), F.lit("."), usual_word("p2")))
    harmless = pick("h", raw, raw, F.sha2(i.cast("string"), 256), uuid, F.concat(F.lit("/usr/lib/"), usual_word("p1"), F.lit("/v"), digits("k", 2), F.lit("/data")), F.concat(F.lit("2024-0"), part("m", 9).cast("string"), F.lit("-11-snapshot-build")), digits("dd", 8), F.concat_ws("-", usual_word("p1"), usual_word("p2"), usual_word("p3"), digits("k", 2)), base)
    name = F.concat(pick("pre", "", "", "db_", "my_", "aws_", "SLACK_"), pick("nm", "token", "api_key", "password", "secret", "TOKEN", "Password", "client_secret", "access_key", "pwd", "passwd", "auth_token", "private_key"))
    speaks = pick("sp", F.concat(name, F.lit(' = "')), F.concat(name, F.lit(": ")), F.concat(name, F.lit("=")), F.concat(name, F.lit('": "')), F.concat(name, F.lit("      = '")), F.lit("Authorization: Bearer "), F.lit("bearer "), F.concat(F.lit("set "), name, F.lit(' = "')))
    prose = F.concat(usual_word("q1"), F.lit(" "), usual_word("q2"), pick("q3", " ", " ", ": ", " (", ", ", "\n"))
    against = F.concat(pick("ag", "commit ", "sha1: ", "checksum = ", "md5 ", "uuid: ", "build ", "etag=\"", "revision ", "digest: ", "sha256 "))
    neutral = pick("ne", prose, prose, F.lit(""), F.concat(prose, F.lit("to ")), F.concat(usual_word("q1"), F.lit(" in config ")))
    parts = spark.range(n).withColumns({"known": known, "block_text": block, "random": random, "phrase": phrase, "placeholder": placeholder, "harmless": harmless, "speaks": speaks, "against": against, "neutral": neutral, "plain": plain, "plan": part("plan", 20)})
    known, block, random, phrase, placeholder, harmless, speaks, against, neutral, plain, plan = map(F.col, ("known", "block_text", "random", "phrase", "placeholder", "harmless", "speaks", "against", "neutral", "plain", "plan"))
    rows = [  # plan: label, kind, value, before
        (plan < 3, 1, F.lit("token"), known, F.when(part("kn", 2) == 0, speaks).otherwise(neutral)), (plan == 3, 1, F.lit("block"), block, F.when(part("kn", 2) == 0, speaks).otherwise(neutral)),
        (plan < 8, 1, pick("kd", "assigned", "token"), random, speaks), (plan == 8, 1, F.lit("assigned"), phrase, speaks), (plan == 9, 1, F.lit("url"), F.when(part("up", 2) == 0, phrase).otherwise(F.left(plain, F.lit(12))), F.concat(pick("sch", "postgres", "https", "mongodb"), F.lit("://"), usual_word("q1"), F.lit(":"))),
        (plan < 13, 0, F.lit("token"), harmless, against), (plan < 16, 0, F.lit("token"), harmless, neutral), (plan < 19, 0, F.lit("assigned"), placeholder, speaks), (plan == 19, 0, F.lit("url"), pick("ur", "password", "changeme", "pass", "secret", "${PASSWORD}", "your_password"), F.concat(F.lit("https://user:"))),
    ]

    def chosen(k: int) -> Column:
        out = F.lit(None)
        for row in reversed(rows):
            out = F.when(row[0], row[k] if isinstance(row[k], Column) else F.lit(float(row[k]))).otherwise(out)
        return out

    path = F.when(part("t", 6) == 0, pick("tp", "src/tests/a.py", "docs/readme.md")).otherwise(pick("pp", "src0", "app/config.py", "deploy/env.sh", ""))
    return parts.select(chosen(1).alias("label"), chosen(2).alias("kind"), chosen(3).alias("value"), F.right(chosen(4), F.lit(32)).alias("before"), pick("a", '"', " ", "\n", "'", "").alias("after"), path.alias("path"))


def trained(spark: SparkSession, usual: Language):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(findings(spark, usual), "path", usual))
    return RandomForestClassifier(numTrees=24, maxDepth=8, seed=1, labelCol="label").fit(rows)


def _keys(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a 128-bit key of doc_id and text: rows that agree in both have the same findings."""
    both = lambda seed: F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), text)
    return docs.withColumn(name, F.struct(both(1).alias("a"), both(2).alias("b")))


def secret_spans(docs: DataFrame, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(key, doc_id, start, end, kind, score): the secrets of docs (doc_id, text and, if it has it, the path column).

    Code points, end exclusive. Overlapping findings of several generators become one, with their outer ends and best
    score. Null and empty texts have none. Rows that repeat doc_id and text are scanned once. Other columns are ignored.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    usual = language(docs)
    rows = _keys(docs.select("doc_id", where.alias("path"), "text"), "key")
    rows = written(matched(rows, GENERATORS).where(F.size("found") > 0).dropDuplicates(["key"]))
    each = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(placed(rows, "key"), "path", usual))
    score = vector_to_array("probability")[1]
    kept = trained(docs.sparkSession, usual).transform(each).select("key", "doc_id", "kind", F.col("start").cast("long"), F.col("end").cast("long"), F.round(score, 6).alias("score")).where((F.col("score") >= threshold) & (F.col("end") > F.col("start")))
    in_order = W.partitionBy("key").orderBy("start", "end", "kind")
    apart = (F.col("start") >= F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))).cast("int")
    grouped = kept.withColumn("apart", F.coalesce(apart, F.lit(1))).withColumn("place", F.sum("apart").over(in_order))
    return grouped.groupBy("key", "place").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"), F.max("score").alias("score")).drop("place")


def scan(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row per secret: doc_id, start, end, kind, score."""
    return secret_spans(docs, path).select("doc_id", "start", "end", "kind", "score")


def redacted(docs: DataFrame, path: str = "source", mark: str = MARK) -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars, if there is one, set to the new length. All rows stay.

    A null text stays null. Other columns are returned as they are, whatever their names.
    """
    key, spans = fresh(docs, "secret_key"), fresh(docs, "secret_spans")
    found = secret_spans(docs, path).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    found = written(found)
    rows = _keys(docs, key).join(small_side(found, found.count(), BROADCAST_ROWS // 4), key, "left")
    pieces = F.expr(f"transform({spans}, (s, i) -> concat(substring(text, cast(if(i = 0, 0, {spans}[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, {spans}[i - 1].end) as int)), '{mark}'))")
    rest = F.expr(f"substring(text, cast(element_at({spans}, -1).end as int) + 1)")
    out = rows.withColumn("text", F.when(F.col(spans).isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
