"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans, which may overlap: the base forms of e-mail addresses, IP addresses, card and phone numbers,
and looser forms of each. A valid base span always stays. A looser one stays if boosted trees over its format and its
context give it a score above its kind's threshold, which is calibrated on examples that the trees haven't seen. The
trees learn from a bounded table of labelled examples that this module writes itself, as no table holds any.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written
from .spans import Generator, matched, placed

KINDS = ("email", "ip", "card", "phone")
# Groups that repeat without a bound are possessive: Java's matcher then loops, where it would else recurse once for each
# repeat and overflow its stack. The language is the same, as a label always ends before a dot, blank or bracket.
_ONCE = r"(?:(?<![A-Za-z0-9._%+-])|\G)"  # a run of these characters is tried once, not from each of its characters
BASE = [
    Generator("email", _ONCE + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", like=r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", like=r"[0-9](?:[\x20-]?[0-9]){12}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", needs="+"),
]
LOOSE = [
    Generator("email?", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}])\x20?[A-Za-z0-9-]++)++", like=r"[\[({]\x20?(?:at|AT)\x20?[\])}]"),
    Generator("ip?", r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])", like=r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    Generator("card?", r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])", like=r"[0-9]{4}[./_][0-9]{4}[./_]"),
    Generator("phone?", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])", like=r"[0-9]{3}[-.\x20][0-9]{4}"),
]
# Words that speak for and against personal data when they stand before a candidate.
FOR = {"email": "e-?mail|mailto|contact|write|reach|from", "ip": "ip|host|address|login|client|server|user", "card": "card|visa|credit|debit|pay|amex|charged", "phone": "phone|tel|call|mobile|cell|fax|contact|reach|dial"}
AGAINST = "version|order|invoice|serial|part|item|sku|ref|isbn|page|code|number of|score|hash|mac|ratio|build"
PRECISION = 0.97  # that a kind's threshold must have on the calibration examples
EXAMPLES = 4000

_digits = lambda v: F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a base match is kept."""
    digits = _digits(value)
    n = F.length(digits)
    octet = lambda p: F.coalesce(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).try_cast("int") <= 255, F.lit(False))
    return F.when(kind == "email", True).when(kind == "ip", F.forall(F.split(value, r"\."), octet)).when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(9, 15))


FEATURES = [*(f"is_{k}" for k in KINDS), "base", "length", "digits", "letters", "signs", "groups", "distinct", "luhn", "for", "against", "marked", "joined_left", "joined_right"]


def _features(df: DataFrame) -> DataFrame:
    """df (kind, value, before, after) with the columns FEATURES."""
    kind, v = F.regexp_replace("kind", r"\?", ""), F.col("value")
    before = F.lower("before")
    digits = _digits(v)
    speaks = F.lit(False)
    for k, words in FOR.items():
        speaks |= (kind == k) & before.rlike(rf"\b(?:{words})\b")
    columns = {f"is_{k}": kind == k for k in KINDS} | {
        "base": ~F.col("kind").endswith("?"), "length": F.length(v), "digits": F.length(digits), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "signs": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")), "groups": F.regexp_count(v, F.lit("[A-Za-z0-9]+")), "distinct": F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)))),
        "luhn": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False), "for": speaks, "against": before.rlike(rf"\b(?:{AGAINST})\b"),
        "marked": before.rlike(r"[:=]\s*$"), "joined_left": F.col("before").rlike(r"[\w.#/-]$"), "joined_right": F.col("after").rlike(r"^[\w#/-]"),
    }
    return df.withColumns({name: c.cast("double") for name, c in columns.items()})


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(label, kind, value, before, after): labelled candidates made from numbered rows, half of them no personal data."""
    i = F.col("id")
    part = lambda seed, size: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(size)).cast("int")
    num = lambda seed, width: F.lpad(part(seed, 10**width).cast("string"), width, "0")
    pick = lambda seed, *values: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in values)), part(seed, len(values)) + 1)
    hexa = lambda seed: F.lower(F.hex(part(seed, 65536)))
    chain = lambda sep, first, *rest: F.concat(first, *(x for r in rest for x in (sep, r)))
    good = part("label", 2) == 1
    kind = pick("kind", *KINDS)
    name, site = pick("name", "anna.b", "jo", "max_m", "k.lee", "info"), pick("site", "mail", "corp", "example", "uni-x")
    value = (
        F.when(kind == "email", F.when(good, F.concat(name, num("n", 2), pick("at", " [at] ", "(at)", " (at) "), site, pick("dot", " [dot] ", ".", "(dot)"), pick("tld", "com", "org", "net"))).otherwise(F.concat(pick("w", "look", "meet", "arrive", "noon"), pick("at", " (at) ", "(at)"), pick("w2", "home", "noon", "gate"), F.lit("."), num("m", 1))))
        .when(kind == "ip", F.concat_ws(":", *(hexa(f"h{k}") if k % 3 else F.when(good, hexa(f"h{k}")).otherwise(num(f"h{k}", 2)) for k in range(8))))
        .when(kind == "card", chain(pick("sep", ".", "/", "_"), F.when(good, F.lit("4111")).otherwise(num("c0", 4)), F.when(good, F.lit("1111")).otherwise(num("c1", 4)), F.when(good, F.lit("1111")).otherwise(num("c2", 4)), F.when(good, F.lit("1111")).otherwise(num("c3", 4))))
        .otherwise(F.when(part("form", 2) == 0, F.concat(F.lit("("), num("a", 3), F.lit(") "), num("b", 3), F.lit("-"), num("c", 4))).otherwise(chain(pick("sep", "-", ".", " "), num("a", 3), num("b", 3), num("c", 4))))
    )
    speaks = F.when(kind == "email", pick("for", "email: ", "contact ", "write ")).when(kind == "ip", pick("for", "ip address ", "client ", "host: ")).when(kind == "card", pick("for", "card: ", "visa ", "credit card ")).otherwise(pick("for", "call ", "phone: ", "tel "))
    against = pick("no", "order ", "version ", "serial: ", "part ", "the ", "item ref ", "invoice ", " and then ")
    return spark.range(n).select(good.cast("double").alias("label"), F.concat(kind, F.lit("?")).alias("kind"), value.alias("value"), F.when(good & (part("own", 8) > 0), speaks).otherwise(against).alias("before"), pick("after", " ", ". ", ", ", "\n").alias("after"), (part("part", 3) == 0).alias("calibration"))


def trained(spark: SparkSession) -> tuple[object, dict[str, float]]:
    """The boosted trees, and by kind the lowest threshold that has PRECISION on the calibration examples (1.1: none has)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(examples(spark))).cache()
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1, labelCol="label").fit(rows.where("not calibration"))
    held = model.transform(rows.where("calibration")).select(F.regexp_replace("kind", r"\?", "").alias("kind"), "label", F.round(vector_to_array("probability")[1], 6).alias("p"))
    above = W.partitionBy("kind").orderBy(F.desc("p"))
    good = held.withColumn("precision", F.avg("label").over(above)).where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("p").alias("p")).collect()
    rows.unpersist()
    return model, {k: 1.1 for k in KINDS} | {r["kind"]: max(0.5, r["p"] - 1e-6) for r in good}


def personal_data(docs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the hash are of the base spans; spans has the base and the added ones as kind:start:end, in the order
    of KINDS and then by start. An added span doesn't overlap a base span, nor a looser candidate that starts before it;
    its score reaches the threshold of its kind (the calibrated ones, unless others are given).
    A null text counts as empty; without spans the hash is of the empty string. Repeated rows, and rows without a
    doc_id, have results of their own; other columns are ignored.
    """
    rows = written(matched(docs.select("doc_id", "text"), [*BASE, *LOOSE]).withColumn("row", F.monotonically_increasing_id()))
    model, calibrated = trained(docs.sparkSession)
    thresholds = calibrated | (thresholds or {})
    all_spans = placed(rows.where(F.size("found") > 0).drop("doc_id"), "row")
    kept = all_spans.where(F.col("kind").endswith("?") | _valid(F.col("kind"), F.col("value")))
    before = W.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)  # a frame that shrinks would be quadratic
    is_base = ~F.col("kind").endswith("?")
    kept = kept.withColumn("free", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)) & F.coalesce(F.min(F.when(is_base, F.col("start"))).over(later) >= F.col("end"), F.lit(True)))
    base = kept.where(is_base).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    loose = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_features(kept.where(~is_base & F.col("free"))))
    kind = F.regexp_replace("kind", r"\?", "")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)), kind)
    added = model.transform(loose).where(vector_to_array("probability")[1] >= limit).select("row", kind.alias("kind"), "start", "end", F.lit(False).alias("base"))
    order = F.element_at(F.create_map(*(F.lit(x) for kv in enumerate(KINDS) for x in kv[::-1])), F.col("kind"))
    span = F.struct(order.alias("order"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["text"]), ",")
    by_row = base.union(added).groupBy("row").agg(*(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS), joined(F.collect_list(F.when(F.col("base"), span))).alias("base_text"), joined(F.collect_list(span)).alias("spans"), F.count(F.when(~F.col("base"), 1)).alias("n_added"))
    out = rows.select("row", "doc_id").join(by_row, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *(zero(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base_text", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
