"""Target-distribution importance resampling over hashed word features.

Identical texts are collapsed by grouping the full text. Each distinct text is cut into features once and its counts
are multiplied by its number of copies; a bucket's gain compares its share in the target with its share in the documents, and
a text's weight is the floored mean of its features' gains. The weights are joined back to the documents, which then get
Gumbel noise of their own doc_id; the highest scores are a draw without replacement by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import numbered

from .shared import to_copies, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
LONGEST = 1  # words in a feature
PERCENT = 10  # of the documents that are long enough
LEAST_WORDS = 20
SEED = 2024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _buckets(found: Column, longest: int, buckets: int) -> Column:
    """The bucket of each run of 1 to longest consecutive words."""
    bucket = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(found, i, n), " ")))

    return F.concat(F.transform(found, bucket), *map(runs, range(2, longest + 1)))


def classes(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(text_key, copies, n_words, buckets): each distinct text of docs once, as a written table; text_key is its SHA-256."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    found = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), "copies", words(F.col("text")).alias("found"))
    return written(found.select("text_key", "copies", F.size("found").cast("long").alias("n_words"), _buckets(F.col("found"), longest, buckets).alias("buckets")))


def _counts(texts: DataFrame, name: str) -> DataFrame:
    return texts.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(texts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share in target over that in texts, from classes of both."""
    all_ = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = written(all_.join(_counts(texts, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]))
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    num = lambda c: F.col(c).cast("double") + 1.0
    return both.select("bucket", F.floor(1000 * F.log(num("t") * float(s + buckets) / (num("s") * float(t + buckets)))).alias("gain"))


def weights(texts: DataFrame, gain: DataFrame) -> DataFrame:
    """(text_key, copies, n_words, n_features, weight) of classes: weight is the floored mean of gains, 0 without features."""
    each = texts.select("text_key", "copies", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gain), "bucket", "left")  # a row a bucket
    summed = each.groupBy("text_key", "copies", "n_words").agg(F.count("bucket").alias("n_features"), F.sum("gain").alias("sum"))
    return summed.select("text_key", "copies", "n_words", "n_features", F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_features, weight, score, rank (1, 2, 3 ... of those drawn, else null).

    target has a column text. Null and empty texts have no features and weight 0. Of the documents with at least least_words words the
    percent (rounded down) with the highest scores are drawn, ties to the smaller doc_id. A null doc_id draws as an empty one; repeated
    rows of a doc_id each have a row, and equal ones any order among themselves. An empty target gives the weights of one without counts.
    """
    texts = classes(docs, longest, buckets)
    weighed = written(weights(texts, gains(texts, classes(target, longest, buckets), buckets)))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_key")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(to_copies(rows, weighed, "text_key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")))
    long_enough = F.col("n_words") >= least_words
    drawn = scored.where(long_enough).count() * percent // 100
    placed = numbered(scored.where(long_enough), F.desc("score"), "doc_id", "weight", "n_features")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).union(scored.where(~long_enough).select(*columns, F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs that resampled draws, with all their columns; doc_id has to be unique for this, and rows without one aren't drawn."""
    ids = written(resampled(docs, target, **settings).where("rank is not null").select("doc_id"))
    return docs.join(ids, "doc_id", "left_semi")
