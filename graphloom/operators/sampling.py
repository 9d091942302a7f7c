"""Seeded sampling, orders, top-k, deduplication and set operations. All randomness follows from md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..sources.corpora import saved
from .ranking import numbered_in


def seeded(seed: str, *key: str) -> Column:
    return F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key))


def random_pairs(keys: DataFrame, key: str, by: str, seed: str = "1") -> DataFrame:
    """(by, pair, a, b): disjoint pairs of keys in seeded order, inside each value of by; an odd one out is left."""
    placed = numbered_in(keys.select(by, key), by, F.md5(seeded(seed, key)), key).withColumn("pair", F.ceil(F.col("pos") / 2))
    return placed.groupBy(by, "pair").agg(F.min_by(key, "pos").alias("a"), F.max_by(key, "pos").alias("b"), F.count("*").alias("n")).where("n = 2").drop("n")


def seeds(keys: DataFrame, key: str, n: int, seed: str = "2") -> DataFrame:
    """n keys, those that come first in seeded order."""
    return keys.select(key, F.md5(seeded(seed, key)).alias("h")).orderBy("h", key).limit(n).select(key)


def weighted_order(items: DataFrame, by: str, key: str, weight: str, seed: str = "3") -> DataFrame:
    """items with pos: a weighted order without replacement by -ln(u) / w; items without positive weight come last."""
    u = uniform(seeded(seed, by, key))
    draw = F.when(F.col(weight) > 0, F.round(-F.log(u) / F.col(weight), 9)).otherwise(float("inf"))
    return numbered_in(items.select(by, key, weight), by, draw, key)


def top_k(items: DataFrame, by: str, key: str, score: str, k: int) -> DataFrame:
    """(by, key, score, rank): the k best of each group, NaN and null last, ties by key."""
    order = W.partitionBy(by).orderBy(F.desc(F.coalesce(F.nanvl(score, F.lit(float("-inf"))), F.lit(float("-inf")))), key)
    return items.select(by, key, score, F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def temperature(scores: DataFrame, by: str, key: str, score: str, t: float) -> DataFrame:
    """(by, key, weight): uniform from temperature 1 up, positive scores from 0 down, between them a mix; all 1 where all would be 0."""
    positive = F.greatest(F.col(score), F.lit(0.0))
    raw = F.lit(1.0) if t >= 1 else positive if t <= 0 else (1 - t) * positive + t
    out = scores.select(by, key, raw.alias("w")).withColumn("all", F.sum("w").over(W.partitionBy(by)))
    return out.select(by, key, F.round(F.when(F.col("all") > 0, F.col("w")).otherwise(1.0), 6).alias("weight"))


def first_of_each(hashes: DataFrame, key: str = "graph_id") -> DataFrame:
    """(hash, first, n): the smallest key of each hash."""
    return hashes.groupBy("hash").agg(F.min(key).alias("first_graph_id"), F.count("*").alias("n"))


def novel(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of hashes whose hash isn't known."""
    return hashes.join(known.select("hash").distinct(), "hash", "left_anti")


def accepted(probabilities: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """(key, class, p): every class whose probability (key, p array) is in [low, high]; a key can be accepted for several."""
    return probabilities.select(key, F.posexplode("p").alias("class", "prob")).where(F.col("prob").between(low, high)).select(key, "class", F.round("prob", 6).alias("p"))


def unseen(states: DataFrame, *excluded: DataFrame, on: str = "key") -> DataFrame:
    """The states whose key is in none of the excluded tables."""
    for x in excluded:
        states = states.join(x.select(on).distinct(), on, "left_anti")
    return states


def beam(states: DataFrame, by: str, key: str, score: str, limit: int, seed: str = "4") -> DataFrame:
    """(by, key, score, rank): the better half of the beam by score, the rest of it in seeded order from what is left."""
    best = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))
    ranked = states.select(by, key, score, best.alias("best"))
    rest = F.when(F.col("best") > max(1, limit // 2), F.md5(seeded(seed, by, key)))
    chance = F.row_number().over(W.partitionBy(by).orderBy(rest.asc_nulls_first(), "best"))
    kept = ranked.withColumn("chance", chance).where((F.col("best") <= max(1, limit // 2)) | (F.col("chance") <= limit))
    return kept.select(by, key, score, F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key)).alias("rank"))


def farthest_points(points: DataFrame, k: int, seed: str = "5") -> DataFrame:
    """(rank, id): greedy selection by the largest smallest cosine distance to those chosen; a driver loop of k small queries."""
    unit = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    unit_x = points.select("id", F.transform("x", lambda v: v / F.when(unit > 0, unit).otherwise(1.0)).alias("x"))
    state = unit_x.withColumn("near", F.lit(float("inf")))
    state = saved(state)
    chosen = [state.orderBy(F.md5(seeded(seed, "id")), "id").select("id", "x").first()]
    for _ in range(k - 1):
        center = F.lit([float(v) for v in chosen[-1]["x"]])
        d = 1 - F.aggregate(F.zip_with("x", center, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        state = saved(state.withColumn("near", F.least("near", F.round(d, 9))))
        chosen.append(state.orderBy(F.desc("near"), "id").select("id", "x").first())
    return points.sparkSession.createDataFrame([(i + 1, r["id"]) for i, r in enumerate(chosen)], "rank int, id long")
