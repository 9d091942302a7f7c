"""Choosing a set of points: greedy by score and diversity, by Thompson draws, and refined by swaps. Similarity: 1 / (1 + distance)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..sources.corpora import saved


def _similarity(x: Column | str, vector: list[float]) -> Column:
    center = F.lit([float(v) for v in vector])
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(x, center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))


def beta_draw(wins: Column, losses: Column, key: Column, seed: str) -> Column:
    """A draw from Beta(1 + wins, 1 + losses) that follows from seed and key: an order statistic of as many uniforms as it takes (wins + losses + 1)."""
    each = F.transform(F.sequence(F.lit(1).cast("long"), (wins + losses + 1).cast("long")), lambda i: uniform(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))))
    return F.get(F.array_sort(each), wins.cast("int"))


def greedy_selection(points: DataFrame, k: int, diversity: float) -> DataFrame:
    """(rank, id): k points (id, x, score), each with the best score less diversity times its largest similarity to those before; ties to smaller ids.

    One pass over the points a pick, in which the vector of the last pick is a constant: every similarity counts and no pair table is needed.
    """
    state = saved(points.select("id", "x", "score", F.lit(0.0).alias("close")))
    chosen: list[int] = []
    while True:
        left = state.where(~F.col("id").isin(chosen)) if chosen else state
        row = left.orderBy(F.desc(F.round(F.col("score") - diversity * F.col("close"), 9)), "id").select("id", "x").first()
        if row is None:
            break
        chosen.append(row["id"])
        if len(chosen) == k:
            break
        state = saved(state.withColumn("close", F.greatest("close", _similarity("x", row["x"]))))
    return points.sparkSession.createDataFrame(list(enumerate(chosen, 1)), "rank int, id long")


def thompson_selection(points: DataFrame, k: int, weight: float, diversity: float, seed: str = "33") -> DataFrame:
    """(rank, id): greedy_selection of points (id, x, score, wins, losses) by a Beta draw of their record plus weight times score."""
    utility = beta_draw(F.col("wins"), F.col("losses"), F.col("id"), seed) + weight * F.col("score")
    return greedy_selection(points.select("id", "x", utility.alias("score")), k, diversity)


def _reward(scores: np.ndarray, similar: np.ndarray, diversity: float) -> float:
    """Sum of scores less diversity times the sum of each member's largest similarity to another one."""
    return float(scores.sum() - diversity * (np.where(np.eye(len(scores)) > 0, 0, similar).max(1).sum() if len(scores) > 1 else 0))


def swapped(points: DataFrame, chosen: DataFrame, worst: int, diversity: float, rounds: int) -> DataFrame:
    """(id): the set chosen (id) of points (id, x, score), of at least two, after up to rounds of its best swap.

    In a round the worst members (lowest score less diversity times their largest similarity in the set) may each be swapped for any
    point outside; all such swaps are scored in one pass, against the members' vectors as constants. The best one is made if it raises the
    set's reward (scores less diversity times each member's largest similarity to another); ties to the smaller new, then old id.
    """
    members = [(r["id"], list(r["x"]), r["score"]) for r in points.join(F.broadcast(chosen.select("id")), "id").orderBy("id").collect()]  # as many as the set has
    for _ in range(rounds):
        ids, x, score = [m[0] for m in members], np.array([m[1] for m in members]), np.array([m[2] for m in members])
        similar = 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)))
        largest = np.where(np.eye(len(ids)) > 0, 0, similar).max(1)
        last = sorted(range(len(ids)), key=lambda i: (round(score[i] - diversity * largest[i], 9), ids[i]))[:worst]
        options = []
        for m in last:
            stay = [i for i in range(len(ids)) if i != m]
            inner = np.where(np.eye(len(stay)) > 0, 0, similar[np.ix_(stay, stay)]).max(1) if len(stay) > 1 else np.zeros(len(stay))
            met = sum((F.greatest(F.lit(float(b)), F.get("sims", F.lit(i))) for i, b in zip(stay, inner, strict=True)), F.lit(0.0))
            own = F.greatest(F.lit(0.0), *(F.get("sims", F.lit(i)) for i in stay))
            reward = F.lit(float(score[stay].sum())) + F.col("score") - diversity * (met + own)
            options.append(F.struct(F.round(reward, 9).alias("reward"), (-F.col("id")).alias("new"), F.lit(-ids[m]).cast("long").alias("old")))
        outside = points.where(~F.col("id").isin(ids)).select("id", "x", "score", F.array(*(_similarity("x", m[1]) for m in members)).alias("sims"))
        best = outside.select("id", "x", "score", F.array_max(F.array(*options)).alias("o")).orderBy(F.desc("o")).first()
        if best is None or best["o"]["reward"] <= _reward(score, similar, diversity) + 1e-9:
            break
        members = sorted([m for m in members if m[0] != -best["o"]["old"]] + [(best["id"], list(best["x"]), best["score"])])
    return points.sparkSession.createDataFrame([(m[0],) for m in members], "id long")
