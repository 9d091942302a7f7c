"""Connected components of a large set of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id that can be reached.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Null ends and loops are ignored.
    """
    pairs = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = written(large.join(lowest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
