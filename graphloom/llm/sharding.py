"""Sharding by best-fit-decreasing bin packing of indivisible groups: documents with equal texts stay together.

Groups are sorted by size, and each enters the shard whose remaining capacity is the least that holds it; the remaining
capacities of the open shards are kept in a balanced tree. Groups of one size are alike, so the packing needs only how many groups have each
size: the driver sees a row a distinct size (fewer than 2 sqrt(total bytes), as sizes below b are fewer than b and sizes above
it fewer than total / b), and what it returns are runs of places in the order of groups. Groups find their run by a join, so
every group is placed as if they had been packed one by one.

With a number of shards instead of a capacity, the capacity is the least at which the packing needs no more shards; a group
that is larger than an equal share has a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import numbered

from .shared import small_side, to_copies, written

SHARDS = 16
LEAF = 512  # entries in a leaf of the tree


class Capacities:
    """(remaining, shard) of open shards in a balanced tree: sorted leaves of at most LEAF entries under their sorted last entries."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.last = [[entry]], [entry]
            return
        i = min(bisect_left(self.last, entry), len(self.last) - 1)
        leaf = self.leaves[i]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            self.leaves[i : i + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2 :]]
            self.last[i : i + 1] = [leaf[LEAF // 2 - 1], leaf[-1]]
        else:
            self.last[i] = leaf[-1]

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Takes out the entry with the least remaining capacity that isn't below least, ties to the smaller shard."""
        i = bisect_left(self.last, (least, -1))
        if i == len(self.last):
            return None
        leaf = self.leaves[i]
        entry = leaf.pop(bisect_left(leaf, (least, -1)))
        if leaf:
            self.last[i] = leaf[-1]
        else:
            del self.leaves[i], self.last[i]
        return entry


Run = tuple[int, int, int, int, int]  # size, place of the first group in the order, groups, first shard, groups a shard


def best_fit(sizes: list[tuple[int, int, int]], capacity: int, most: int | None = None, shard: int = 0) -> tuple[list[Run], int] | None:
    """Runs and the number of shards for sizes (size, place of its first group, groups), largest first; None if it needs over most shards.

    A group larger than the capacity has a shard of its own. Shards are numbered from shard.
    """
    left, runs, used = Capacities(), [], 0
    for size, place, groups in sizes:
        while groups:
            found = left.tightest(size)
            if found:
                rest, at = found
                put = each = min(groups, rest // size)
                if rest > put * size:
                    left.add((rest - put * size, at))
                runs.append((size, place, put, shard + at, each))
            else:  # fresh shards, each filled before the next one is opened
                put, each = groups, max(1, capacity // size)
                fresh = -(-put // each)
                if most is not None and used + fresh > most:
                    return None
                for k in range(fresh):
                    rest = capacity - size * min(each, put - k * each)
                    if rest > 0:
                        left.add((rest, used + k))
                runs.append((size, place, put, shard + used, each))
                used += fresh
            place, groups = place + put, groups - put
    return runs, used


def packing(sizes: list[tuple[int, int]], shards: int | None = SHARDS, capacity: int | None = None) -> list[Run]:
    """Runs for sizes (size, groups), largest first: at a given capacity, or else at the least one that needs at most shards."""
    placed, place = [], 0
    for size, groups in sizes:
        placed.append((size, place, groups))
        place += groups
    if capacity is not None:
        return best_fit(placed, capacity)[0]
    total, own = sum(size * groups for size, groups in sizes), []
    while placed and len(own) < shards - 1 and placed[0][0] * (shards - len(own)) >= total:  # no less than an equal share of what is left
        size, place, groups = placed[0]
        own.append((size, place, 1, len(own), 1))
        total -= size
        placed[:1] = [(size, place + 1, groups - 1)] if groups > 1 else []
    if not placed:
        return own
    free = shards - len(own)
    low = -(-total // free)
    high = low + placed[0][0]  # always enough: a group that fits nowhere would find every shard above an equal share
    best = None
    while low < high:
        middle = (low + high) // 2
        found = best_fit(placed, middle, free, len(own))
        if found:
            best, high = found, middle
        else:
            low = middle + 1
    return own + (best or best_fit(placed, high, None, len(own)))[0]


def assigned(rows: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(text_key, copies, position, shard): each group of rows (text_key, size) with its place in the order of groups, as a written table."""
    groups = rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))
    placed = written(numbered(written(groups), F.desc("bytes"), "text_key"))
    counts = placed.groupBy("bytes").agg(F.count("*").alias("groups")).toArrow().to_pydict()
    runs = packing(sorted(zip(counts["bytes"], counts["groups"], strict=True), reverse=True), shards, capacity)
    columns = list(zip(*runs, strict=True)) if runs else [[]] * 5
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("run_bytes", "first", "groups", "first_shard", "each"), columns, strict=True)})
    found = small_side(rows.sparkSession.createDataFrame(table), len(runs))
    inside = (F.col("bytes") == F.col("run_bytes")) & (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("groups"))
    shard = (F.col("first_shard") + F.floor((F.col("position") - F.col("first")) / F.col("each"))).cast("int")
    return written(placed.join(found, inside).select("text_key", "copies", "position", shard.alias("shard")))


def _keyed(docs: DataFrame) -> list:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key")]


def sharded(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1. Rows with equal texts are one group and share a shard; a null text counts as an empty
    one. slot numbers the rows of a shard from 0, larger groups first, then by doc_id; rows without a doc_id and repeated rows have
    slots of their own. With a capacity there are as many shards as it takes, and a group above it has one for itself. An empty table has no rows.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed(docs)))
    groups = assigned(rows, shards, capacity)
    placed = numbered(written(to_copies(rows, groups, "text_key")), "shard", "position", "doc_id", name="place")
    before = groups.groupBy("shard").agg(F.sum("copies").alias("rows"))
    starts, total = [], 0
    for row in before.orderBy("shard").collect():  # a row a shard
        starts.append((row["shard"], total))
        total += row["rows"]
    first = small_side(docs.sparkSession.createDataFrame(starts, "shard int, start long"), len(starts))
    out = placed.join(first, "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = SHARDS, capacity: int | None = None) -> None:
    """Writes docs as Parquet under path, a folder shard=N for each shard; files of a shard follow the order of its slots."""
    docs = docs.drop("shard")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *_keyed(docs))
    groups = assigned(written(keyed.select("text_key", "size")), shards, capacity)
    order = ["shard", "position", "doc.doc_id"]
    placed = to_copies(keyed.select("doc", "text_key"), groups, "text_key").repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("doc.*", "shard").write.partitionBy("shard").parquet(path)
