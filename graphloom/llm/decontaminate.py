"""Benchmark passages in documents by SimHash windows and multi-index Hamming blocks, with DataFrame functions only.

Texts become words (runs of letters and digits, lower case) and 5-word shingles. A window of a document is as long as
an item of the benchmark. Windows whose shingles are all foreign to the benchmark can't resemble an item, so windows
are opened where a document holds enough of an item's shingles to reach the similarity. Each window and item has a
60-bit SimHash, that of a window as the difference of two running sums; the fingerprints are cut into blocks, and a window
meets an item where one of their blocks differs in so few bits that no pair within the radius is missed. The pairs within
the radius are verified: sum of the smaller over sum of the larger shingle multiplicities, from intervals of starts in
which an occurrence counts. Rows and work grow with the lengths of documents and items, not with their squares. A
document with fewer shingles than an item is its own only window; the shingles that it shares are counted in full
before, so it is verified without a fingerprint.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, small_side, written

WIDTH = 5  # words in a shingle
SIMILARITY = 0.8
RADIUS = 23  # bits; at a similarity of 0.8 the expected distance of 60 bits is 9.1, with a deviation of 2.8
BLOCKS = 6
BITS = 60 // BLOCKS
_WITHIN = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BITS), n)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles in order; of the whole sequence, where it is shorter; none without words."""

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WIDTH + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(WIDTH))))
        return F.when(F.size(w) >= WIDTH, every).when(F.size(w) > 0, F.array(F.xxhash64(w, F.size(w)))).otherwise(F.array().cast("array<long>"))

    return F.flatten(F.transform(F.array(words(F.coalesce(text, F.lit("")))), of))  # a text is split once, and not for each shingle


LANES = BLOCKS * BITS // 2  # numbers that count two bits each, in lanes of 31 bits


def _lanes(h: Column) -> list[Column]:
    """Two bits of a shingle's fingerprint hash in each number, 31 bits apart, so that sums over up to 2^31 shingles don't mix."""
    mixed = F.xxhash64(h, F.lit(1))
    bit = lambda b: F.shiftrightunsigned(mixed, b).bitwiseAND(F.lit(1).cast("long"))
    return [bit(2 * k) + F.shiftleft(bit(2 * k + 1), 31) for k in range(LANES)]


def _print(sums: list[Column], n: Column) -> Column:
    """The fingerprint of n shingles from the sums of their lanes, in one number: a bit is set where more than half have it."""
    low = (1 << 31) - 1
    counts = [c for s in sums for c in (s.bitwiseAND(F.lit(low).cast("long")), F.shiftrightunsigned(s, 31))]
    return sum((F.when(c * 2 > n, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b, c in enumerate(counts)), F.lit(0).cast("long"))


def _keys(mark: Column, n: Column) -> Column:
    """For each block of a fingerprint a number with the length, the block's place and, in the last BITS bits, the block."""
    at = lambda k: F.shiftrightunsigned(mark, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    return F.array(*(F.shiftleft(n.cast("long"), BITS + 3) + (k << BITS) + at(k) for k in range(BLOCKS)))


def _running(involved: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, version, at, s0, ...): running sums of the lanes over the shingles of each document in the spans that involved (doc_id, version, spans) lists."""
    inside = F.flatten(F.transform("spans", lambda x: F.transform(F.slice("hs", x["low"] + 1, x["high"] - x["low"] + 1), lambda h, i: F.struct((x["low"] + i).alias("at"), h.alias("h")))))
    rows = texts.join(involved, ["doc_id", "version"]).select("doc_id", "version", "spans", shingles(F.col("text")).alias("hs")).select("doc_id", "version", F.explode(inside).alias("x"))
    rows = rows.select("doc_id", "version", "x.at", *(c.alias(f"l{k}") for k, c in enumerate(_lanes(F.col("x.h")))))
    so_far = W.partitionBy("doc_id", "version").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("doc_id", "version", "at", *(F.sum(f"l{k}").over(so_far).alias(f"s{k}") for k in range(LANES)), *(f"l{k}" for k in range(LANES)))


def _shared(per_item: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, version, item, n, start) with shared: how many shingles of the item the window has, with multiplicities.

    The j-th occurrence of a shingle, at p, counts in windows that begin after p - n and after the occurrence that is times
    places before it, up to p. The starts of these intervals add one to a running count, their ends take it away.
    """
    spots = per_item.groupBy("doc_id", "version", "item", "n", "h").agg(F.first("times").alias("times"), F.array_sort(F.collect_list("at")).alias("spots"))
    before = lambda i: F.when(i >= F.col("times"), F.get("spots", (i - F.col("times")).cast("int"))).otherwise(-1)
    steps = F.flatten(F.transform("spots", lambda p, i: F.array(F.struct(F.greatest(p - F.col("n") + 1, before(i) + 1, F.lit(0)).alias("start"), F.lit(1).alias("step")), F.struct((p + 1).alias("start"), F.lit(-1).alias("step")))))
    events = spots.select("doc_id", "version", "item", "n", F.explode(steps).alias("e")).groupBy("doc_id", "version", "item", "n", "e.start").agg(F.sum("e.step").alias("step"))
    both = events.withColumn("asked", F.lit(False)).union(asked.select("doc_id", "version", "item", "n", "start", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked")))
    so_far = W.partitionBy("doc_id", "version", "item").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("shared", F.sum("step").over(so_far)).where("asked").drop("asked", "step")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows): for each document and item, the best window of at least similarity.

    docs has (doc_id, text), benchmark (item_id, text). Texts that are null or without words match nothing, and rows
    without an id have no matches. Documents that repeat a doc_id are told apart by their text and reported under the
    one id; equal items are each reported. Other columns are ignored. An item under five words has one shingle, of
    all its words: it matches documents that consist of these words, and isn't looked for inside longer ones.
    """
    items = benchmark.where("item_id is not null").select("item_id", shingles(F.col("text")).alias("hs")).where(F.size("hs") > 0)
    items = written(items.dropDuplicates(["item_id", "hs"]).withColumn("item", F.xxhash64("item_id", "hs")).withColumn("n", F.size("hs")))
    of_items = written(items.select("item", "n", F.explode("hs").alias("h")).groupBy("item", "n", "h").agg(F.count("*").alias("times")))

    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))
    placed = texts.select("doc_id", "version", F.posexplode(shingles(F.col("text"))).alias("at", "h"))
    per_item = written(placed.join(small_side(of_items, of_items.count()), "h").select("doc_id", "version", "item", "n", "h", "at", "times").distinct())

    # A window can hold no more of an item's shingles than its document does.
    enough = written(per_item.groupBy("doc_id", "version", "item", "n", "h").agg(F.least(F.count("*"), F.max("times")).alias("shared")).groupBy("doc_id", "version", "item", "n").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= similarity * F.col("n")))
    near = written(per_item.join(small_side(enough.select("doc_id", "version", "item"), enough.count()), ["doc_id", "version", "item"]))

    # The starts of windows with a shingle at one of the hits, each once; and the spans that these windows cover.
    hits = near.select("doc_id", "version", "n", "at").distinct()
    last = F.lag("at").over(W.partitionBy("doc_id", "version", "n").orderBy("at"))
    starts = hits.withColumn("first", F.greatest(F.col("at") - F.col("n") + 1, F.coalesce(last + 1, F.lit(0)), F.lit(0))).select("doc_id", "version", "n", F.explode(F.sequence("first", "at")).alias("start"))
    reach = hits.select("doc_id", "version", F.greatest(F.col("at") - F.col("n") + 1, F.lit(0)).alias("low"), (F.col("at") + F.col("n") - 1).alias("high"))
    covered = F.max("high").over(W.partitionBy("doc_id", "version").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    spans = reach.withColumn("low", F.greatest("low", F.coalesce(covered + 1, F.lit(0)))).where("low <= high").groupBy("doc_id", "version").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = written(spans)
    whole = texts.join(small_side(spans.select("doc_id", "version"), spans.count()), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])

    running = written(_running(spans, whole))
    at_end = running.select("doc_id", "version", F.col("at").alias("end"), *(F.col(f"s{k}").alias(f"e{k}") for k in range(LANES)))
    at_start = running.select("doc_id", "version", F.col("at").alias("start"), *((F.col(f"s{k}") - F.col(f"l{k}")).alias(f"f{k}") for k in range(LANES)))
    windows = starts.withColumn("end", F.col("start") + F.col("n") - 1).join(at_end, ["doc_id", "version", "end"]).join(at_start, ["doc_id", "version", "start"])
    prints = windows.select("doc_id", "version", "start", "n", _print([F.col(f"e{k}") - F.col(f"f{k}") for k in range(LANES)], F.col("n")).alias("print"))
    sums = items.select("item", "n", F.explode("hs").alias("h")).select("item", "n", *(c.alias(f"l{k}") for k, c in enumerate(_lanes(F.col("h"))))).groupBy("item", "n").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LANES)))
    item_prints = sums.select("item", "n", _print([F.col(f"l{k}") for k in range(LANES)], F.col("n")).alias("other"))

    # Each item has a row for every block and mask. They are three numbers, as a broadcast of them is made in the driver's memory.
    each = item_prints.select("item", "other", F.explode(_keys(F.col("other"), F.col("n"))).alias("key"))
    nearby = each.withColumn("mask", F.explode(F.lit(_WITHIN))).select(F.col("key").bitwiseXOR(F.col("mask").cast("long")).alias("key"), "item", "other")
    nearby = nearby.hint("broadcast" if items.count() * BLOCKS * len(_WITHIN) <= BROADCAST_ROWS else "merge")
    met = prints.withColumn("key", F.explode(_keys(F.col("print"), F.col("n")))).join(nearby, "key")
    met = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= RADIUS).select("doc_id", "version", "item", "n", "start").distinct()

    found = _shared(near, met).withColumn("similarity", F.col("shared") / (2 * F.col("n") - F.col("shared"))).select("doc_id", "version", "item", "start", "similarity")
    lengths = whole.select("doc_id", "version", F.size(shingles(F.col("text"))).alias("m"))
    shorter = enough.join(lengths, ["doc_id", "version"]).where("m < n")
    shorter = shorter.select("doc_id", "version", "item", F.lit(0).alias("start"), (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity"))
    found = found.union(shorter).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item").agg(F.round(F.max("similarity"), 6).alias("similarity"), F.countDistinct("version", "start").alias("n_windows"))
    return best.join(items.select("item", "item_id"), "item").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.sum("n_windows").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows without a doc_id stay."""
    found = written(contaminated(docs, benchmark, similarity).select("doc_id").distinct())
    return docs.join(small_side(found, found.count()), "doc_id", "left_anti").select(*docs.columns)
