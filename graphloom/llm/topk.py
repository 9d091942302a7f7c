"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Queries and vectors are dealt in a grid: a task holds a group of queries, and a share of the vectors streams past it in blocks. A
block keeps, for each dimension, its components in order. For a query the algorithm walks all lists together, from the end where
the query's component gains most; it scores every row that comes up, and stops when no row that hasn't come up can beat the kth best
result, that of earlier blocks included. Queries that would see a good part of a block score it together, by one
product of matrices. The best k of each share are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 2048  # vectors in a block, and queries that meet it at a time
STEP = 32  # list entries walked before the first look at the bound
HELD = 2**22  # components of the queries that a task holds
CELLS = 64  # tasks among which the pairs of queries and vectors are dealt


class SortedLists:
    """The per-dimension lists of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.sorted = np.sort(self.values, axis=0)  # dimension by column, smallest first
        self._lists = None

    @property
    def lists(self) -> np.ndarray:
        """The rows in the order of sorted."""
        if self._lists is None:
            self._lists = np.argsort(self.values, axis=0, kind="stable")
        return self._lists

    def ends(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """How deep each query walks: to the first look at the bound that finds it below the query's floor; n where it never is."""
        n = len(self.ids)
        at = np.array([0, *(STEP << i for i in range(n.bit_length()) if STEP << i < n)])
        bounds = _products(np.maximum(queries, 0), self.sorted[n - 1 - at]) + _products(np.minimum(queries, 0), self.sorted[at])  # of rows that come up below
        below = np.c_[bounds < floors[:, None], np.ones(len(queries), bool)]
        return np.r_[at, n][below.argmax(1)]

    def came(self, query: np.ndarray, end: int) -> np.ndarray:
        """The rows that come up to a depth."""
        used = np.flatnonzero(query)
        rows = np.where(query[used] > 0, self.lists[len(self.ids) - end :, used], self.lists[:end, used])
        return np.unique(rows)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of rows of x and y, exact: by floating point where no sum can leave its integers."""
    most = lambda v: float(np.abs(v.astype(np.float64)).max(initial=0))
    largest = most(x) * most(y) * x.shape[1]
    if largest < 2**52:
        kind = np.float32 if largest < 2**23 else np.float64
        return x.astype(kind) @ y.astype(kind).T
    return x @ y.T


class Best:
    """The k best rows so far of each query of one width, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)  # the kth best score

    def meet(self, block: SortedLists) -> None:
        for start in range(0, len(self.ids), BLOCK):
            part = slice(start, start + BLOCK)
            queries, floors = self.values[part], self.floor[part]
            ends = block.ends(queries, floors)
            many = ends * np.maximum(1, (queries != 0).sum(1)) * 4 >= len(block.ids)
            self._meet_all(np.flatnonzero((ends > 0) & many) + start, block)
            for q in np.flatnonzero((ends > 0) & ~many):
                rows = block.came(queries[q], ends[q])
                scores = _products(queries[q][None], block.values[rows])[0]
                good = (scores >= floors[q]) & (block.ids[rows] != self.ids[start + q])
                self._add(np.full(good.sum(), start + q), block.ids[rows[good]], scores[good])

    def _meet_all(self, who: np.ndarray, block: SortedLists) -> None:
        """The whole block for the queries in who."""
        if not len(who):
            return
        scores = _products(self.values[who], block.values)
        good = scores >= self.floor[who][:, None]
        first, last = (np.searchsorted(block.ids, self.ids[who], side) for side in ("left", "right"))
        for q in np.flatnonzero(last > first):
            good[q, first[q] : last[q]] = False
        full = np.flatnonzero(good.sum(1) > 4 * self.k)  # only its own kth best and what ties with it
        if len(full):
            some = np.where(good[full], scores[full], np.finfo(np.float32).min if scores.dtype.kind == "f" else np.iinfo(np.int64).min)
            good[full] &= scores[full] >= np.partition(some, -self.k, axis=1)[:, -self.k][:, None]
        q, v = np.nonzero(good)
        self._add(who[q], block.ids[v], scores[q, v])

    def _add(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        score = score.astype(np.int64)
        old = np.isin(self.row, row)
        rows, vecs, scores = (np.concatenate([a[old], b]) for a, b in ((self.row, row), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vecs, -scores, rows))
        rows, vecs, scores = rows[order], vecs[order], scores[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        self.floor[rows[place == self.k - 1]] = scores[place == self.k - 1]
        kept = place < self.k
        self.row, self.vec, self.score = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.row, rows), (self.vec, vecs), (self.score, scores)))


def _by_width(rows: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of rows, by their length."""
    ids, at = rows.column("vec_id").to_numpy(), rows.column("vector").offsets.to_numpy()
    values = rows.column("vector").values.to_numpy()
    widths = np.diff(at)
    return {int(w): (ids[widths == w], values[at[:-1][widths == w][:, None] + np.arange(w)]) for w in np.unique(widths)}


def _grid(queries: DataFrame, vectors: DataFrame, block: int) -> tuple[int, int]:
    """Groups of queries that a task can hold, and shares of vectors: as many as make CELLS tasks, of a block at least."""
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    groups = max(1, -(-n // max(block, HELD // max(1, width or 1))))
    return groups, max(1, min(-(-CELLS // groups), -(-vectors.count() // block)))


def _dealt(queries: DataFrame, vectors: DataFrame, groups: int, shares: int) -> DataFrame:
    """(side, vec_id, vector) by cell: a group of the queries (side 0) first, then a share of the vectors (side 1). Each pair meets in one cell."""
    at = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = queries.select(F.lit(0).alias("side"), "vec_id", "vector", at(groups).alias("g"), every(shares).alias("s"))
    other = vectors.select(F.lit(1).alias("side"), "vec_id", "vector", at(shares).alias("s"), every(groups).alias("g"))
    cell = (F.col("g") * shares + F.col("s")).alias("cell")
    rows = own.unionByName(other).select("side", "vec_id", "vector", cell)
    return rows.repartitionById(groups * shares, "cell").sortWithinPartitions("side").select("side", "vec_id", "vector")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product for each query.

    vectors and queries have (vec_id, embedding). Components become floor(256 * x), x as double. Rows whose vec_id or
    vector is null, or whose vector holds null or non-finite components, take no part; neither do vectors of another
    length than the query's. A query's own id is no candidate; a repeated query row has one result. Ties have the
    smaller vec_id first; rows that repeat a vec_id are candidates each. Other columns are ignored.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.transform("embedding", lambda v: v.cast("double"))
        fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & fit).select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE)).alias("vector"))

    def best(batches):
        found, asked, waiting = {}, {}, {}  # by width

        def met(width):
            ids, values = (np.concatenate(x) for x in zip(*waiting.pop(width), strict=True))
            for start in range(0, len(ids), block):
                found[width].meet(SortedLists(ids[start : start + block], values[start : start + block]))

        for batch in batches:
            split = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            for width, part in _by_width(batch.slice(0, split)).items():
                asked.setdefault(width, []).append(part)
            if split == batch.num_rows:
                continue
            for width, parts in asked.items():
                found[width] = Best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
            asked = {}
            for width, part in _by_width(batch.slice(split)).items():
                if width in found:
                    waiting.setdefault(width, []).append(part)
                    if sum(len(ids) for ids, _ in waiting[width]) >= block:
                        met(width)
        for width in list(waiting):
            met(width)
        for b in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b.ids[b.row], b.vec, b.score)], names=["query_id", "vec_id", "score"])

    left, right = whole(queries).dropDuplicates(["vec_id"]), whole(vectors)
    found = _dealt(left, right, *_grid(left, right, block)).mapInArrow(best, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
