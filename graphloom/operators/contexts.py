"""Which points lie between two: a sparse graph over all distances, disjoint paths in it, and the paths' neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpora import saved
from .matching import BLOCK, nearest, nearest_lists
from .paths import disjoint_paths_between, followed_labels

LISTED = 12  # nearest points that a point's list holds for the spanning tree
LEAST = 1e-6  # the distance of points where no two differ


def _nearest_outside(asked: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """(a, b, e): from each asked point (id, x, c) its nearest among points (id, x, c) of another component at a distance above 0."""
    return nearest_lists(asked, points, 1, 6, block).select("a", "b", _edge("d", "i", "j"))


def _edge(w: str, i: str, j: str):
    return F.struct(F.round(w, 6).alias("w"), F.least(i, j).alias("src"), F.greatest(i, j).alias("dst")).alias("e")


def spanning_tree_of_points(points: DataFrame, near: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst, w): the minimum spanning tree of points (id, x) over all their distances, from near, their k nearest (i, j, rank, d).

    Boruvka's rounds: each component but the largest takes its nearest edge out, ties by ends, so the points of the largest, soon nearly all, search
    nothing. A point whose list holds another component needs no more; one whose list lies within its own is met with all points, block by block,
    unless the last of its list is already farther than the best edge of its component. Distances are rounded to six places; those of 0 are no edges, so copies hang on other points.
    """
    vectors = saved(points.select("id", "x"))
    lists = saved(near.select("i", "j", "d"))
    last = saved(lists.groupBy(F.col("i").alias("id")).agg(F.max("d").alias("last")))
    label = saved(vectors.select("id", F.col("id").alias("c")))
    tree = None
    while True:
        sizes = label.groupBy("c").count().orderBy(F.desc("count"), "c").limit(2).collect()
        if len(sizes) < 2:
            break
        largest = sizes[0]["c"]
        named = lambda i, c: label.select(F.col("id").alias(i), F.col("c").alias(c))
        out = saved(lists.where("d > 0").join(named("i", "a"), "i").join(named("j", "b"), "j").where("a <> b"))
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        offers = out.select(both.alias("ab"), _edge("d", "i", "j")).select("ab.a", "ab.b", "e").where(F.col("a") != largest)
        best = offers.groupBy("a").agg(F.min("e.w").alias("best"))
        own = out.groupBy(F.col("i").alias("id")).agg(F.min("d").alias("own"))
        within = label.where(F.col("c") != largest).join(last, "id", "left").join(own, "id", "left").join(best, F.col("c") == F.col("a"), "left")
        shut = saved(within.where("(own is null or own = last) and (last is null or best is null or last <= best)").select("id", "c").join(vectors, "id"))
        if not shut.isEmpty():
            offers = offers.union(_nearest_outside(shut, vectors.join(label, "id"), block))
        chosen = saved(offers.groupBy("a").agg(F.min_by(F.struct("b", "e"), "e").alias("m")).select("a", "m.b", "m.e"))
        if chosen.isEmpty():
            break
        new = chosen.select("e.src", "e.dst", "e.w").distinct()
        tree = new if tree is None else tree.union(new)
        label = followed_labels(label, chosen)
    return tree if tree is not None else lists.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("w")).limit(0)


def sparse_graph(points: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(src, dst, w), src < dst: the minimum spanning tree of points (id, x) over all distances, with the pairs that are among each other's k nearest.

    Where all points are equal, every distance counts as LEAST. Null ids or vectors take no part; no or one point gives no rows.
    """
    points = saved(points.where("id is not null and x is not null").select("id", "x"))
    lists = saved(nearest(points, max(k, LISTED), block))
    near = lists.where(F.col("rank") <= k)
    tree = saved(spanning_tree_of_points(points, lists, block))
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    mutual = near.where("i < j").join(back, ["i", "j"], "left_semi").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("w"))
    if tree.isEmpty():
        first = points.agg(F.min("id").alias("src"))
        star = points.join(F.broadcast(first), F.col("id") != F.col("src")).select("src", F.col("id").alias("dst"))
        return star.union(mutual.select("src", "dst")).distinct().withColumn("w", F.lit(LEAST))
    return tree.union(mutual.where("w > 0")).groupBy("src", "dst").agg(F.min("w").alias("w"))


def pair_contexts(points: DataFrame, pairs: DataFrame, k: int = 5, n_paths: int = 2, neighbours: int = 2, block: int = BLOCK) -> DataFrame:
    """(pair, id, on_path): what a generator between two points learns from.

    For each of pairs (pair, source, target): the points of up to n_paths edge-disjoint shortest paths in the sparse graph, and, for one
    path point after another by id, its nearest neighbours that aren't in the context yet. A pair's path points and their
    lists are one row meanwhile, whose size is that of its paths and not of the corpus. Pairs without a path have no rows.
    """
    on_path = saved(disjoint_paths_between(sparse_graph(points, k, block), pairs, n_paths).select("pair", "id").distinct())
    longest = on_path.groupBy("pair").count().agg(F.max("count")).first()[0]
    if not longest or not neighbours:
        return on_path.withColumn("on_path", F.lit(True))
    asked = points.join(on_path.select("id").distinct(), "id", "left_semi")
    near = nearest(asked, longest * (neighbours + 1), block, points)
    lists = near.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("near")).select("id", F.col("near.j").alias("near"))
    rows = on_path.join(lists, "id").groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("id", "near"))).alias("rows"))
    ids = F.col("rows.id")
    grown = F.aggregate("rows", ids, lambda seen, r: F.concat(seen, F.slice(F.array_except(r["near"], seen), 1, neighbours)))
    return rows.select("pair", ids.alias("path"), F.explode(grown).alias("id")).select("pair", "id", F.array_contains("path", F.col("id")).alias("on_path"))
