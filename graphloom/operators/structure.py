"""Structural node features: degree, clustering and betweenness, and their scaler."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, by_size, packed
from ..sources.corpora import both_ways, saved

GRAPHS = 256  # packed graphs whose matrices a task holds at once
_COUNTS = "graph_id long, node_id int, n long, deg long, triangles double, through double"


def through_counts(a: np.ndarray) -> np.ndarray:
    """For adjacency matrices (graphs, n, n): by node, the shares of shortest paths between ordered pairs of other nodes that pass it.

    Brandes' sums for all roots at once: path counts forward by distance, then dependencies backward.
    """
    n = a.shape[1]
    paths = np.broadcast_to(np.eye(n), a.shape).copy()
    dist, reached, level = np.where(paths > 0, 0, -1), paths, 0
    while reached.any():
        level += 1
        reached = np.where(dist < 0, reached @ a, 0)
        dist[reached > 0] = level
        paths += reached
    passed = np.zeros(a.shape)
    for d in range(level, 1, -1):
        share = np.where(dist == d, (1 + passed) / np.maximum(paths, 1), 0)
        passed += np.where(dist == d - 1, paths * (share @ a), 0)
    return passed.sum(1)


def _packed_counts(batches):
    for batch in batches:
        for part in (batch.slice(k, GRAPHS) for k in range(0, batch.num_rows, GRAPHS)):
            n = np.array([len(x) for x in part.column("ids")])
            ids, start = part.column("ids").flatten().to_numpy(), np.cumsum(n) - n
            cells = [c.values.to_numpy() for c in part.column("cells")]
            deg, triangles, through = np.zeros((3, len(ids)))
            for size in np.unique(n):
                chosen = np.flatnonzero(n == size)
                a = np.zeros((len(chosen), size * size))
                a[np.repeat(np.arange(len(chosen)), [len(cells[g]) for g in chosen]), np.concatenate([cells[g] for g in chosen])] = 1
                a = a.reshape(-1, size, size)
                at = start[chosen][:, None] + np.arange(size)
                deg[at], triangles[at], through[at] = a.sum(2), np.einsum("gij,gji->gi", a @ a, a) / 2, through_counts(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("graph_id").to_numpy(), n)), pa.array(ids, pa.int32()), pa.array(np.repeat(n, n), pa.int64()), pa.array(deg.astype(np.int64)), pa.array(triangles), pa.array(through)], names=["graph_id", "node_id", "n", "deg", "triangles", "through"])


def _joined_through(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(graph_id, node_id, through) by joins, a level of distance at a time; for graphs of any size, spread by graph and root."""
    key = ["graph_id", "root", "node_id"]
    steps = ways.select("graph_id", F.col("src").alias("node_id"), "dst")
    levels = [saved(nodes.select("graph_id", F.col("node_id").alias("root"), "node_id", F.lit(1.0).alias("paths")))]
    seen = levels[0].select(*key)
    while True:
        reached = levels[-1].join(steps, ["graph_id", "node_id"]).groupBy("graph_id", "root", F.col("dst").alias("node_id")).agg(F.sum("paths").alias("paths"))
        level = saved(reached.join(seen, key, "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select(*key))
    done, passed = None, levels[-1].withColumn("passed", F.lit(0.0))
    for before in levels[-2:0:-1]:
        back = passed.join(steps, ["graph_id", "node_id"]).groupBy("graph_id", "root", F.col("dst").alias("node_id")).agg(F.sum((1 + F.col("passed")) / F.col("paths")).alias("share"))
        done = passed if done is None else done.union(passed)
        passed = saved(before.join(back, key, "left").withColumn("passed", F.col("paths") * F.coalesce("share", F.lit(0.0))).select(*key, "paths", "passed"))
    done = passed if done is None else done.union(passed)
    return done.where("root <> node_id").groupBy("graph_id", "node_id").agg(F.sum("passed").alias("through"))


def _joined_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The columns of _COUNTS by joins. Triangles are found from their end of lowest degree, so a hub opens no square of wedges."""
    ways = saved(both_ways(edges).where("src <> dst").select("graph_id", "src", "dst").distinct())
    degree = saved(ways.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("deg")))
    end = lambda name: degree.select("graph_id", F.col("node_id").alias(name), F.struct("deg", "node_id").alias(f"{name}_at"))
    up = saved(ways.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).where("src_at < dst_at").select("graph_id", "src", "dst", "dst_at"))
    first, second = (up.select("graph_id", "src", F.col("dst").alias(x), F.col("dst_at").alias(f"{x}_at")) for x in "ab")
    wedges = first.join(second, ["graph_id", "src"]).where("a_at < b_at")
    found = wedges.join(up.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["graph_id", "a", "b"])
    triangles = found.select("graph_id", F.explode(F.array("src", "a", "b")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").cast("double").alias("triangles"))
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    out = nodes.select("graph_id", "node_id").join(size, "graph_id")
    for part in (degree, triangles, _joined_through(nodes, ways)):
        out = out.join(part, ["graph_id", "node_id"], "left")
    return out.na.fill(0, ["deg", "triangles", "through"]).select("graph_id", "node_id", "n", "deg", "triangles", "through")


def node_features(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph_id, node_id, degree, clustering, betweenness) of simple undirected graphs: parallel edges count once, loops not at all.

    degree over n - 1; closed over possible triangles; shares of shortest paths over the ordered pairs of other nodes, 0 for
    fewer than three nodes. Graphs of at most small nodes and edges are one row each after a single shuffle; larger ones go by joins.
    """
    large = by_size(nodes, edges, small)
    part = lambda df, how: df if large is None else df.join(large, "graph_id", how)
    each = packed(part(nodes, "left_anti"), part(edges, "left_anti")).withColumn("ids", F.array_sort(F.transform("members", lambda m: m["node_id"])))
    at = lambda x: F.array_position("ids", x) - 1
    inside = F.filter("ways", lambda w: (w["src"] != w["dst"]) & F.array_contains("ids", w["src"]) & F.array_contains("ids", w["dst"]))
    counts = each.select(F.col("graph_id").cast("long").alias("graph_id"), "ids", F.transform(inside, lambda w: at(w["src"]) * F.size("ids") + at(w["dst"])).alias("cells")).mapInArrow(_packed_counts, _COUNTS)
    if large is not None:
        counts = counts.union(_joined_counts(part(nodes, "left_semi"), part(edges, "left_semi")))
    share = lambda when, top, base: F.when(when, top / base).otherwise(0.0)
    n, deg = F.col("n"), F.col("deg")
    return counts.select("graph_id", "node_id", share(n > 1, deg, n - 1).alias("degree"), share(deg > 1, 2 * F.col("triangles"), deg * (deg - 1)).alias("clustering"), share(n > 2, F.col("through"), (n - 1) * (n - 2)).alias("betweenness"))


def scaler(features: DataFrame, columns: list[str], least: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over all rows; deviations under least count as 1."""
    row = features.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= least else 1.0) for c in columns}


def scaled(features: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    """features with the columns of a scaler standardised."""
    return features.withColumns({c: (F.col(c) - m) / s for c, (m, s) in by.items()})


STRUCTURAL = ["degree", "clustering", "betweenness"]


def rounded(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.round(c, 6) for c in STRUCTURAL if c in features.columns})


def scaled_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_features, standardised over all nodes."""
    features = saved(node_features(nodes, edges))
    return rounded(scaled(features, scaler(features, STRUCTURAL)))
