"""Statistics of corpora: histograms, edge probabilities with back-off, allocation, quality scores, learning curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..sources.corpora import saved
from .ranking import numbered_in

SMOOTH = 1.0  # added to the edges and to the non-edges of a class of node pairs
BLOCK, BINS = 4, 4


def sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))


def size_histogram(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    return sizes(nodes).join(targets, "graph_id").groupBy("target", "n_nodes").agg(F.count("*").alias("n"))


def label_histogram(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    counted = nodes.join(targets, "graph_id").groupBy("target", "label").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.round(F.col("n") / F.sum("n").over(W.partitionBy("target")), 6))


def density(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, n_graphs, density): the mean of 2m / (n (n - 1)) over graphs of two nodes or more."""
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    each = sizes(nodes).where("n_nodes > 1").join(m, "graph_id", "left").join(targets, "graph_id")
    return each.groupBy("target").agg(F.count("*").alias("n_graphs"), F.round(F.avg(2.0 * F.coalesce("m", F.lit(0)) / (F.col("n_nodes") * (F.col("n_nodes") - 1))), 6).alias("density"))


def edge_marginals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n, p): ordered pairs of nodes by edge label, 'none' where there is no edge."""
    pairs = sizes(nodes).agg(F.sum(F.col("n_nodes") * (F.col("n_nodes") - 1)).alias("pairs"))
    counted = edges.groupBy("label").agg((2 * F.count("*")).alias("n"))
    none = pairs.join(F.broadcast(counted.agg(F.sum("n").alias("m"))), F.lit(True)).select(F.lit("none").alias("label"), (F.col("pairs") - F.col("m")).alias("n"))
    every = counted.union(none)
    return every.withColumn("p", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def node_marginals(nodes: DataFrame) -> DataFrame:
    """(label, p): the share of each node label."""
    return nodes.groupBy("label").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy())).select("label", "p")


def group_targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("target").agg(F.count("*").alias("n"), F.min("graph_id").alias("first_graph_id"))


def image_groups(hashes: DataFrame, least: int = 5) -> DataFrame:
    """(hash, n, first_graph_id, enough): graphs by hash, from (graph_id, hash)."""
    return hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min("graph_id").alias("first_graph_id")).withColumn("enough", F.col("n") >= least)


def allocated(weights: DataFrame, total: int) -> DataFrame:
    """(key, n): total in proportion to weight (key, weight); what is left goes to the largest remainders, ties by key."""
    whole = W.partitionBy()
    share = weights.withColumn("share", F.lit(float(total)) * F.col("weight") / F.sum("weight").over(whole))
    floor = share.withColumn("base", F.floor("share")).withColumn("left", F.lit(total) - F.sum("base").over(whole))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), "key"))
    return floor.withColumn("rank", rank).select("key", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("n"))


def node_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kind, bin, lu, lv, has_edge): each node with those before it, by descending degree; 'within' or 'between' blocks."""
    degree = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("deg"))
    order = F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc(F.coalesce("deg", F.lit(0))), "node_id")) - 1
    placed = nodes.join(degree, ["graph_id", "node_id"], "left").withColumn("pos", order).withColumn("size", F.count("*").over(W.partitionBy("graph_id")))
    a = placed.select("graph_id", F.col("node_id").alias("u"), F.col("pos").alias("pu"), F.col("label").alias("la"), "size")
    b = placed.select("graph_id", F.col("node_id").alias("v"), F.col("pos").alias("pv"), F.col("label").alias("lb"))
    start = F.floor(F.col("pu") / BLOCK) * BLOCK
    pairs = a.join(b, "graph_id").where("pv < pu")
    linked = edges.select("graph_id", F.col("src").alias("lo"), F.col("dst").alias("hi")).distinct().withColumn("there", F.lit(True))
    out = pairs.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v")).join(linked, ["graph_id", "lo", "hi"], "left")
    return out.select(
        "graph_id", F.when(F.col("pv") >= start, "within").otherwise("between").alias("kind"), F.least(F.floor(start / F.col("size") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
        F.least("la", "lb").alias("lu"), F.greatest("la", "lb").alias("lv"), F.coalesce("there", F.lit(False)).alias("has_edge"),
    )


def edge_statistics(pairs: DataFrame) -> DataFrame:
    """(kind, ratio_bin, lu, lv, level, edges, total, p) at four levels of back-off; null where a level leaves a column out."""
    kind, ratio_bin, lu, lv = keys = [F.col("kind"), F.col("bin"), F.col("lu"), F.col("lv")]
    edges = F.count_if("has_edge")
    counted = pairs.groupingSets([keys, [kind, lu, lv], [kind, ratio_bin], [kind]], *keys).agg(F.grouping_id().cast("long").alias("level"), edges.alias("edges"), F.count("*").alias("total"))
    return counted.select("kind", F.col("bin").alias("ratio_bin"), "lu", "lv", "level", "edges", "total", F.round((F.col("edges") + SMOOTH) / (F.col("total") + 2 * SMOOTH), 6).alias("p"))


def edge_probabilities(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (kind, ratio_bin, lu, lv) with p from the first level that has counted such pairs."""
    stats = saved(edge_statistics(pairs))  # counted once for the four levels
    out = asked
    for level, keys in ((0, ["kind", "ratio_bin", "lu", "lv"]), (4, ["kind", "lu", "lv"]), (3, ["kind", "ratio_bin"]), (7, ["kind"])):
        out = out.join(stats.where(F.col("level") == level).select(*keys, F.col("p").alias(f"p{level}")), keys, "left")
    return out.select("kind", "ratio_bin", "lu", "lv", F.coalesce("p0", "p4", "p3", "p7").alias("p"))


def quantile_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, std) from quartiles: the mean of the three, and their range over 1.34898; 0 for a single value."""
    q = [F.percentile(value, p).alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75), 1)]
    return df.groupBy(by).agg(F.count(value).alias("n"), *q).select(by, "n", F.round((F.col("q1") + F.col("q2") + F.col("q3")) / 3, 6).alias("mean"), F.round(F.when(F.col("n") > 1, (F.col("q3") - F.col("q1")) / 1.34898).otherwise(0.0), 6).alias("std"))


def trimmed_statistics(df: DataFrame, by: str, value: str, key: str, trim: int = 1) -> DataFrame:
    """(by, n, mean, std) without the trim smallest and largest values; the population's deviation. key names a row of its group."""
    def ends(*order) -> DataFrame:  # few rows of a group leave each task
        return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= trim).select(by, key)

    gone = ends(value, key).union(ends(F.desc(value), F.desc(key))).distinct()
    kept = df.join(gone, [by, key], "left_anti")
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def equalised(targets: DataFrame, seed: str = "7") -> DataFrame:
    """(target, graph_id, copy): each class repeated up to the size of the largest, in seeded order."""
    sizes_ = targets.groupBy("target").agg(F.count("*").alias("size"))
    most = sizes_.agg(F.max("size").alias("most"))
    placed = numbered_in(targets.select("target", "graph_id"), "target", F.md5(F.concat_ws("|", F.lit(seed), F.col("graph_id").cast("string"))), "graph_id").join(sizes_.join(F.broadcast(most), F.lit(True)), "target")
    times = F.ceil((F.col("most") - F.col("pos") + 1) / F.col("size")).cast("int")
    return placed.select("target", "graph_id", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("copy"))


def bootstrapped(targets: DataFrame, seed: str = "35") -> DataFrame:
    """(target, graph_id, times): each class drawn as often as it has members, with replacement; graphs that weren't drawn are left out.

    The n-th draw of a class takes the member at a uniform place; places come from ranges of the order, so no task holds a class.
    """
    placed = saved(numbered_in(targets.select("target", "graph_id"), "target", "graph_id"))
    size = placed.groupBy("target").agg(F.count("*").alias("size"))
    u = uniform(F.concat_ws("|", F.lit(seed), F.col("target").cast("string"), F.col("pos").cast("string")))
    drawn = placed.join(size, "target").select("target", (F.floor(u * F.col("size")) + 1).cast("int").alias("pos"))
    return drawn.groupBy("target", "pos").agg(F.count("*").alias("times")).join(placed, ["target", "pos"]).select("target", "graph_id", "times")


def resampled(targets: DataFrame, size: int, spare: int = 3, seed: str = "36") -> DataFrame:
    """(target, graph_id): size members of each class without replacement, in seeded order; a class with fewer than spare more than that stays whole."""
    placed = saved(numbered_in(targets.select("target", "graph_id"), "target", F.md5(F.concat_ws("|", F.lit(seed), F.col("graph_id").cast("string"))), "graph_id"))
    counts = placed.groupBy("target").agg(F.count("*").alias("n"))
    return placed.join(counts, "target").where((F.col("n") - size < spare) | (F.col("pos") <= size)).select("target", "graph_id")


def propagated(df: DataFrame) -> DataFrame:
    """df (key, m1, s1, m2, s2) as deviations of the ratio, product, sum, difference and average of two independent normal variables."""
    m1, s1, m2, s2 = (F.col(c) for c in ("m1", "s1", "m2", "s2"))
    ratio = F.sqrt((s1 / m2) ** 2 + (m1 * s2 / (m2 * m2)) ** 2)
    product = F.sqrt((m1 * s2) ** 2 + (m2 * s1) ** 2 + (s1 * s2) ** 2)
    plus = F.sqrt(s1**2 + s2**2)
    return df.select("key", *(F.round(x, 6).alias(n) for n, x in (("ratio", ratio), ("product", product), ("total", plus), ("difference", plus), ("average", plus / 2))))


def quality_scores(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(key, quality, utility, exchangeability, creativity) of each resample (key, real, gen, both, accuracy, similarity), clipped to [0, 1]."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    quality = F.when(F.col("real") == 0, 0.0).otherwise(clip(F.col("gen") / F.col("real")))
    utility = clip(F.greatest(F.col("both") - F.col("real"), F.lit(eps)) / F.greatest(F.col("gen") - F.col("real"), F.lit(eps)))
    alike = (1 - F.col("accuracy") + F.col("similarity")) / 2
    good = (quality + utility) / 2
    return df.select("key", *(F.round(x, 6).alias(n) for n, x in (("quality", quality), ("utility", utility), ("exchangeability", clip(good * alike)), ("creativity", clip(good / (1 + alike))))))


def dominance_ranks(models: DataFrame, draws: int = 64, scale: float = 0.1) -> DataFrame:
    """(model, wins): over draws, how often a model is at least as good as another in both objectives (model, m1, s1, m2, s2)."""
    normal = lambda tag, m, s: m + scale * s * F.sqrt(-2 * F.log(uniform(F.concat_ws("|", F.lit(tag), "model", F.col("draw").cast("string"))))) * F.cos(2 * 3.141592653589793 * uniform(F.concat_ws("|", F.lit(tag + "b"), "model", F.col("draw").cast("string"))))
    drawn = models.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("model", "draw", normal("x", F.col("m1"), F.col("s1")).alias("x"), normal("y", F.col("m2"), F.col("s2")).alias("y"))
    other = drawn.select("draw", F.col("model").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return drawn.join(other, "draw").where("model <> other and x >= ox and y >= oy").groupBy("model").agg(F.count("*").alias("wins"))


def power_law(points: DataFrame) -> DataFrame:
    """(key, alpha, a, b): the least-squares curve a + b n^-alpha through points (key, n, y), over a grid of 171 alphas."""
    x = F.col("n").cast("double") ** -F.col("alpha")
    grid = points.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(170)), lambda i: F.lit(0.3) + i * F.lit(0.01))))
    s = grid.withColumn("x", x).groupBy("key", "alpha").agg(F.count("*").alias("k"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    b = (F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = s.withColumn("b", b).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("k"))
    sse = fit.withColumn("sse", F.col("syy") - F.col("a") * F.col("sy") - F.col("b") * F.col("sxy"))
    best = sse.groupBy("key").agg(F.min_by(F.struct("alpha", "a", "b"), F.struct(F.round("sse", 9), "alpha")).alias("f"))
    return best.select("key", F.round("f.alpha", 2).alias("alpha"), F.round("f.a", 4).alias("a"), F.round("f.b", 4).alias("b"))


def equivalent_sizes(points: DataFrame, fits: DataFrame, floor: float = 1e-3) -> DataFrame:
    """(key, n, r): by how much, relative to n, more or less real data than n would reach the value y; points (key, n, y), fits (key, alpha, a, b).

    The curve a + b n^-alpha is inverted at y; the distance from a is at least floor times the largest of |a|, |b| and 1.
    """
    y, a, b = F.col("y"), F.col("a"), F.col("b")
    distance = F.greatest(F.when(b < 0, a - y).otherwise(y - a), F.lit(0.0), floor * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    needed = F.pow(F.abs(b) / distance, 1 / F.greatest("alpha", F.lit(1e-8)))
    return points.join(fits, "key").select("key", "n", ((needed - F.col("n")) / F.greatest(F.col("n").cast("double"), F.lit(1e-8))).alias("r"))


def gain_weights(points: DataFrame, fits: DataFrame, power: float = 1.0, dropped: float = 0.25) -> DataFrame:
    """(key, n, w): weights by what doubling n gains on the fitted curve, to a power; gains up to their quantile dropped weigh nothing. Each key's add up to 1, or to 0."""
    curve = lambda n: F.col("a") + F.col("b") * F.pow(n, -F.col("alpha"))
    gains = points.join(fits, "key").select("key", "n", F.abs(curve(2.0 * F.col("n")) - curve(F.col("n").cast("double"))).alias("gain"))
    least = gains.groupBy("key").agg(F.percentile("gain", dropped).alias("least"))
    kept = gains.join(least, "key").select("key", "n", F.when(F.col("gain") > F.col("least"), F.pow("gain", F.lit(power))).otherwise(0.0).alias("g"))
    sums = kept.groupBy("key").agg(F.sum("g").alias("all"))
    return kept.join(sums, "key").select("key", "n", F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0).alias("w"))


def equivalent_data_size(points: DataFrame, fits: DataFrame) -> DataFrame:
    """(key, eds): the sum of equivalent_sizes weighted by gain_weights."""
    both = equivalent_sizes(points, fits).join(gain_weights(points, fits), ["key", "n"])
    return both.groupBy("key").agg(F.round(F.sum(F.col("w") * F.col("r")), 4).alias("eds"))


def degree_penalty(edges: DataFrame) -> DataFrame:
    """(p75, multiplicative, median_w, additive): penalties from the 75th percentile of degrees and the median weight, of edges (src, dst, w)."""
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("deg")).agg(F.percentile("deg", 0.75).alias("p75"))
    return degrees.join(F.broadcast(edges.agg(F.percentile("w", 0.5).alias("median_w"))), F.lit(True)).select("p75", F.round(0.25 / F.col("p75"), 6).alias("multiplicative"), F.round("median_w", 6).alias("median_w"), F.round(0.25 * F.col("median_w") / F.col("p75"), 6).alias("additive"))


def beta_posterior(rewards: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(key, alpha, beta, mean) after rewards (key, r in [0, 1])."""
    out = rewards.groupBy("key").agg((prior[0] + F.sum("r")).alias("alpha"), (prior[1] + F.sum(1 - F.col("r"))).alias("beta"))
    return out.select("key", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6).alias("mean"))


def learned_weights(log: DataFrame, power: float = 1.0) -> DataFrame:
    """(key, accept, usage, failure) from an event log (key, ok): acceptance probability (1 if unseen), and usage and failure weights."""
    ok, bad = F.count(F.when(F.col("ok"), 1)), F.count(F.when(~F.col("ok"), 1))
    return log.groupBy("key").agg(F.round(F.when(ok + bad > 0, ok / (ok + bad)).otherwise(1.0), 6).alias("accept"), F.round(1 / F.pow(1.0 + ok + bad, F.lit(power)), 6).alias("usage"), F.round(1 / F.pow(1.0 + bad, F.lit(power)), 6).alias("failure"))


def path_scores(paths: DataFrame) -> DataFrame:
    """(path, score): minus the mean rank correlation of distance along a path and similarity, from each position both ways.

    paths has (path, pos, other, sim): the similarity of the elements at two positions. Positions whose similarities
    are all equal are skipped; a path without any other has no row.
    """
    way = F.when(F.col("other") > F.col("pos"), "forward").otherwise("backward")
    sided = paths.where("pos <> other").withColumn("way", way).withColumn("gap", F.abs(F.col("pos") - F.col("other")))
    key = ["path", "pos", "way"]
    average = lambda c: F.rank().over(W.partitionBy(*key).orderBy(c)) + (F.count("*").over(W.partitionBy(*key, c)) - 1) / 2
    ranked = sided.withColumn("rg", average("gap")).withColumn("rs", average("sim"))
    each = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.min("rs").alias("low"), F.max("rs").alias("high"), (F.covar_pop("rg", "rs") / F.nullif(F.stddev_pop("rg") * F.stddev_pop("rs"), F.lit(0.0))).alias("c")).where("n > 1 and low < high")
    return each.groupBy("path").agg(F.round(-F.avg("c"), 6).alias("score"))


PAIRS, CELLS = 1 << 26, 1 << 18  # of positions that a task's group compares, and at a time


def rank_correlations(values: np.ndarray, missing: np.ndarray, start: int, stop: int) -> tuple[float, int]:
    """Sum and number of the rank correlations of distance and similarity of values, both ways from each position in start..stop.

    Similarity is minus the difference rounded to six places; equal ones share their mean rank, missing ones come last.
    """
    n, total, count = len(values), 0.0, 0
    at = np.arange(n)
    step = max(1, CELLS // max(1, n))
    for a in range(start, stop, step):
        asked = at[a : min(stop, a + step), None]
        with np.errstate(all="ignore"):
            far = np.abs(values[asked] - values[None])
            places = far * 1e6
            far = np.where(np.isfinite(places), np.where(places < 2.0**52, np.floor(places + 0.5), places) / 1e6, far)
        sim = np.where(missing[asked] | missing[None], 2.0, np.where(np.isnan(far), 1.0, -far))
        for gap in (at[None] - asked, asked - at[None]):
            m = (gap > 0).sum(1)
            key = np.where(gap > 0, sim, np.inf)
            order = np.argsort(key, axis=1)
            key, gap = np.take_along_axis(key, order, 1), np.take_along_axis(gap, order, 1)
            new = np.ones((len(key), n + 1), bool)
            new[:, 1:-1] = key[:, 1:] != key[:, :-1]
            first = np.maximum.accumulate(np.where(new[:, :-1], at, 0), axis=1)
            last = np.minimum.accumulate(np.where(new[:, 1:], at, n)[:, ::-1], axis=1)[:, ::-1]
            mean = ((m + 1) / 2)[:, None]
            rank = np.where(at[None] < m[:, None], (first + last) / 2 + 1 - mean, 0)
            both, of_rank, of_gap = (rank * (gap - mean)).sum(1), (rank * rank).sum(1), m * (m * m - 1.0) / 12
            ok = (m > 1) & (of_rank > 0)
            total, count = total + float((both[ok] / np.sqrt(of_rank[ok] * of_gap[ok])).sum()), count + int(ok.sum())
    return total, count


def value_path_scores(events: DataFrame) -> DataFrame:
    """path_scores of events (path, pos from 1, value), where similarity is minus the difference of values rounded to six places.

    No pair is a row: a path's values go to as many groups as its pairs need, each of which takes its share of positions and holds the values once.
    """
    kind = events.schema["path"].dataType.simpleString()

    def correlated(batches):
        key, held = None, []

        def found():
            path, chunk, size = key
            values, missing = (np.concatenate(x) for x in zip(*held, strict=True))
            total, count = rank_correlations(values, missing, min(len(values), chunk * size), min(len(values), (chunk + 1) * size))
            return pa.RecordBatch.from_arrays([path, pa.array([total]), pa.array([count], pa.int64())], names=["path", "total", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, sizes = (batch.column(c).to_numpy() for c in ("chunk", "size"))
            names = batch.column("path").to_numpy(zero_copy_only=False)
            missing = batch.column("value").is_null().to_numpy(zero_copy_only=False)
            values = batch.column("value").fill_null(0).to_numpy()
            change = np.flatnonzero((names[1:] != names[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            for s, e in zip([0, *change], [*change, batch.num_rows], strict=True):
                at = (batch.column("path").slice(s, 1), int(chunks[s]), int(sizes[s]))
                if key is not None and (at[1] != key[1] or not at[0].equals(key[0])):
                    yield found()
                    held = []
                key = at
                held.append((values[s:e], missing[s:e]))
        if key is not None:
            yield found()

    n = F.count("*").over(W.partitionBy("path"))
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(PAIRS) / F.col("n")))
    rows = events.where("path is not null").select("path", "pos", F.col("value").cast("double").alias("value"), n.alias("n")).withColumn("size", size)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("size"))))
    dealt = rows.select("path", chunk.alias("chunk"), "size", "pos", "value").repartition("path", "chunk").sortWithinPartitions("path", "chunk", "pos")
    each = dealt.select("path", "chunk", "size", "value").mapInArrow(correlated, f"path {kind}, total double, n long")
    return each.groupBy("path").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select("path", F.round(-F.col("total") / F.col("n"), 6).alias("score"))
