"""Rewriting and construction: replacements at a cut, missing and removed edges, training prefixes, repairs, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..sources.checkpoints import resumable
from ..sources.corpora import new_folder, saved, spread
from .cuts import cut_edges, cut_index, edge_contexts, edge_decomposition, pair_hash
from .decompositions import edge_key
from .sampling import seeded


def replacements(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, donor_graph, donor_inode, n_nodes, n_edges): one rewrite of each even graph, or none; the counts are those of the graph before it.

    Its first subgraph with a donor: an odd graph's subgraph of equal signature and another hash, the smallest one. Of a
    signature's donors only the smallest of the first two hashes is held, as one of them differs from any source's.
    """
    index = cut_index(edges).where("cut_key <> ''")
    donors = index.where("graph_id % 2 = 1").groupBy("cut_key", "assoc_hash").agg(F.min(F.struct(F.col("graph_id").alias("donor_graph"), F.col("inode").alias("donor_inode"))).alias("d"))
    first = donors.groupBy("cut_key").agg(F.min(F.struct("d", "assoc_hash")).alias("one"))
    second = donors.join(first, "cut_key").where(F.col("assoc_hash") != F.col("one.assoc_hash")).groupBy("cut_key").agg(F.min("d").alias("two"))
    found = index.where("graph_id % 2 = 0").join(first, "cut_key").join(second, "cut_key", "left").withColumn("pick", F.when(F.col("one.assoc_hash") != F.col("assoc_hash"), F.col("one.d")).otherwise(F.col("two"))).where("pick is not null")
    chosen = found.groupBy("graph_id").agg(F.min_by(F.struct("inode", "pick"), "inode").alias("f")).select("graph_id", "f.inode", "f.pick.donor_graph", "f.pick.donor_inode")
    size = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).cast("long").alias("n_nodes"), F.count("*").alias("n_edges"))
    return chosen.join(size, "graph_id")


def replaced(edges: DataFrame, chosen: DataFrame | None = None, scope: str = "both") -> DataFrame:
    """(graph_id, src, dst, label, lu, lv): the edges of each rewritten graph; chosen has what replacements gives, which is the default.

    The subgraph's two nodes and their edges go; the donor's nodes and edge come in as the nodes n + 1 and n + 2. Each boundary
    edge hangs on the donor's end that has an equal key, keys that repeat in the order of their ends.
    """
    chosen = saved(replacements(edges) if chosen is None else chosen)
    # graphs that are asked for alone, and by graph_id, as edges lie; what is asked of a graph comes along with its edges
    parts = lambda asked: edge_contexts(edges.join(spread(asked), "graph_id"), keep=tuple(c for c in asked.columns if c != "graph_id"), within=edges)
    own = chosen.select("graph_id", F.col("inode").alias("wanted"), "n_nodes", "donor_graph", "donor_inode")
    gone = parts(own).where("inode = wanted").select("graph_id", "u", "v", "cut", "n_nodes", "donor_graph", "donor_inode")
    donors = saved(chosen.groupBy(F.col("donor_graph").alias("graph_id")).agg(F.array_sort(F.collect_set("donor_inode")).alias("wanted")))  # as many as a graph has subgraphs
    donor = parts(donors).where(F.array_contains("wanted", F.col("inode"))).select(F.col("graph_id").alias("donor_graph"), F.col("inode").alias("donor_inode"), F.struct("u", "v", "elabel", "lu", "lv", "cut").alias("d"))
    both = saved(gone.join(spread(donor), ["donor_graph", "donor_inode"]))
    left = edges.join(spread(both.select("graph_id", "u", "v")), "graph_id").where("src <> u and src <> v and dst <> u and dst <> v").select("graph_id", "src", "dst", "label", "lu", "lv")
    new = lambda side: (F.col("n_nodes") + F.when(side, 1).otherwise(2)).cast("int")
    inside = both.select("graph_id", new(F.lit(True)).alias("src"), new(F.lit(False)).alias("dst"), F.col("d.elabel").alias("label"), F.col("d.lu").alias("lu"), F.col("d.lv").alias("lv"))
    key = lambda c: edge_key(scope, c["elabel"], F.element_at(F.split(c["ekey"], r"\|"), -2), F.substring_index(c["ekey"], "|", -1))
    keys = lambda cut: F.array_sort(F.transform(cut, lambda c: F.struct(key(c).alias("key"), c["ekey"].alias("ekey"), c["inner"].alias("inner"), c["outer"].alias("outer"), c["elabel"].alias("elabel"))))
    pairs = both.select("graph_id", "n_nodes", "d", F.explode(F.arrays_zip(keys("cut").alias("s"), keys("d.cut").alias("t"))).alias("p"))
    inner_label = F.when(F.col("p.t.inner") == F.col("d.u"), F.col("d.lu")).otherwise(F.col("d.lv"))
    hung = pairs.select("graph_id", F.col("p.s.outer").alias("src"), new(F.col("p.t.inner") == F.col("d.u")).alias("dst"), F.col("p.s.elabel").alias("label"), F.substring_index("p.s.ekey", "|", -1).alias("lu"), inner_label.alias("lv"))
    return left.union(inside).union(hung)


def pruned(edges: DataFrame, least: int = 3, seed: str = "11") -> DataFrame:
    """(graph_id, inode, n_left): one pruning step, the first subgraph in seeded order whose removal leaves least nodes."""
    parts = edge_decomposition(edges).withColumn("n", F.max("v").over(W.partitionBy("graph_id")))
    order = F.row_number().over(W.partitionBy("graph_id").orderBy(F.md5(seeded(seed, "graph_id", "inode")), "inode"))
    return parts.where(F.col("n") - 2 >= least).withColumn("o", order).where("o = 1").select("graph_id", "inode", (F.col("n") - 2).cast("long").alias("n_left"))


def missing_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): unordered pairs of nodes without an edge. The nodes of a large graph are spread before they are paired."""
    size = nodes.groupBy("graph_id").agg(F.max("node_id").alias("n"))
    first = size.select("graph_id", "n", F.explode(F.sequence(F.lit(1), "n")).alias("src")).where("src < n").repartition("graph_id", "src")
    pairs = first.select("graph_id", "src", F.explode(F.sequence(F.col("src") + 1, "n")).alias("dst"))
    return pairs.join(edges.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")


def removal_order(edges: DataFrame, seed: str = "12") -> DataFrame:
    """edges with rank: the seeded order in which a graph's edges go, from 1, and m, their number."""
    by = W.partitionBy("graph_id")
    order = by.orderBy(F.md5(seeded(seed, "graph_id", "src", "dst", "label")), "src", "dst", "label")
    return edges.select("graph_id", "src", "dst", "label", F.row_number().over(order).alias("rank"), F.count("*").over(by).alias("m"))


def removed_edges(edges: DataFrame, size: float) -> DataFrame:
    """The edges that stay when round(size * m), half to even, or for size >= 1 int(size), go in seeded order."""
    n = F.bround(F.lit(float(size)) * F.col("m")) if size < 1 else F.lit(int(size))
    return removal_order(edges).where(F.col("rank") > n).select("graph_id", "src", "dst", "label")


def edge_neighbours(nodes: DataFrame, edges: DataFrame, seed: str = "13") -> DataFrame:
    """(graph_id, src, dst, new_src, new_dst): one edge of each graph moved to a free pair of nodes, both first in seeded order."""
    taken = edges.groupBy("graph_id").agg(F.min_by(F.struct("src", "dst"), F.md5(seeded(seed, "graph_id", "src", "dst", "label"))).alias("e"))
    free = missing_edges(nodes, edges).groupBy("graph_id").agg(F.min_by(F.struct("src", "dst"), F.md5(seeded(seed, "graph_id", "src", "dst"))).alias("f"))
    return taken.join(free, "graph_id").select("graph_id", "e.src", "e.dst", F.col("f.src").alias("new_src"), F.col("f.dst").alias("new_dst"))


def edge_dataset(edges: DataFrame) -> DataFrame:
    """(graph_id, step, n_edges, label): the prefixes left when edges go one at a time; all are positive (label 1)."""
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    return m.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias("step"), "m").select("graph_id", "step", (F.col("m") - F.col("step")).alias("n_edges"), F.lit(1).alias("label"))


def edge_prefixes(edges: DataFrame) -> DataFrame:
    """(graph_id, step, src, dst, label): what is left of each graph after each step, when its edges go one at a time in seeded order."""
    order = removal_order(edges)
    return order.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("rank") - 1)).alias("step"), "src", "dst", "label")


def edge_negatives(nodes: DataFrame, edges: DataFrame, seed: str = "22") -> DataFrame:
    """(graph_id, step, src, dst, new_src, new_dst): for each graph of edge_prefixes one in which an edge is moved to a free pair of nodes, both first in seeded order.

    Free are the pairs without an edge in the graph, and those whose edges have gone by that step. The rows met on the way are a graph's
    edges times its pairs of nodes.
    """
    key = lambda *c: F.md5(F.concat_ws("|", F.lit(seed), *(F.col(x).cast("string") for x in ("graph_id", "step", *c))))
    moved = edge_prefixes(edges).groupBy("graph_id", "step").agg(F.min_by(F.struct("src", "dst"), F.struct(key("src", "dst", "label"), "label")).alias("e"))
    steps = edges.groupBy("graph_id").agg(F.count("*").cast("int").alias("m"))
    never = missing_edges(nodes, edges).join(steps, "graph_id").select("graph_id", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("step"), "src", "dst")
    gone = removal_order(edges).groupBy("graph_id", "src", "dst").agg(F.max("rank").alias("rank"), F.max("m").cast("int").alias("m")).where("rank < m").select("graph_id", F.explode(F.sequence("rank", F.col("m") - 1)).alias("step"), "src", "dst")
    free = never.union(gone).groupBy("graph_id", "step").agg(F.min_by(F.struct("src", "dst"), key("src", "dst")).alias("f"))
    return moved.join(free, ["graph_id", "step"]).select("graph_id", "step", "e.src", "e.dst", F.col("f.src").alias("new_src"), F.col("f.dst").alias("new_dst"))


def beam_step(nodes: DataFrame, edges: DataFrame, width: int = 3) -> DataFrame:
    """(graph_id, src, dst, score, rank): the width best single-edge extensions of each graph; score: edges between nodes of these labels per pair, over the corpus."""
    frequency = edges.groupBy(F.least("lu", "lv").alias("la"), F.greatest("lu", "lv").alias("lb")).agg(F.count("*").alias("score"))
    left, right = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("l1")), nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("l2"))
    options = missing_edges(nodes, edges).join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"]).withColumn("la", F.least("l1", "l2")).withColumn("lb", F.greatest("l1", "l2"))
    scored = options.join(frequency, ["la", "lb"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("score"), "src", "dst"))).where(F.col("rank") <= width).select("graph_id", "src", "dst", "score", "rank")


def grown(nodes: DataFrame, edges: DataFrame, steps: int = 3, path: str | None = None) -> DataFrame:
    """(graph_id, step, src, dst, score): each graph grown by its best missing edge, step by step; what is added counts for the scores after it.

    A checkpoint is written after each step to path; a run of the same graphs and settings that was cut off goes on from there.
    """
    spark = nodes.sparkSession
    sign = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("graph_id", "src", "dst", "label"), F.lit(1 << 31)))).first()
    labels = nodes.select("graph_id", "node_id", "label")
    none = spark.createDataFrame([], "graph_id long, step int, src int, dst int, score long")

    def step(k: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        added = tables["added"]
        ends = added.select("graph_id", "src", "dst").join(labels.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("lu")), ["graph_id", "src"]).join(labels.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("lv")), ["graph_id", "dst"])
        now = edges.select("graph_id", "src", "dst", "lu", "lv").unionByName(ends)
        best = beam_step(nodes, now, 1).select("graph_id", F.lit(k).alias("step"), "src", "dst", "score")
        return {"added": added.select(none.columns).union(best)}

    return resumable(spark, path or new_folder(spark), f"grown|{steps}|{sign[0]}|{sign[1]}", lambda: {"added": none}, step, steps)["added"]


def edge_blame(edges: DataFrame, k: int = 2) -> DataFrame:
    """(graph_id, src, dst, n_sets, blame, rank): the k edges most to blame where triangles are violations: in most of them, then most recent.

    A triangle is two 'seq' edges and the 'flag' edge over them; each blames its edges by a third.
    """
    seq, flag = edges.where("label = 'seq'"), edges.where("label = 'flag'").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("c"))
    tri = flag.join(seq.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["graph_id", "a"]).join(seq.select("graph_id", F.col("src").alias("b"), F.col("dst").alias("c")), ["graph_id", "b", "c"])
    each = tri.select("graph_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")))).alias("e"))
    counted = each.groupBy("graph_id", "e.src", "e.dst").agg(F.count("*").alias("n_sets")).withColumn("blame", F.round(F.col("n_sets") / 3.0, 6))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n_sets"), F.desc("blame"), F.desc("dst"), F.desc("src")))).where(F.col("rank") <= k)


def unified(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, label): each graph with its last node contracted into its first; existing edges stay, loops go."""
    last = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).alias("last")).where("last > 1")
    moved = edges.join(last, "graph_id")
    to = lambda c: F.when(F.col(c) == F.col("last"), 1).otherwise(F.col(c))
    new = moved.select("graph_id", to("src").alias("a"), to("dst").alias("b"), "label", ((F.col("src") == F.col("last")) | (F.col("dst") == F.col("last"))).cast("int").alias("moved"))
    kept = new.where("a <> b").select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "label", "moved")
    return kept.groupBy("graph_id", "src", "dst").agg(F.min_by("label", F.struct("moved", "label")).alias("label"))


def state_keys(edges: DataFrame) -> DataFrame:
    """(graph_id, state_key): md5 of the sorted edge list."""
    return edges.groupBy("graph_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", F.lpad(F.col("src").cast("string"), 4, "0"), F.lpad(F.col("dst").cast("string"), 4, "0"), "label"))), ";")).alias("state_key"))


def association_map(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, inodes): the subgraphs that hold each node."""
    each = edge_decomposition(edges).select("graph_id", "inode", F.explode(F.array("u", "v")).alias("node_id"))
    return each.groupBy("graph_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("inode")), lambda i: i.cast("string")), "|").alias("inodes"))


def target_signatures(edges: DataFrame) -> DataFrame:
    """(signature, n): graphs by the sorted hashes of their subgraphs."""
    each = pair_hash(edge_decomposition(edges)).groupBy("graph_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("assoc_hash")), ",")).alias("signature"))
    return each.groupBy("signature").agg(F.count("*").alias("n"))


def seed_nodes(components: DataFrame) -> DataFrame:
    """(graph_id, inode): where a search starts, the subgraph from the rarest (img_type, deg) bucket."""
    rare = components.groupBy("img_type", "deg").agg(F.count("*").alias("n"))
    return components.join(rare, ["img_type", "deg"]).groupBy("graph_id").agg(F.min_by("inode", F.struct("n", "inode")).alias("inode"))


def gran_sample(sizes: DataFrame, p: float, seed: str = "14") -> DataFrame:
    """(graph_id, src, dst): Bernoulli edges with probability p between the nodes 1..n of each graph (graph_id, n_nodes), by seeded uniforms."""
    pairs = sizes.select("graph_id", F.col("n_nodes").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.col("n_nodes").cast("int"))).alias("src")).where("src < n").select("graph_id", "src", F.explode(F.sequence(F.col("src") + 1, "n")).alias("dst"))
    u = (F.conv(F.substring(F.md5(seeded(seed, "graph_id", "src", "dst")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return pairs.where(u < p)


def resume_signature(hashes: DataFrame, parameters: str) -> DataFrame:
    """(signature, n): what a resumed run must agree in: its parameters and the source hashes, as counts by hash."""
    each = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    folded = each.agg(F.md5(F.concat_ws("|", F.lit(parameters), F.sum(F.conv(F.substring(digest("hash", F.col("n").cast("string")), 1, 8), 16, 10).cast("long")).cast("string"))).alias("signature"), F.sum("n").alias("n"))
    return folded


def boundary_size(edges: DataFrame) -> DataFrame:
    """(graph_id, n_boundary): all boundary edges of a graph's subgraphs."""
    return cut_edges(edges).groupBy("graph_id").agg(F.count("*").alias("n_boundary"))
