"""Subgraphs of any kind as a table of members: decompositions, their boundaries and index, and pruning sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, by_size, sorted_text, wl_nodes, wl_rounds
from ..sources.corpora import both_ways, saved, spread
from .cuts import balls, edge_decomposition, membership
from .paths import component_labels
from .sampling import seeded

_PART = ["graph_id", "inode"]
SCOPES = ("none", "label", "inner", "outer", "both")


def by_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, inode, node_id): a subgraph for each edge."""
    return membership(edge_decomposition(edges))


def by_neighbourhood(nodes: DataFrame, edges: DataFrame, radius: int = 1) -> DataFrame:
    """(graph_id, inode, node_id): a subgraph for each node, of the nodes within radius steps; numbered as its node."""
    return balls(nodes, edges, radius).select("graph_id", F.col("root").alias("inode"), "node_id")


def by_triangle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, inode, node_id): a subgraph for each cycle of three nodes, numbered in the order of its nodes."""
    ways = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    wedges = ways.join(ways.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c")), ["graph_id", "b"])
    found = wedges.join(ways.select("graph_id", "a", F.col("b").alias("c")), ["graph_id", "a", "c"])
    numbered = found.withColumn("inode", F.row_number().over(W.partitionBy("graph_id").orderBy("a", "b", "c")))
    return numbered.select("graph_id", "inode", F.explode(F.array("a", "b", "c")).alias("node_id"))


def by_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, inode, node_id): the connected components over edges, each numbered as its smallest node."""
    return component_labels(nodes, edges).select("graph_id", F.col("component").alias("inode"), "node_id")


def edge_key(scope: str, label: Column, inner: Column, outer: Column) -> Column:
    """What a boundary edge is known by: nothing, its label, its label with its inner or its outer end, or with both."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    return {"none": F.lit(""), "label": F.coalesce(label, F.lit("")), "inner": F.concat_ws("|", label, inner), "outer": F.concat_ws("|", label, outer), "both": F.concat_ws("|", label, inner, outer)}[scope]


def boundary(members: DataFrame, edges: DataFrame, scope: str = "both") -> DataFrame:
    """(graph_id, inode, inner, outer, ekey): edges from a member to a node outside, by an anti-join with the members."""
    out = members.join(both_ways(edges).withColumnRenamed("src", "node_id"), ["graph_id", "node_id"]).withColumnRenamed("node_id", "inner").withColumnRenamed("dst", "outer")
    left = out.join(members.withColumnRenamed("node_id", "outer"), [*_PART, "outer"], "left_anti")
    return left.select(*_PART, "inner", "outer", edge_key(scope, F.col("label"), F.col("lu"), F.col("lv")).alias("ekey"))


def _joined_index(members: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str = "both") -> DataFrame:
    """index by joins, for graphs of any size: all is keyed by subgraph and node."""
    members = saved(members)
    ways = both_ways(edges).select("graph_id", "src", "dst", "label")
    inside = saved(members.withColumnRenamed("node_id", "src").join(ways, ["graph_id", "src"]).join(members.withColumnRenamed("node_id", "dst"), [*_PART, "dst"], "left_semi"))
    roles = saved(wl_nodes(members.join(nodes, ["graph_id", "node_id"]), inside, _PART))
    hashes = roles.groupBy(*_PART).agg(F.md5(sorted_text(F.col("h"))).alias("assoc_hash"))
    hung = boundary(members, edges, scope).join(roles.select(*_PART, F.col("node_id").alias("inner"), "h"), [*_PART, "inner"])
    cut = hung.groupBy(*_PART).agg(sorted_text(F.col("ekey"), ";").alias("cut_key"), F.md5(sorted_text(F.concat_ws("@", "ekey", "h"), ";")).alias("edge_map_sig"))
    out = hashes.join(cut, _PART, "left")
    return out.select(*_PART, F.coalesce("cut_key", F.lit("")).alias("cut_key"), "assoc_hash", F.coalesce("edge_map_sig", F.md5(F.lit(""))).alias("edge_map_sig"))


def _packed_index(members: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """index for small graphs: each subgraph is a row with its graph meanwhile, and nothing but the members is dealt by graph_id."""
    labels = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", F.col("label").alias("h"))).alias("members"))
    way = lambda a, b, la, lb: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "label", F.col(la).alias("lu"), F.col(lb).alias("lv"))
    both = edges.groupBy("graph_id").agg(F.flatten(F.collect_list(F.array(way("src", "dst", "lu", "lv"), way("dst", "src", "lv", "lu")))).alias("all"))
    parts = members.groupBy(*_PART).agg(F.collect_list("node_id").alias("own"))
    each = parts.join(spread(labels), "graph_id").join(spread(both), "graph_id", "left")
    within = lambda x: F.array_contains("own", x)
    none = F.from_json(F.lit("[]"), both.schema["all"].dataType)  # a graph without edges
    ways = F.filter(F.coalesce("all", none), lambda w: within(w["src"]))
    each = each.select(*_PART, "own", F.filter("members", lambda m: within(m["node_id"])).alias("members"), ways.alias("out")).where(F.size("members") > 0)
    for ways in (None, F.filter("out", lambda w: within(w["dst"]))):  # exploded, so that no filter is taken again for each member and round
        each = each if ways is None else each.withColumn("ways", ways)
        each = each.select(*_PART, F.explode(F.array(F.struct(*each.columns[2:]))).alias("one")).select(*_PART, "one.*")
    hashed = wl_rounds(each, 3)
    hashed = hashed.withColumn("at", F.map_from_entries(F.transform("members", lambda m: F.struct(m["node_id"], m["h"]))))
    cut = F.filter("out", lambda w: ~within(w["dst"]) & F.map_contains_key("at", w["src"]))
    key = lambda w: edge_key(scope, w["label"], w["lu"], w["lv"])
    listed = lambda values: F.array_join(F.array_sort(values), ";")
    found = hashed.withColumn("cut", cut)
    return found.select(*_PART, listed(F.transform("cut", key)).alias("cut_key"), F.col("hash").alias("assoc_hash"), F.md5(listed(F.transform("cut", lambda w: F.concat_ws("@", key(w), F.col("at")[w["src"]])))).alias("edge_map_sig"))


def index(members: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str = "both", small: int = SMALL) -> DataFrame:
    """(graph_id, inode, cut_key, assoc_hash, edge_map_sig) of every subgraph in members (graph_id, inode, node_id; no repeats).

    cut_key: the sorted keys of its boundary. assoc_hash: the hash of what is inside. edge_map_sig: which kind of member each key hangs on.
    Subgraphs may overlap and be of any size. Those of graphs of at most small nodes and edges are one row each meanwhile, larger ones go by joins.
    """
    large = by_size(nodes, edges, small)
    if large is None:
        return _packed_index(members, nodes, edges, scope)
    members = saved(members)
    part = lambda how: (df.join(large, "graph_id", how) for df in (members, nodes, edges))
    return _packed_index(*part("left_anti"), scope).union(_joined_index(*part("left_semi"), scope))


def _order(edges: DataFrame, seed: str) -> DataFrame:
    """edges (graph_id, o, u, v) with o, which orders the subgraphs of a graph by seed, by hash and then by ends."""
    key = F.md5(seeded(seed, "graph_id", "src", "dst", "label"))
    return edges.where("src <> dst").select("graph_id", F.struct(key.alias("h"), F.col("src").alias("u"), F.col("dst").alias("v"), "label").alias("o"), F.col("src").alias("u"), F.col("dst").alias("v"))


def _folded(order: DataFrame) -> DataFrame:
    """(graph_id, o, u, v): the subgraphs that go, for small graphs: a fold over each graph's subgraphs in order."""
    listed = order.groupBy("graph_id").agg(F.array_sort(F.collect_list("o")).alias("os"))
    free = lambda used, o: ~F.array_contains(used, o["u"]) & ~F.array_contains(used, o["v"])
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.slice("os", 1, 0).alias("gone"))
    step = lambda s, o: F.when(free(s["used"], o), F.struct(F.concat(s["used"], F.array(o["u"], o["v"])).alias("used"), F.concat(s["gone"], F.array(o)).alias("gone"))).otherwise(s)
    gone = listed.select("graph_id", F.explode(F.aggregate("os", start, step)["gone"]).alias("o"))
    return gone.select("graph_id", "o", "o.u", "o.v")


def _in_rounds(order: DataFrame) -> DataFrame:
    """What _folded gives, for graphs of any size: the subgraphs that come first at all their nodes go at once, until none is left.

    A subgraph goes in the fold exactly if none before it that shares a node goes, so the rounds, about logarithmic in number, give the same.
    """
    left, gone = saved(order), None
    while not left.isEmpty():
        ends = left.select("graph_id", "o", F.explode(F.array("u", "v")).alias("node_id"))
        first = ends.groupBy("graph_id", "node_id").agg(F.min("o").alias("o"))
        new = saved(first.groupBy("graph_id", "o").agg(F.count("*").alias("n")).where("n = 2").select("graph_id", "o", "o.u", "o.v"))
        gone = new if gone is None else gone.union(new)
        used = new.select("graph_id", F.explode(F.array("u", "v")).alias("x"))
        for end in ("u", "v"):
            left = left.join(used.withColumnRenamed("x", end), ["graph_id", end], "left_anti")
        left = saved(left.select("graph_id", "o", "u", "v"))
    return gone if gone is not None else order.limit(0)


def pruning_sequences(nodes: DataFrame, edges: DataFrame, least: int = 3, seed: str = "34", small: int = SMALL) -> DataFrame:
    """(graph_id, step, u, v, n_left, cut_size, cut_key): each graph pruned to the end, an edge's two nodes a step, with the virtual cut it leaves.

    A step takes the first edge in seeded order whose nodes are both still there, as long as least nodes stay. The cut's key is the sorted labels
    of the remaining nodes that were linked to the two. Small graphs are folded in one row each, larger ones go by rounds of joins.
    """
    large = by_size(nodes, edges, small)
    order = _order(edges, seed)
    gone = _folded(order if large is None else order.join(large, "graph_id", "left_anti"))
    if large is not None:
        gone = gone.unionByName(_in_rounds(order.join(large, "graph_id", "left_semi")))
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    step = F.row_number().over(W.partitionBy("graph_id").orderBy("o"))
    steps = saved(gone.select("graph_id", step.alias("step"), "u", "v").join(size, "graph_id").withColumn("n_left", F.col("n") - 2 * F.col("step")).where(F.col("n_left") >= least).drop("n"))
    at = steps.select("graph_id", F.explode(F.array("u", "v")).alias("node_id"), F.col("step").alias("until"))
    ends = steps.select("graph_id", "step", "u", "v", F.explode(F.array("u", "v")).alias("src"))
    met = ends.join(both_ways(edges).select("graph_id", "src", F.col("dst").alias("node_id"), F.col("lv").alias("label")), ["graph_id", "src"]).where("node_id <> u and node_id <> v")
    still = met.select("graph_id", "step", "node_id", "label").distinct().join(at, ["graph_id", "node_id"], "left").where("until is null or until > step")
    cut = still.groupBy("graph_id", "step").agg(F.count("*").alias("cut_size"), sorted_text(F.col("label"), ";").alias("cut_key"))
    return steps.join(cut, ["graph_id", "step"], "left").select("graph_id", "step", "u", "v", "n_left", F.coalesce("cut_size", F.lit(0)).alias("cut_size"), F.coalesce("cut_key", F.lit("")).alias("cut_key"))
