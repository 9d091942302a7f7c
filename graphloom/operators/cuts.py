"""Boundaries of subgraphs: cut edges, their keys and signatures, and the index of subgraphs by signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, bucket, by_size, digest, packed, sorted_text, wl_hash, wl_rounds
from ..sources.corpora import both_ways, saved, spread
from .ranking import numbered_in


def edge_decomposition(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, u, v, elabel, lu, lv): one subgraph per edge, numbered in the order of its ends."""
    rank = F.row_number().over(W.partitionBy("graph_id").orderBy("src", "dst", "label"))
    return edges.select("graph_id", rank.alias("inode"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("label").alias("elabel"), "lu", "lv")


def membership(parts: DataFrame) -> DataFrame:
    return parts.select("graph_id", "inode", F.explode(F.array("u", "v")).alias("node_id"))


def _joined_contexts(edges: DataFrame, hashed: bool = False) -> DataFrame:
    """edge_contexts by joins, for graphs of any size."""
    parts = edge_decomposition(edges)
    parts = saved(pair_hash(parts).drop("hu", "hv") if hashed else parts)
    own = ["assoc_hash"] if hashed else []
    ends = parts.select("graph_id", "inode", "u", "v", *own, F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("lu").alias("l")), F.struct(F.col("v").alias("n"), F.col("lv").alias("l")))).alias("end")).select("graph_id", "inode", "u", "v", *own, F.col("end.n").alias("inner"), F.col("end.l").alias("type"))
    ways = both_ways(edges).withColumnsRenamed({"src": "inner", "dst": "outer"})
    cut = ends.join(ways, ["graph_id", "inner"]).where("outer <> u and outer <> v").groupBy("graph_id", "inode").agg(F.collect_list(F.struct("inner", "outer", F.col("label").alias("elabel"), F.concat_ws("|", "label", "lu", "lv").alias("ekey"))).alias("cut"))
    met = ends.select("graph_id", "inode", "inner", "type").join(ends.select("graph_id", F.col("inode").alias("j"), "inner", *own), ["graph_id", "inner"]).where("inode <> j")
    near = met.groupBy("graph_id", "inode", "j", *own).agg(F.collect_list("type").alias("types")).groupBy("graph_id", "inode").agg(F.collect_list(F.struct("j", "types", *own)).alias("near"))
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    both = parts.join(cut, ["graph_id", "inode"], "left").join(near, ["graph_id", "inode"], "left")
    return both.select(*parts.columns, empty("cut", cut.schema["cut"].dataType.simpleString()), empty("near", near.schema["near"].dataType.simpleString()))


def edge_contexts(edges: DataFrame, small: int = SMALL, hashed: bool = False, keep: tuple[str, ...] = (), within: DataFrame | None = None) -> DataFrame:
    """The subgraphs of edge_decomposition with cut, their boundary edges from inside to outside (inner, outer, elabel, ekey),
    and near, the other subgraphs that share nodes with them (j, types: the labels of these nodes). If hashed, both hold pair_hash's assoc_hash.

    Graphs of at most small edges are one row each meanwhile, after a single shuffle by graph_id; larger ones go by joins. Columns of edges in keep,
    which have one value in a graph, are kept. within may give all edges, where these are part of them that costs more to read.
    """
    large = None if within is not None and by_size(within.limit(0), within, small) is None else by_size(edges.limit(0), edges, small)
    few = edges if large is None else edges.join(large, "graph_id", "left_anti")
    few = few.withColumn("elabel", F.col("label"))
    few, own = (pair_hash(few), ["assoc_hash"]) if hashed else (few, [])
    graphs = few.groupBy("graph_id", *keep).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), "elabel", "lu", "lv", *own))).alias("es"))
    graphs = graphs.withColumn("es", F.transform("es", lambda w, k: F.struct(*(w[c].alias(c) for c in ("u", "v", "elabel", "lu", "lv", *own)), (k + 1).alias("j"))))  # once a graph
    each = graphs.select("graph_id", *keep, "es", F.explode("es").alias("e")).select("graph_id", *keep, "es", F.col("e.j").alias("inode"), "e.*")
    in_part = lambda n: (n == F.col("u")) | (n == F.col("v"))
    way = lambda w, a, b, la, lb: F.struct(w[a].alias("inner"), w[b].alias("outer"), w["elabel"].alias("elabel"), F.concat_ws("|", w["elabel"], w[la], w[lb]).alias("ekey"))
    out = lambda w, a, b, la, lb: F.when(in_part(w[a]) & ~in_part(w[b]), F.array(way(w, a, b, la, lb))).otherwise(F.array())
    cut = F.flatten(F.transform("es", lambda w: F.concat(out(w, "u", "v", "lu", "lv"), out(w, "v", "u", "lv", "lu"))))
    has = lambda w, n: (w["u"] == F.col(n)) | (w["v"] == F.col(n))
    types = lambda w: F.concat(F.when(has(w, "u"), F.array("lu")).otherwise(F.array()), F.when(has(w, "v") & (F.col("u") != F.col("v")), F.array("lv")).otherwise(F.array()))
    near = F.transform(F.filter("es", lambda w: (w["j"] != F.col("inode")) & (has(w, "u") | has(w, "v"))), lambda w: F.struct(w["j"].alias("j"), types(w).alias("types"), *(w[c].alias(c) for c in own)))
    found = each.select("graph_id", "inode", "u", "v", "elabel", "lu", "lv", *own, cut.alias("cut"), near.alias("near"), *keep)
    if large is None:
        return found
    rest = edges.join(large, "graph_id", "left_semi")
    joined = _joined_contexts(rest, hashed)
    if keep:
        joined = joined.join(spread(rest.select("graph_id", *keep).distinct()), "graph_id")
    return found.union(joined.select(found.columns))


def cut_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, inner, outer, elabel, ekey): edges with one end inside, from inside to outside."""
    return edge_contexts(edges).select("graph_id", "inode", F.explode("cut").alias("c")).select("graph_id", "inode", "c.*")


def edge_keys(edges: DataFrame) -> DataFrame:
    """The key of each boundary edge by scope: none, the edge label, the inner or outer end, and both."""
    return both_ways(edges).groupBy("label", "lu", "lv").agg(F.count("*").alias("n")).select(F.col("label").alias("key_label"), F.concat_ws("|", "label", "lu").alias("key_inner"), F.concat_ws("|", "label", "lv").alias("key_outer"), F.concat_ws("|", "label", "lu", "lv").alias("key_both"), "n")


def pair_hash(parts: DataFrame) -> DataFrame:
    """parts with hu, hv (the WL hashes of both ends after three rounds) and assoc_hash: of two nodes and an edge."""
    hu, hv = F.col("lu"), F.col("lv")
    for _ in range(3):
        hu, hv = digest(hu, F.concat_ws(":", "elabel", hv)), digest(hv, F.concat_ws(":", "elabel", hu))
    return parts.withColumn("hu", hu).withColumn("hv", hv).withColumn("assoc_hash", F.md5(F.concat_ws(",", F.least("hu", "hv"), F.greatest("hu", "hv"))))


_listed = lambda c, sep: F.array_join(F.array_sort(c), sep)


def cut_signature(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, cut_size, cut_key): the sorted keys of a subgraph's boundary; '' where it has none."""
    return edge_contexts(edges).select("graph_id", "inode", F.size("cut").cast("long").alias("cut_size"), _listed(F.transform("cut", lambda c: c["ekey"]), ";").alias("cut_key"))


def _indexed(parts: DataFrame, *also: Column) -> DataFrame:
    """The entries of cut_index for subgraphs of edge_contexts, with columns of these."""
    parts = pair_hash(parts)
    role = lambda c: F.when(c["inner"] == F.col("u"), F.col("hu")).otherwise(F.col("hv"))
    maps = F.md5(_listed(F.transform("cut", lambda c: F.concat_ws("@", c["ekey"], role(c))), ";"))
    return parts.select("graph_id", "inode", *also, _listed(F.transform("cut", lambda c: c["ekey"]), ";").alias("cut_key"), "assoc_hash", maps.alias("edge_map_sig"))


def cut_index(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, cut_key, assoc_hash, edge_map_sig) of every subgraph; edge_map_sig says which end each key hangs on."""
    return _indexed(edge_contexts(edges))


def deduplicated(index: DataFrame) -> DataFrame:
    """(cut_key, assoc_hash, edge_map_sig, freq): equal entries once; a missing, non-finite or non-positive frequency counts as 1."""
    given = F.col("freq").cast("double") if "freq" in index.columns else F.lit(1.0)
    weight = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)
    return index.groupBy("cut_key", "assoc_hash", "edge_map_sig").agg(F.sum(weight).cast("long").alias("freq"))


BLOCK = 4096  # contexts of one key that are folded at a time


def contexts(nodes: DataFrame, edges: DataFrame, radius: int = 2, bits: int = 3) -> DataFrame:
    """(graph_id, inode, context): by edge, how many nodes within radius steps outside it, and how many of its ends, have a label of each bucket."""
    parts = edge_decomposition(edges)
    members = membership(parts)
    around = members.join(spread(balls(nodes, edges, radius).select("graph_id", F.col("root").alias("node_id"), F.col("node_id").alias("outer"))), ["graph_id", "node_id"]).select("graph_id", "inode", F.col("outer").alias("node_id")).distinct()
    side = lambda df, inner: df.join(spread(nodes), ["graph_id", "node_id"]).select("graph_id", "inode", (bucket(F.col("label"), bits) + (inner << bits)).alias("b"))
    counted = side(around.join(spread(members), ["graph_id", "inode", "node_id"], "left_anti"), 0).union(side(members, 1)).groupBy("graph_id", "inode", "b").agg(F.count("*").cast("double").alias("n"))
    at = counted.groupBy("graph_id", "inode").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("at"))  # as many as buckets
    return at.select("graph_id", "inode", F.transform(F.sequence(F.lit(0).cast("long"), F.lit((2 << bits) - 1).cast("long")), lambda b: F.coalesce(F.col("at")[b], F.lit(0.0))).alias("context"))


def indexed_contexts(nodes: DataFrame, edges: DataFrame, radius: int = 2, bits: int = 3, small: int = SMALL) -> DataFrame:
    """cut_index's columns and context, that of contexts; labels are those that the edges hold.

    Graphs of at most small nodes and edges are one row each meanwhile, so that nothing is shuffled but by graph_id; larger ones go by joins.
    """
    large = by_size(nodes, edges, small)
    part = lambda df, how: df if large is None else df.join(large, "graph_id", how)
    few = part(edges, "left_anti")
    labelled = few.withColumns({c: bucket(F.col(c), bits).cast("int") for c in ("lu", "lv")})
    ways = both_ways(labelled).groupBy("graph_id", "src").agg(F.collect_set(F.struct(F.col("dst").alias("n"), F.col("lv").alias("b"))).alias("near"))
    near = ways.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "near"))).alias("near"))
    end = lambda n, label: F.struct(F.col(n).alias("n"), bucket(F.col(label), bits).cast("int").alias("b"))
    each = _indexed(edge_contexts(few, small), F.array(end("u", "lu"), end("v", "lv")).alias("ends")).join(spread(near), "graph_id")
    each = each.withColumn("ball", F.col("ends")).withColumn("new", F.col("ends"))
    for _ in range(radius):
        each = each.withColumn("new", F.array_except(F.flatten(F.transform("new", lambda x: F.col("near")[x["n"]])), "ball")).withColumn("ball", F.concat("ball", "new"))
    counts = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda b: F.size(F.filter(c, lambda x: x["b"] == b)).cast("double"))
    each = each.withColumn("outside", F.slice("ball", F.lit(3), F.size("ball")))
    found = each.select("graph_id", "inode", "cut_key", "assoc_hash", "edge_map_sig", F.concat(counts("outside"), counts("ends")).alias("context"))
    if large is None:
        return found
    n, e = part(nodes, "left_semi"), part(edges, "left_semi")
    return found.union(cut_index(e).join(spread(contexts(n, e, radius, bits)), ["graph_id", "inode"]).select(found.columns))


def distinct_contexts(index: DataFrame, found: DataFrame, epsilon: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """distinct_variants of index, which has cut_index's columns, and found (graph_id, inode, context)."""
    return distinct_variants(index.join(spread(found), ["graph_id", "inode"]), epsilon, block)


def _far(a: Column, b: Column, epsilon: float) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)) > epsilon


def _folded(listed: Column, epsilon: float) -> Column:
    """What is left of a list of structs with context, when those go that are close to one before that stays."""
    return F.aggregate(listed, F.slice(listed, 1, 0), lambda have, x: F.when(F.forall(have, lambda y: _far(x["context"], y["context"], epsilon)), F.concat(have, F.array(x))).otherwise(have))


def _folded_in_blocks(rows: DataFrame, epsilon: float, block: int) -> DataFrame:
    """(entry, variant, context) for entries of any number of contexts: so many at a time are compared with those kept, spread over tasks, and only what is left is folded in one."""
    placed = saved(numbered_in(rows, "entry", "first", first=0, many=True).withColumn("block", F.floor(F.col("pos") / block)))
    kept = None
    for b in range(1 + (placed.agg(F.max("block")).first()[0] or 0)):
        new = placed.where(F.col("block") == b).select("entry", "pos", "context")
        if kept is not None:
            close = new.join(spread(kept.select("entry", F.col("context").alias("other"))), "entry").where(~_far(F.col("context"), F.col("other"), epsilon)).select("entry", "pos").distinct()
            new = new.join(spread(close), ["entry", "pos"], "left_anti")
        listed = new.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", "context"))).alias("all"))  # at most block
        folded = saved(listed.select("entry", F.explode(_folded(F.col("all"), epsilon)).alias("k")).select("entry", "k.pos", "k.context"))
        kept = folded if kept is None else saved(kept.union(folded))
    return numbered_in(kept, "entry", "pos", name="variant", many=True).select("entry", "variant", "context")


def distinct_variants(index: DataFrame, epsilon: float = 1e-6, block: int = BLOCK, entries_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(cut_key, assoc_hash, edge_map_sig, freq, variant, context): equal entries once, with the contexts that are epsilon-distinct.

    index has cut_index's columns and context. The contexts of an entry come in the order of their first subgraph;
    one is kept if its distance to all kept before is above epsilon. Equal contexts are one from the start. An entry goes by the digest
    of its columns, which are looked up in its first subgraph at the end, in entries_of(graphs): index's rows of some graphs (graph_id), where
    these cost less than filtering it. Entries of more than block contexts are folded a block at a time.
    """
    key = ["cut_key", "assoc_hash", "edge_map_sig"]
    entry = F.unhex(digest(*key)).alias("entry")
    each = index.select("graph_id", "inode", entry, "context")
    rows = saved(each.groupBy("entry", "context").agg(F.min(F.struct("graph_id", "inode")).alias("first"), F.count("*").alias("n")))
    entries = saved(rows.groupBy("entry").agg(F.min("first").alias("first"), F.sum("n").alias("freq"), F.count("*").alias("contexts")))
    large = entries.where(F.col("contexts") > block).select("entry")
    some = not large.isEmpty()
    few = rows.join(spread(large), "entry", "left_anti") if some else rows
    listed = few.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("first", "context"))).alias("all"))  # at most block
    kept = saved(listed.select("entry", F.posexplode(_folded(F.col("all"), epsilon)).alias("pos", "k")).select("entry", (F.col("pos") + 1).alias("variant"), "k.context"))
    if some:
        kept = kept.union(_folded_in_blocks(rows.join(spread(large), "entry", "left_semi").select("entry", "first", "context"), epsilon, block))
    named = entries.select("first.graph_id", "first.inode", "entry", "freq")
    graphs = named.select("graph_id").distinct()
    first = entries_of(saved(graphs)) if entries_of else index
    named = first.select("graph_id", "inode", *key).join(spread(named), ["graph_id", "inode"]).select("entry", *key, "freq")
    return spread(kept).join(spread(named), "entry").select(*key, "freq", "variant", "context")


def variants(nodes: DataFrame, edges: DataFrame, epsilon: float) -> DataFrame:
    """distinct_variants of the subgraphs of edges and their contexts."""
    return distinct_variants(indexed_contexts(nodes, edges), epsilon, entries_of=lambda graphs: cut_index(edges.join(spread(graphs), "graph_id", "left_semi")))


def merged(*indexes: DataFrame) -> DataFrame:
    """The deduplicated union of indexes."""
    out = indexes[0]
    for x in indexes[1:]:
        out = out.unionByName(x)
    return deduplicated(out)


def cut_sizes(edges: DataFrame) -> DataFrame:
    return cut_signature(edges).groupBy("cut_size").agg(F.count("*").alias("freq"))


def _joined_balls(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """balls by joins, for graphs of any size."""
    ways = both_ways(edges).select("graph_id", F.col("src").alias("node_id"), "dst")
    frontier = nodes.select("graph_id", F.col("node_id").alias("root"), "node_id", F.lit(0).alias("dist"))
    seen = frontier
    for step in range(1, radius + 1):
        frontier = frontier.join(spread(ways), ["graph_id", "node_id"]).select("graph_id", "root", F.col("dst").alias("node_id"), F.lit(step).alias("dist")).distinct()
        seen = seen.union(frontier)
    return seen.groupBy("graph_id", "root", "node_id").agg(F.min("dist").alias("dist"))


def balls(nodes: DataFrame, edges: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """(graph_id, root, node_id, dist): nodes within radius steps of each root, by their shortest distance.

    Graphs of at most small nodes and edges are one row each meanwhile; larger ones go by joins.
    """
    large = by_size(nodes, edges, small)
    part = lambda df, how: df if large is None else df.join(large, "graph_id", how)
    ways = both_ways(part(edges, "left_anti")).groupBy("graph_id", "src").agg(F.collect_set("dst").alias("near"))
    graphs = ways.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "near"))).alias("near"))
    roots = part(nodes, "left_anti").select("graph_id", F.col("node_id").alias("root")).distinct()
    each = roots.join(spread(graphs), "graph_id", "left").select("graph_id", "root", "near", F.array("root").alias("new"), F.array("root").alias("ball"), F.array(F.struct(F.col("root").alias("node_id"), F.lit(0).alias("dist"))).alias("found"))
    for step in range(1, radius + 1):
        each = each.withColumn("new", F.array_except(F.flatten(F.transform("new", lambda n: F.coalesce(F.col("near")[n], F.slice("ball", 1, 0)))), "ball"))
        each = each.withColumn("found", F.concat("found", F.transform("new", lambda n: F.struct(n.alias("node_id"), F.lit(step).alias("dist"))))).withColumn("ball", F.concat("ball", "new"))  # noqa: B023
    out = each.select("graph_id", "root", F.explode("found").alias("f")).select("graph_id", "root", "f.node_id", "f.dist")
    return out if large is None else out.union(_joined_balls(part(nodes, "left_semi"), part(edges, "left_semi"), radius))


def _joined_radius_hash(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """radius_hash by joins, for graphs of any size."""
    ball = saved(_joined_balls(nodes, edges, radius))
    labelled = ball.join(nodes, ["graph_id", "node_id"]).select("graph_id", "root", "node_id", "label")
    inside = saved(ball.select("graph_id", "root", F.col("node_id").alias("src")).join(both_ways(edges).select("graph_id", "src", "dst", "label"), ["graph_id", "src"]).join(ball.select("graph_id", "root", F.col("node_id").alias("dst")), ["graph_id", "root", "dst"]))
    return wl_hash(labelled, inside, ["graph_id", "root"], 2).withColumnRenamed("root", "node_id")


def radius_hash(nodes: DataFrame, edges: DataFrame, radius: int = 1, small: int = SMALL) -> DataFrame:
    """(graph_id, node_id, hash): the hash of the subgraph within radius steps of each node.

    Graphs of at most small nodes and edges are one row each meanwhile, after a single shuffle by graph_id; larger ones go by joins.
    """
    large = by_size(nodes, edges, small)
    part = lambda df, how: df if large is None else df.join(large, "graph_id", how)
    each = packed(part(nodes, "left_anti"), part(edges, "left_anti"))
    each = each.select("graph_id", "members", "ways", F.explode("members").alias("root")).select("graph_id", F.col("root.node_id").alias("root"), "members", "ways").withColumn("ball", F.array("root"))
    for _ in range(radius):
        each = each.withColumn("ball", F.array_union("ball", F.transform(F.filter("ways", lambda w: F.array_contains("ball", w["src"])), lambda w: w["dst"])))
    inside = each.select("graph_id", "root", F.filter("members", lambda x: F.array_contains("ball", x["node_id"])).alias("members"), F.filter("ways", lambda w: F.array_contains("ball", w["src"]) & F.array_contains("ball", w["dst"])).alias("ways"))
    found = wl_rounds(inside, 2).select("graph_id", F.col("root").alias("node_id"), "hash")
    return found if large is None else found.union(_joined_radius_hash(part(nodes, "left_semi"), part(edges, "left_semi"), radius).select(found.columns))


def anchor_types(nodes: DataFrame, edges: DataFrame, bits: int = 10) -> DataFrame:
    return radius_hash(nodes, edges).select("graph_id", "node_id", bucket(F.col("hash"), bits).alias("bucket"))


def virtual_cut(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, cut_size, cut_key) from the labels of distinct outer nodes; each counts through its lowest inner end."""
    first = F.row_number().over(W.partitionBy("graph_id", "inode", "outer").orderBy("inner", "elabel"))
    outer = cut_edges(edges).withColumn("first", first).where("first = 1")
    return outer.groupBy("graph_id", "inode").agg(F.count("*").alias("cut_size"), sorted_text(F.substring_index("ekey", "|", -1), ";").alias("cut_key"))


def shared_nodes(edges: DataFrame) -> DataFrame:
    """(graph_id, i, j, shared): subgraphs that have nodes in common."""
    return edge_contexts(edges).select("graph_id", F.col("inode").alias("i"), F.explode("near").alias("x")).select("graph_id", "i", "x.j", F.size("x.types").cast("long").alias("shared"))


def overlap_signatures(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(signature, n): how many subgraphs have the same sorted list of (neighbour's hash, nodes in common)."""
    each = edge_contexts(edges.where("graph_id is not null"), small, hashed=True).where(F.size("near") > 0)
    told = F.transform("near", lambda x: F.concat_ws(":", x["assoc_hash"], F.size(x["types"]).cast("long").cast("string")))
    return each.select(F.md5(_listed(told, ";")).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))
