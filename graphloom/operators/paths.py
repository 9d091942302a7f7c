"""Structure and paths: components, spanning trees, shortest paths, traversal orders, node features."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, by_size, packed
from ..sources.corpora import both_ways, saved


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): the smallest node that can be reached.

    Labels spread to neighbours, then each node takes the label of the node that its label names, until none changes.
    """
    ways = both_ways(edges).select("graph_id", F.col("src").alias("node_id"), "dst").distinct()
    state = nodes.select("graph_id", "node_id", F.col("node_id").alias("component"))
    while True:
        offers = ways.join(state.select("graph_id", F.col("node_id").alias("dst"), F.col("component").alias("offer")), ["graph_id", "dst"]).groupBy("graph_id", "node_id").agg(F.min("offer").alias("offer"))
        joined = saved(state.join(offers, ["graph_id", "node_id"], "left").withColumn("new", F.least("component", F.coalesce("offer", "component"))))
        state = joined.select("graph_id", "node_id", F.col("new").alias("component"))
        if joined.where("new < component").isEmpty():
            return state
        named = state.select("graph_id", F.col("node_id").alias("component"), F.col("component").alias("next"))
        state = saved(state.join(named, ["graph_id", "component"]).select("graph_id", "node_id", F.col("next").alias("component")))


def largest_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_components, largest, n_nodes): the largest component of each graph, ties to the smallest node."""
    each = component_labels(nodes, edges).groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    return each.groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.max("n").alias("n_nodes"))


def _joined_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hops by joins, for graphs of any size."""
    ways = both_ways(edges).select("graph_id", F.col("src").alias("node_id"), "dst").distinct()
    degree = nodes.join(ways.groupBy("graph_id", "node_id").agg(F.count("*").alias("deg")), ["graph_id", "node_id"], "left")
    start = degree.groupBy("graph_id").agg(F.min_by("node_id", F.struct(-F.coalesce("deg", F.lit(0)), F.col("node_id"))).alias("node_id"))
    seen = saved(start.withColumn("level", F.lit(0)))
    frontier = seen
    for level in count(1):
        frontier = saved(frontier.join(ways, ["graph_id", "node_id"]).select("graph_id", F.col("dst").alias("node_id")).distinct().join(seen, ["graph_id", "node_id"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return nodes.select("graph_id", "node_id").join(seen, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("level", F.lit(-1)).alias("level"))


def _packed_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hops of small graphs: a queue folded over each graph's row."""
    graphs = packed(nodes, edges).withColumn("ids", F.transform("members", lambda m: m["node_id"])).withColumn("ways", F.array_distinct(F.transform("ways", lambda w: F.struct(w["src"].alias("src"), w["dst"].alias("dst")))))
    around = lambda n: F.transform(F.filter("ways", lambda w: w["src"] == n), lambda w: w["dst"])
    start = F.array_min(F.transform("ids", lambda n: F.struct((-F.size(around(n))).alias("deg"), n.alias("n"))))["n"]
    entry = lambda n, level: F.struct(n.alias("n"), level.cast("int").alias("level"))

    def step(queue, i):
        head = F.get(queue, i)
        new = F.array_except(around(head["n"]), F.transform(queue, lambda x: x["n"]))
        return F.when(F.size(queue) <= i, queue).otherwise(F.concat(queue, F.transform(new, lambda n: entry(n, head["level"] + 1))))

    rounds = F.sequence(F.lit(0), F.size(F.array_distinct(F.transform("ways", lambda w: w["src"]))))
    kind = nodes.schema["node_id"].dataType.simpleString()
    graphs = graphs.withColumn("start", F.array(entry(start, F.lit(0))).cast(f"array<struct<n:{kind},level:int>>"))
    graphs = graphs.withColumn("level", F.map_from_entries(F.aggregate(rounds, F.col("start"), step)))
    return graphs.select("graph_id", F.explode("ids").alias("node_id"), "level").select("graph_id", "node_id", F.coalesce(F.col("level")[F.col("node_id")], F.lit(-1)).alias("level"))


def hops(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph_id, node_id, level): breadth-first depth from each graph's node of largest degree, ties to the smallest; -1 if out of reach.

    Graphs of at most small nodes and edges are one row each meanwhile; larger ones go by joins, a level at a time.
    """
    large = by_size(nodes, edges, small)
    if large is None:
        return _packed_hops(nodes, edges)
    part = lambda df, how: df.join(large, "graph_id", how)
    return _packed_hops(part(nodes, "left_anti"), part(edges, "left_anti")).union(_joined_hops(part(nodes, "left_semi"), part(edges, "left_semi")))


def shortest_distances(edges: DataFrame, source: int) -> DataFrame:
    """(id, dist) from a source over undirected edges (src, dst, w); weights that aren't positive and finite are left out."""
    usable = edges.where((F.col("w") > 0) & (F.col("w") < float("inf")))
    ways = saved(usable.select("src", "dst", "w").union(usable.select("dst", "src", "w")))
    state = saved(ways.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0.0).alias("dist")))
    while True:
        offers = state.join(ways, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        following = saved(state.union(offers).groupBy("id").agg(F.min("dist").alias("dist")))
        changed = following.join(state.withColumnRenamed("dist", "old"), "id", "left").where("old is null or dist < old - 1e-12")
        done, state = changed.isEmpty(), following
        if done:
            return state


def shortest_path(edges: DataFrame, source: int, target: int) -> list[int]:
    """The nodes of a shortest path from source to target, ties to smaller nodes; [] if there is none. One small query for each of its nodes."""
    dist = shortest_distances(edges, source)
    usable = edges.where((F.col("w") > 0) & (F.col("w") < float("inf")))
    ways = usable.select(F.col("src").alias("id"), F.col("dst").alias("to"), "w").union(usable.select(F.col("dst"), F.col("src"), "w"))
    before = saved(ways.where(F.col("to") != source).join(dist, "id").groupBy("to").agg(F.min_by("id", F.struct(F.round(F.col("dist") + F.col("w"), 12), "id")).alias("id")))
    path = [target]
    while path[-1] != source:
        row = before.where(F.col("to") == path[-1]).first()
        if row is None:
            return []
        path.append(row["id"])
    return path[::-1]


def _distances_to_targets(ways: DataFrame, pairs: DataFrame, used: DataFrame) -> DataFrame:
    """(pair, id, dist) from each pair's source over edges that it hasn't used; no node farther than its target is kept."""
    frontier = state = saved(pairs.select("pair", F.col("source").alias("id"), F.lit(0.0).alias("dist")))
    goals = pairs.select("pair", F.col("target").alias("id"))
    while True:
        bound = state.join(goals, ["pair", "id"]).select("pair", F.col("dist").alias("bound"))
        offers = frontier.join(ways, F.col("id") == F.col("src")).select("pair", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        offers = offers.join(used, ["pair", "a", "b"], "left_anti").join(bound, "pair", "left").where("bound is null or dist <= bound").groupBy("pair", "id").agg(F.min("dist").alias("dist"))
        frontier = saved(offers.join(state.withColumnRenamed("dist", "old"), ["pair", "id"], "left").where("old is null or dist < old - 1e-12").select("pair", "id", "dist"))
        if frontier.isEmpty():
            return state
        state = saved(state.union(frontier).groupBy("pair", "id").agg(F.min("dist").alias("dist")))


def _traced(before: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, id, back): the nodes from each pair's target back to its source, back steps away; before (pair, id, to) names the node before each.

    Steps of 1, 2, 4, ... nodes are made of one another until no target has one so long, then taken from the longest on.
    """
    ends = pairs.select("pair", F.col("target").alias("id"))
    steps, step = [], before
    while not ends.join(step, ["pair", "id"], "left_semi").isEmpty():
        steps.append(step)
        step = saved(step.join(step.select("pair", F.col("id").alias("to"), F.col("to").alias("next")), ["pair", "to"]).select("pair", "id", F.col("next").alias("to")))
    trace = saved(ends.withColumn("back", F.lit(0)))
    for k in reversed(range(len(steps))):
        trace = saved(trace.union(trace.join(steps[k], ["pair", "id"]).select("pair", F.col("to").alias("id"), F.col("back") + (1 << k))))
    return trace


def disjoint_paths_between(edges: DataFrame, pairs: DataFrame, n_paths: int = 3) -> DataFrame:
    """(pair, path, pos, id): for each of pairs (pair, source, target) up to n_paths shortest paths, each over edges that the pair's paths before it haven't used.

    edges: undirected (src, dst, w); weights that aren't positive and finite are left out. Ties go to smaller nodes. All pairs
    advance in the same joins: a round for each hop of the longest path, not a query for each node, and are traced back by doubling. A pair without a path has no rows.
    """
    usable = edges.where((F.col("w") > 0) & (F.col("w") < float("inf")) & (F.col("src") != F.col("dst")))
    ways = saved(usable.select("src", "dst", "w").union(usable.select("dst", "src", "w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    pairs = saved(pairs.select("pair", "source", "target").where("source is not null and target is not null"))
    used = saved(pairs.select("pair", F.col("source").alias("a"), F.col("source").alias("b")).limit(0))
    found = None
    for k in range(1, n_paths + 1):
        dist = _distances_to_targets(ways, pairs, used)
        ends = pairs.join(dist, (pairs["pair"] == dist["pair"]) & (F.col("target") == F.col("id")), "left_semi")
        pairs = saved(ends)
        if pairs.isEmpty():
            break
        into = dist.select("pair", "id", "dist").join(ways.withColumnRenamed("src", "id"), "id").select("pair", "id", "dist", "w", "dst", F.least("id", "dst").alias("a"), F.greatest("id", "dst").alias("b"))
        into = into.join(used, ["pair", "a", "b"], "left_anti").join(pairs.select("pair", "source"), "pair").where("dst <> source")
        before = into.groupBy("pair", "dst").agg(F.min_by("id", F.struct(F.round(F.col("dist") + F.col("w"), 12), "id")).alias("to")).withColumnRenamed("dst", "id")
        trace = _traced(saved(before), pairs)
        length = trace.groupBy("pair").agg(F.max("back").alias("length"))
        path = saved(trace.join(length, "pair").select("pair", F.lit(k).alias("path"), (F.col("length") - F.col("back")).alias("pos"), "id"))
        found = path if found is None else found.union(path)
        links = path.join(path.select("pair", (F.col("pos") - 1).alias("pos"), F.col("id").alias("next")), ["pair", "pos"])
        used = saved(used.union(links.select("pair", F.least("id", "next"), F.greatest("id", "next"))))
    if found is None:
        return pairs.select("pair", F.lit(1).alias("path"), F.lit(0).alias("pos"), F.col("source").alias("id")).limit(0)
    return found


def disjoint_paths(edges: DataFrame, source: int, target: int, n_paths: int = 3) -> DataFrame:
    """(path, pos, id): disjoint_paths_between of one pair."""
    pair = edges.sparkSession.range(1).select(F.col("id").alias("pair"), F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"))
    return disjoint_paths_between(edges, pair, n_paths).select("path", "pos", "id")


def joined_labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """(id, c): labels (id, c) after the components that links (a, b) name have become one, under the smallest of their labels."""
    ways = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = saved(ways.select(F.col("a").alias("c")).distinct().withColumn("new", F.col("c")))
    while True:
        offers = ways.join(state.select(F.col("c").alias("b"), "new"), "b").groupBy(F.col("a").alias("c")).agg(F.min("new").alias("offer"))
        following = saved(state.join(offers, "c", "left").select("c", F.least("new", F.coalesce("offer", "new")).alias("now"), "new"))
        state = following.select("c", F.col("now").alias("new"))
        if following.where("now < new").isEmpty():
            return saved(label.join(state, "c", "left").select("id", F.coalesce("new", "c").alias("c")))


def followed_labels(label: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, c): labels (id, c) after each component a has joined the b that it chose; chosen (a, b) has an a once and no cycle but of two that chose each other.

    Each component follows its chosen one's choice, so rounds double the steps: as many as the logarithm of the longest chain.
    """
    back = chosen.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("mutual"))
    state = saved(chosen.select("a", "b").join(back, ["a", "b"], "left").select(F.col("a").alias("c"), F.when(F.col("mutual") & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("new")))
    while True:
        following = saved(state.join(state.select(F.col("c").alias("new"), F.col("new").alias("next")), "new", "left").select("c", F.coalesce("next", "new").alias("new"), (F.col("next") != F.col("new")).alias("moved")))
        state = following.select("c", "new")
        if following.where("moved").isEmpty():
            return saved(label.join(state, "c", "left").select("id", F.coalesce("new", "c").alias("c")))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, w): a minimum spanning forest of edges (src, dst, w) by Boruvka's rounds; ties by ends. Weights of zero are left out."""
    edges = saved(edges.where("w > 0 and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")))
    label = saved(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
    tree = None
    while True:  # each round at least halves the components that have an edge out
        crossing = edges.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a <> b")
        ends = crossing.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "src", "dst").alias("e"), F.struct("a", "b").alias("ab"))
        best = saved(ends.groupBy("c").agg(F.min_by(F.struct("e", "ab"), "e").alias("m")).select("c", "m.*"))
        if best.isEmpty():
            break
        new = best.select("e.*").distinct().select("src", "dst", "w")
        tree = saved(new if tree is None else tree.union(new).distinct())
        label = joined_labels(label, best.select("ab.a", "ab.b"))
    return tree if tree is not None else edges.limit(0)


def normalised_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, v): entries of D^-1/2 (A + I) D^-1/2."""
    simple = both_ways(edges).select("graph_id", "src", "dst").distinct().union(nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    degree = simple.groupBy("graph_id", "src").agg(F.count("*").alias("d"))
    return simple.join(degree, ["graph_id", "src"]).join(degree.select("graph_id", F.col("src").alias("dst"), F.col("d").alias("e")), ["graph_id", "dst"]).select("graph_id", "src", "dst", F.round(1 / F.sqrt(F.col("d") * F.col("e")), 6).alias("v"))


def bridges(labels: DataFrame) -> DataFrame:
    """(graph_id, src, dst): for graphs of several components, from component_labels, an edge between the first two; by their smallest nodes."""
    firsts = labels.select("graph_id", "component").distinct().groupBy("graph_id").agg(F.array_sort(F.collect_list("component")).alias("c"))
    return firsts.where(F.size("c") > 1).select("graph_id", F.get("c", 0).alias("src"), F.get("c", 1).alias("dst"))


def connected(labels: DataFrame) -> DataFrame:
    """(graph_id, src, dst): the edges that make each graph one component, from component_labels: from the first component to each other one, by their smallest nodes."""
    each = labels.select("graph_id", "component").distinct()
    first = each.groupBy("graph_id").agg(F.min("component").alias("src"))
    return each.join(first, "graph_id").where("component <> src").select("graph_id", "src", F.col("component").alias("dst"))
