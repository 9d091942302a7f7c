"""The order in which a breadth-first walk meets the nodes of a graph, with restarts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, by_size, packed
from ..sources.corpora import both_ways, saved
from .paths import component_labels
from .ranking import numbered, numbered_in


def _packed_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """traversal_order of small graphs: a queue folded over each graph's row, nodes named by their rank."""
    graphs = packed(nodes, edges).withColumn("ids", F.transform("members", lambda m: m["node_id"]))
    around = lambda n: F.array_distinct(F.transform(F.filter("ways", lambda w: (w["src"] == n) & (w["dst"] != n) & F.array_contains("ids", w["dst"])), lambda w: w["dst"]))
    found = F.transform("ids", lambda n: F.struct((-F.size(around(n))).alias("least"), n.alias("node_id"), around(n).alias("near")))
    graphs = graphs.select("graph_id", F.array_sort(found).alias("ranked"))
    rank = F.map_from_entries(F.transform("ranked", lambda x, p: F.struct(x["node_id"], p)))
    graphs = graphs.withColumn("rank", rank).withColumn("near", F.transform("ranked", lambda x: F.array_sort(F.transform(x["near"], lambda d: F.col("rank")[d]))))
    entry = lambda p, level, component: F.struct(p.alias("p"), level.cast("int").alias("level"), component.cast("int").alias("component"))
    all_ = F.sequence(F.lit(0), F.size("ranked") - 1)
    met = lambda queue: F.transform(queue, lambda x: x["p"])
    restart = lambda queue: F.array(entry(F.array_min(F.array_except(all_, met(queue))), F.lit(0), F.coalesce(F.array_max(F.transform(queue, lambda x: x["component"])) + 1, F.lit(0))))

    def step(queue, i):
        going = F.when(F.size(queue) <= i, F.concat(queue, restart(queue))).otherwise(queue)
        new = lambda q, head: F.transform(F.array_except(F.get("near", head["p"]), met(q)), lambda p: entry(p, head["level"] + 1, head["component"]))
        return F.get(F.transform(F.array(going), lambda q: F.concat(q, new(q, F.get(q, i)))), F.lit(0))

    order = F.aggregate(all_, F.expr("cast(array() as array<struct<p:int,level:int,component:int>>)"), step)
    each = graphs.select("graph_id", "ranked", F.posexplode(order).alias("pos", "x"))
    return each.select("graph_id", F.get("ranked", F.col("x.p"))["node_id"].alias("node_id"), "x.component", "x.level", "pos")


def _joined_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """traversal_order by joins, for graphs of any size: all components advance by a level at a time."""
    ways = saved(both_ways(edges).where("src <> dst").select("graph_id", F.col("src").alias("node_id"), "dst").distinct())
    degree = ways.groupBy("graph_id", "node_id").agg(F.count("*").alias("deg"))
    ranked = nodes.select("graph_id", "node_id").join(degree, ["graph_id", "node_id"], "left").na.fill(0, ["deg"])
    ranked = saved(numbered_in(ranked, "graph_id", F.desc("deg"), "node_id", name="rank", first=0).select("graph_id", "node_id", "rank"))
    parts = saved(component_labels(nodes, edges).join(ranked, ["graph_id", "node_id"]))
    starts = numbered_in(parts.groupBy("graph_id", F.col("component").alias("label")).agg(F.min("rank").alias("rank")), "graph_id", "rank", name="component", first=0)
    frontier = starts.join(ranked, ["graph_id", "rank"]).select("graph_id", "node_id", "component", F.lit(0).alias("level"), F.col("component").cast("long").alias("at"))
    frontier = seen = saved(frontier)
    for level in count(1):
        reached = frontier.join(ways, ["graph_id", "node_id"]).groupBy("graph_id", F.col("dst").alias("node_id"), "component").agg(F.min("at").alias("from"))
        new = reached.join(seen, ["graph_id", "node_id"], "left_anti").join(ranked, ["graph_id", "node_id"])
        if new.isEmpty():
            break
        frontier = saved(numbered(new, "graph_id", "component", "from", "rank", name="at").select("graph_id", "node_id", "component", F.lit(level).alias("level"), "at"))
        seen = seen.union(frontier)
    return numbered_in(seen, "graph_id", "component", "level", "at", first=0).select("graph_id", "node_id", "component", "level", "pos")


def traversal_order(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph_id, node_id, component, level, pos): the place at which a breadth-first walk meets each node, from 0.

    It starts at the node of largest degree and goes on to a node's unmet neighbours by falling degree; where none is left, it starts again at
    the unmet node of largest degree (component counts the starts: component = 0 is the walk without restarts). Ties go to the smaller node.
    Loops, parallel edges and edges to missing nodes don't count. Graphs of at most small nodes and edges are one row each, larger ones go by joins.
    """
    edges = edges.join(nodes.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").join(nodes.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi").select(edges.columns)
    large = by_size(nodes, edges, small)
    if large is None:
        return _packed_order(nodes, edges)
    part = lambda df, how: df.join(large, "graph_id", how)
    return _packed_order(part(nodes, "left_anti"), part(edges, "left_anti")).union(_joined_order(part(nodes, "left_semi"), part(edges, "left_semi")))
