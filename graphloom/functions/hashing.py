"""Canonical hashes of labelled graphs: Weisfeiler-Leman rounds as joins, md5 of joined strings throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def sorted_text(values: Column, by: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_list(values)), by)


def bucket(text: Column, bits: int) -> Column:
    """The first 32 bits of the md5 of text, modulo 2^bits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (1 << bits)


def uniform(text: Column) -> Column:
    """A number in (0, 1) that follows from text."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def wl_nodes(nodes: DataFrame, ways: DataFrame, key: list[str], rounds: int = 3) -> DataFrame:
    """(key, node_id, h): node hashes after some rounds; nodes (key, node_id, label), ways (key, src, dst, label) in both directions.

    Each round is a join and a grouping, whose result is written: graphs may be of any size.
    """
    from ..sources.corpora import saved

    state = nodes.select(*key, "node_id", F.col("label").alias("h"))
    for _ in range(rounds):
        seen = ways.select(*key, F.col("src").alias("node_id"), "dst", "label").join(state.select(*key, F.col("node_id").alias("dst"), F.col("h").alias("hn")), [*key, "dst"])
        around = seen.groupBy(*key, "node_id").agg(sorted_text(F.concat_ws(":", "label", "hn")).alias("around"))
        state = saved(state.join(around, [*key, "node_id"], "left").select(*key, "node_id", digest("h", F.coalesce("around", F.lit(""))).alias("h")))
    return state


def wl_rounds(graphs: DataFrame, rounds: int, members: str = "members", ways: str = "ways") -> DataFrame:
    """graphs with members (array of node_id, h) after some rounds over ways (array of src, dst, label, in both directions), and hash."""
    for _ in range(rounds):
        at = F.map_from_entries(F.transform(members, lambda x: F.struct(x["node_id"], x["h"])))
        graphs = graphs.withColumn("at", at)
        around = lambda x: F.filter(ways, lambda w: (w["src"] == x["node_id"]) & F.map_contains_key("at", w["dst"]))
        told = lambda x: F.array_join(F.array_sort(F.transform(around(x), lambda w: F.concat_ws(":", w["label"], F.col("at")[w["dst"]]))), ",")
        graphs = graphs.withColumn(members, F.transform(members, lambda x: F.struct(x["node_id"].alias("node_id"), F.md5(F.concat_ws("|", x["h"], told(x))).alias("h"))))
    return graphs.withColumn("hash", F.md5(F.array_join(F.array_sort(F.transform(members, lambda x: x["h"])), ","))).drop("at")


SMALL = 64  # nodes or edges of a graph that is held in one row


def by_size(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame | None:
    """(graph_id): the graphs that have more than small nodes or edges, as a written table; None where there is none."""
    from ..sources.corpora import saved

    over = lambda df: df.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("graph_id")
    large = over(nodes).union(over(edges)).distinct()
    return None if large.isEmpty() else saved(large)


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, members, ways): each graph in one row; for small graphs."""
    from ..sources.corpora import spread

    members = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", F.col("label").alias("h"))).alias("members"))
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "label")
    ways = edges.groupBy("graph_id").agg(F.flatten(F.collect_list(F.array(way("src", "dst"), way("dst", "src")))).alias("ways"))
    return members.join(spread(ways), "graph_id", "left").withColumn("ways", F.coalesce("ways", F.expr("cast(array() as array<struct<src:int,dst:int,label:string>>)")))


def graph_hashes(nodes: DataFrame, edges: DataFrame, rounds: int = 3, small: int = SMALL) -> DataFrame:
    """(graph_id, hash): equal for isomorphic graphs; graphs that these rounds can't tell apart collide. Large graphs go by joins."""
    from ..sources.corpora import both_ways

    large = by_size(nodes, edges, small)
    if large is None:
        return wl_rounds(packed(nodes, edges), rounds).select("graph_id", "hash")
    some = lambda df, how: df.join(large, "graph_id", how)
    few = wl_rounds(packed(some(nodes, "left_anti"), some(edges, "left_anti")), rounds).select("graph_id", "hash")
    rest = wl_hash(some(nodes, "left_semi"), both_ways(some(edges, "left_semi")), ["graph_id"], rounds)
    return few.union(rest.select("graph_id", "hash"))


def wl_hash(nodes: DataFrame, ways: DataFrame, key: list[str], rounds: int = 3) -> DataFrame:
    """(key, hash) by joins, for graphs of any size."""
    return wl_nodes(nodes, ways, key, rounds).groupBy(*key).agg(F.md5(sorted_text(F.col("h"))).alias("hash"))
