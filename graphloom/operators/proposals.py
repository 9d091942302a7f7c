"""Sets of nodes at which something could be hung: enumerated or sampled by rank, looked up in the index, proposed with a donor."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, uniform
from ..sources.corpora import by_graph, dealt, saved, spread, tasks_for
from .cuts import virtual_cut
from .ranking import numbered
from .sampling import seeded

CHUNK = 1 << 16  # ranks of one graph that a row stands for before they are dealt out


def choose(n: Column, k: int) -> Column:
    """How many sets of k there are among n, for n of at least 0; in 64 bits, so up to about 2,000,000 nodes at k = 3."""
    product = n.cast("long")
    for i in range(1, k):
        product = product * (n - i)
    return F.call_function("div", product, F.lit(factorial(k)).cast("long")) if k > 1 else product


def unranked(df: DataFrame, rank: str, k: int) -> DataFrame:
    """df with picks: the k positions from 0, ascending, of the set with this rank in colexicographic order.

    The largest position c of a rank r is the last with choose(c, k) <= r, and r - choose(c, k) ranks the others. c lies less
    than k above the k-th root of k! r, so the cost doesn't depend on the number of nodes.
    """
    df = df.withColumn("_rest", F.col(rank))
    for i in range(k, 0, -1):
        root = F.floor(F.pow(F.col("_rest").cast("double") * factorial(i), F.lit(1.0 / i)))
        near = F.sequence(F.greatest(root - 1, F.lit(i - 1).cast("long")), root + i + 1)
        df = df.withColumn(f"_c{i}", F.array_max(F.filter(near, lambda x: choose(x, i) <= F.col("_rest"))))  # noqa: B023
        df = df.withColumn("_rest", F.col("_rest") - choose(F.col(f"_c{i}"), i))
    return df.withColumn("picks", F.array(*(F.col(f"_c{i}") for i in range(1, k + 1)))).drop("_rest", *(f"_c{i}" for i in range(1, k + 1)))


def _labelled(sets: DataFrame, nodes: DataFrame, small: int) -> DataFrame:
    """sets (graph_id, ..., picks: positions from 0) with members (node ids, ascending) and key (their sorted labels).

    The nodes of graphs of at most small nodes travel as one array; those of larger ones are joined.
    """
    large = saved(nodes.groupBy("graph_id").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("graph_id"))
    none = large.isEmpty()
    few = (nodes if none else nodes.join(large, "graph_id", "left_anti")).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "label"))).alias("_all"))
    found = lambda df: df.withColumns({"members": F.transform("_found", lambda m: m["node_id"]), "key": F.array_join(F.array_sort(F.transform("_found", lambda m: m["label"])), ";")}).drop("_found")
    out = found(sets.join(spread(few), "graph_id").withColumn("_found", F.transform("picks", lambda p: F.get("_all", p.cast("int")))).drop("_all"))
    if none:
        return out
    place = F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1
    placed = nodes.join(large, "graph_id", "left_semi").select("graph_id", place.cast("long").alias("_p"), F.struct("node_id", "label").alias("_m"))
    columns = sets.columns
    each = sets.join(large, "graph_id", "left_semi").withColumn("_p", F.explode("picks")).join(spread(placed), ["graph_id", "_p"])
    return out.unionByName(found(each.groupBy(*columns).agg(F.array_sort(F.collect_list("_m")).alias("_found"))))


def node_sets(nodes: DataFrame, k: int, most: int | None = None, seed: str = "31", small: int = SMALL) -> DataFrame:
    """(graph_id, rank, picks, members, key): the sets of k nodes of each graph, all of them or a seeded sample of most.

    A sample takes one set from each of most equal stretches of ranks, so sets differ, each is as likely as any other (to one set
    a stretch), and the cost is that of the sample. All sets of a large graph are dealt out in chunks of ranks.
    """
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("graph_id", choose(F.col("n"), k).alias("total"))
    if most is None:
        chunks = size.select("graph_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(CHUNK).cast("long"))).alias("first")).repartition("graph_id", "first")
        ranks = chunks.select("graph_id", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col("total")) - 1)).alias("rank"))
    else:
        m = F.least("total", F.lit(most).cast("long"))
        draws = size.select("graph_id", "total", m.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("i"))
        low, high = F.expr("(i * total) div m"), F.expr("((i + 1) * total) div m")
        ranks = draws.select("graph_id", (low + F.floor(uniform(seeded(seed, "graph_id", "i")) * (high - low))).alias("rank"))
    return _labelled(unranked(ranks, "rank", k), nodes, small)


def virtual_candidates(nodes: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """(cut_key, n_sets, n_entries): sets of k nodes of one graph whose labels are the virtual key of an index entry."""
    known = virtual_cut(edges).where(F.col("cut_size") == k).groupBy("cut_key").agg(F.count("*").alias("n_entries"))
    sets = node_sets(nodes, k).groupBy(F.col("key").alias("cut_key")).agg(F.count("*").alias("n_sets"))
    return sets.join(known, "cut_key")


def sampled_candidates(nodes: DataFrame, edges: DataFrame, k: int = 3, most: int = 8, seen: DataFrame | None = None) -> DataFrame:
    """(graph_id, nodes, cut_key, n_entries): of a sample of most sets of k nodes by graph, those that the index knows; seen (graph_id, nodes) are left out."""
    known = virtual_cut(edges).where(F.col("cut_size") == k).groupBy("cut_key").agg(F.count("*").alias("n_entries"))
    named = F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("nodes")
    sets = node_sets(nodes, k, most).select("graph_id", named, F.col("key").alias("cut_key"))
    if seen is not None:
        sets = sets.join(seen.select("graph_id", "nodes").distinct(), ["graph_id", "nodes"], "left_anti")
    return sets.join(known, "cut_key").select("graph_id", "nodes", "cut_key", "n_entries")


def proposals(nodes: DataFrame, edges: DataFrame, wanted: int = 2, misses: int = 6, attempts: int = 12, most_nodes: int = 3, seed: str = "32") -> DataFrame:
    """(graph_id, attempt, k, nodes, cut_key, n_donors, donor_graph, donor_inode): up to wanted proposals for each even graph.

    An attempt draws a size up to most_nodes, weighted by the entries that the index of odd graphs has of it, and a set of that size; it
    hits where the index knows the set's labels. A graph stops at wanted hits or misses misses; then sizes that it hasn't
    attempted get an attempt each, smallest first, as long as hits are wanting. All attempts are drawn at once (attempts
    and most_nodes bound them) and running counts cut them off. Each hit draws one of its donors.
    """
    index = saved(virtual_cut(edges).where(F.col("graph_id") % 2 == 1).where(F.col("cut_size") <= most_nodes).select("cut_key", "cut_size", F.col("graph_id").alias("donor_graph"), F.col("inode").alias("donor_inode")))
    of_index = tasks_for(index.sparkSession, index.count())
    donors = saved(numbered(index, "cut_key", "donor_graph", "donor_inode", name="place", tasks=of_index))  # so a key's donors have places in a row
    known = saved(donors.groupBy("cut_key").agg(F.count("*").alias("n_donors"), F.min("place").alias("_first")))
    weight = {r["cut_size"]: r["n"] for r in index.groupBy("cut_size").agg(F.count("*").alias("n")).collect()}  # a row a size
    running = [sum(weight.get(j, 0) for j in range(1, k + 1)) for k in range(1, most_nodes + 1)]

    part = nodes.where(F.col("graph_id") % 2 == 0)
    size = part.groupBy("graph_id").agg(F.count("*").alias("n"))
    u = lambda what: uniform(F.concat_ws("|", F.lit(seed), F.lit(what), F.col("graph_id").cast("string"), F.col("attempt").cast("string")))
    sums = F.array(*(F.lit(x).cast("long") for x in running))
    drawn = F.floor(u("size") * F.get(sums, F.least(F.col("n"), F.lit(most_nodes)).cast("int") - 1))
    k = (F.size(F.filter(sums, lambda x: x <= drawn)) + 1).cast("int")
    first = size.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("k", k)
    last = size.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most_nodes)))).withColumn("attempt", F.lit(attempts) + F.col("k"))
    every = first.unionByName(last).where("k <= n")
    sets = None
    for j in range(1, most_nodes + 1):
        ranks = every.where(F.col("k") == j).select("graph_id", "attempt", "k", F.floor(u("set") * choose(F.col("n"), j)).alias("rank"))
        found = _labelled(unranked(ranks, "rank", j), part, SMALL)
        sets = found if sets is None else sets.union(found)
    sets = sets.select("graph_id", "attempt", "k", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("nodes"), F.col("key").alias("cut_key"))
    rows = size.count() * (attempts + most_nodes)
    n = tasks_for(sets.sparkSession, rows)
    tried = by_graph(dealt(sets, n, "cut_key").join(dealt(known, n, "cut_key"), "cut_key", "left"), rows)

    before = W.partitionBy("graph_id").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
    hit = F.col("n_donors").isNotNull()
    main = tried.where(F.col("attempt") <= attempts).withColumns({"hits": count(hit), "missed": count(~hit)}).where((F.col("hits") < wanted) & (F.col("missed") < misses)).drop("hits", "missed")
    so_far = main.groupBy("graph_id").agg(F.count("n_donors").alias("got"), F.collect_set("k").alias("ks"))
    sweep = tried.where(F.col("attempt") > attempts).join(spread(so_far), "graph_id", "left").where(F.col("ks").isNull() | ~F.array_contains("ks", F.col("k")))
    sweep = sweep.withColumn("hits", F.coalesce("got", F.lit(0)) + count(hit)).where(F.col("hits") < wanted).select(*main.columns)
    kept = main.union(sweep).where(hit)
    place = F.col("_first") + F.floor(u("donor") * F.col("n_donors"))
    n = max(n, of_index)
    drawn = dealt(kept.withColumn("place", place), n, "place").join(dealt(donors.drop("cut_key", "cut_size"), n, "place"), "place")
    return drawn.select("graph_id", "attempt", "k", "nodes", "cut_key", "n_donors", "donor_graph", "donor_inode")
