"""Repair of graphs by donors: the rewrite that comes closest to the mean of a graph's nearest donors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import bucket, digest
from ..sources.corpora import saved, spread
from .cuts import edge_contexts, pair_hash
from .decompositions import edge_key
from .matching import nearest_of_vectors
from .rewriting import replaced

BITS = 6  # of a label's bucket in the vector of a graph


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def label_kinds(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(graph_id, kind): the buckets of a graph's labels, sorted."""
    return nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(bucket(F.col("label"), bits).cast("int"))).alias("kind"))


def _digest(*values: Column) -> Column:
    return F.unhex(digest(*(F.array_join(v, ",") for v in values)))


def _parts(edges: DataFrame, graphs: DataFrame, scope: str, bits: int) -> DataFrame:
    """(graph_id, inode, cut_size, cut_key, assoc_hash, ends) of the subgraphs of graphs, and what else these hold (each graph once): their boundary by scope, and the buckets of both labels, sorted."""
    key = lambda c: edge_key(scope, c["elabel"], F.element_at(F.split(c["ekey"], r"\|"), -2), F.substring_index(c["ekey"], "|", -1))
    keep = tuple(c for c in graphs.columns if c != "graph_id")
    parts = pair_hash(edge_contexts(edges.join(spread(graphs), "graph_id"), keep=keep, within=edges)).withColumn("cut_key", F.array_join(F.array_sort(F.transform("cut", key)), ";"))
    ends = F.array_sort(F.array(*(bucket(F.col(c), bits).cast("int") for c in ("lu", "lv"))))
    return parts.select("graph_id", "inode", F.size("cut").alias("cut_size"), "cut_key", "assoc_hash", ends.alias("ends"), *keep)


def repairs(nodes: DataFrame, edges: DataFrame, sources: DataFrame, donors: DataFrame, k: int = 5, scope: str = "label", bits: int = BITS) -> DataFrame:
    """(graph_id, inode, donor_graph, donor_inode, before, after): the best rewrite of each graph in sources (graph_id), if it has any.

    Each source takes its k nearest donors by cosine. A rewrite exchanges one of its edges for an edge of such a donor with the same
    boundary (edges known by scope) and another hash. The vectors of rewritten graphs are those of their sources with the labels of
    two nodes exchanged, so none is built. The best has the largest cosine (after; before: of the source) to the mean of the donors'
    unit vectors, ties to the smaller inode, donor_graph and donor_inode.

    Graphs of the same labels are a kind, and those of a kind that have the same donors share an aim. Vectors belong to kinds, and the best rewrite of an
    edge to its aim, boundary, hash and labels: each is found once. A graph only picks among the edges it has.
    """
    kinds = label_kinds(nodes, bits)
    of = lambda graphs: kinds.join(spread(graphs.select("graph_id").distinct()), "graph_id", "left_semi")
    asked = saved(of(sources))
    first = F.row_number().over(W.partitionBy("kind").orderBy("graph_id"))
    held = saved(of(donors).withColumn("place", first).where(F.col("place") <= k + 1).drop("place"))  # no others are among the nearest of any
    counts = F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda b: F.size(F.filter("kind", lambda v: v == b)).cast("double"))
    vectors = saved(asked.select("kind").union(held.select("kind")).distinct().withColumn("vector", counts))
    norm = _norm(F.col("vector"))
    vectors = saved(vectors.withColumn("x", F.transform("vector", lambda v: v / norm)))
    units = held.join(spread(vectors), "kind").select(F.col("graph_id").alias("id"), "x")
    searched = asked.select("kind").distinct().join(spread(vectors), "kind")
    near = saved(searched.join(spread(nearest_of_vectors(searched.select("x").distinct(), k + 1, units)), "x").select("kind", "near"))

    donors_of = F.slice(F.filter("near", lambda j: j != F.col("graph_id")), 1, k)
    aimed = asked.join(spread(near), "kind").select("graph_id", "kind", donors_of.alias("donors")).where(F.size("donors") > 0)
    aimed = saved(aimed.withColumn("aim", _digest(F.col("kind"), F.col("donors"))))
    aims = saved(aimed.dropDuplicates(["aim"]).drop("graph_id"))
    pairs = aims.select("aim", F.explode("donors").alias("donor_graph"))
    picked = pairs.join(spread(units.withColumnRenamed("id", "donor_graph")), "donor_graph").groupBy("aim").agg(F.array_sort(F.collect_list(F.struct("donor_graph", "x"))).alias("xs"))  # k an aim
    zero = F.array_repeat(F.lit(0.0), 1 << bits)
    mean = picked.select("aim", F.transform(F.aggregate("xs", zero, lambda s, d: F.zip_with(s, d["x"], lambda a, b: a + b)), lambda v: v / F.size("xs")).alias("mean"))
    target = saved(mean.join(spread(aims.select("aim", "kind")), "aim").join(spread(vectors.select("kind", "vector")), "kind").select("aim", "vector", "mean"))

    edge = F.unhex(digest(F.hex("aim"), F.col("cut_size").cast("string"), "cut_key", "assoc_hash", F.array_join("ends", ",")))
    own = saved(_parts(edges, aimed.select("graph_id", "aim"), scope, bits).withColumn("edge", edge))
    theirs = _parts(edges, pairs.select(F.col("donor_graph").alias("graph_id")).distinct(), scope, bits).toDF("donor_graph", "donor_inode", "cut_size", "cut_key", "donor_hash", "donor_ends")
    offers = saved(pairs.join(spread(theirs), "donor_graph"))
    both = own.dropDuplicates(["edge"]).drop("graph_id", "inode").join(spread(offers), ["aim", "cut_size", "cut_key"]).where("assoc_hash <> donor_hash")
    # a score depends on the aim and the labels that go and come alone
    rewrites = saved(both.groupBy("edge", "aim", "ends", "donor_ends").agg(F.min(F.struct("donor_graph", "donor_inode")).alias("first")))
    changes = rewrites.select("aim", "ends", "donor_ends").distinct().join(spread(target), "aim")
    times = lambda ends, b: F.size(F.filter(ends, lambda e: e == b))
    new = F.transform("vector", lambda v, b: v - times("ends", b) + times("donor_ends", b))
    cosine = lambda x: F.round(_dot(x, F.col("mean")) / (_norm(x) * _norm(F.col("mean"))), 9)
    scored = changes.withColumn("new", new).select("aim", "ends", "donor_ends", cosine(F.col("vector")).alias("before"), cosine(F.col("new")).alias("after"))
    every = rewrites.join(spread(scored), ["aim", "ends", "donor_ends"]).select("edge", "first.*", "before", "after")
    best_of = lambda df, by, *columns: df.groupBy(by).agg(F.min_by(F.struct(*columns, "before", "after"), F.struct(-F.col("after"), *columns)).alias("b")).select(by, "b.*")
    best = saved(best_of(every, "edge", "donor_graph", "donor_inode"))
    return best_of(own.select("graph_id", "inode", "edge").join(spread(best), "edge"), "graph_id", "inode", "donor_graph", "donor_inode")


def repaired(edges: DataFrame, chosen: DataFrame, scope: str = "label") -> DataFrame:
    """(graph_id, src, dst, label, lu, lv): the edges of the graphs that repairs has chosen a rewrite for, after it."""
    size = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).cast("long").alias("n_nodes"))
    return replaced(edges, chosen.join(spread(size), "graph_id"), scope)
