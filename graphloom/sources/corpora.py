"""Corpora of small labelled graphs, derived from the relational tables.

A corpus is tables, never Python objects: nodes (graph_id, node_id, label), edges (graph_id, src, dst, label, and the
labels lu, lv of both ends; src < dst), and graphs (graph_id, target). Order graphs: one graph per order, a node per
line item labelled with its part's type, an edge 'seq' between neighbours in order and 'flag' between lines two apart
with the same return flag. User graphs: one per user, nodes are event types, edges are transitions.
"""

from __future__ import annotations

import uuid
from tempfile import gettempdir

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FIRST = ["l_linenumber", "l_partkey", "l_suppkey"]  # which hardly ever leave a tie
_ORDER = [*_FIRST, "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, buckets: int = 0, order: list[str] = _ORDER, orders: DataFrame | None = None) -> DataFrame:
    """The lines with their place in the order, what the next two hold, and whether they tie with the line before; dealt by order into so many buckets, if given; of orders (graph_id), if given."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *order)
    if orders is not None:
        lines = lines.join(orders.select(F.col("graph_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("label")), F.col("l_partkey") == F.col("p_partkey"))
    in_order = W.partitionBy("l_orderkey").orderBy(*order)
    if buckets:
        lines = lines.repartition(buckets, "l_orderkey")
    place = F.row_number().over(in_order)
    ahead = [F.lead(c, k).over(in_order).alias(f"{c}{k}") for c, k in (("label", 1), ("label", 2), ("l_returnflag", 2))]
    tied = place > 1
    for c in order:
        tied &= F.lag(c).over(in_order).eqNullSafe(F.col(c))
    return lines.select(F.col("l_orderkey").alias("graph_id"), place.alias("node_id"), "label", "l_returnflag", *ahead, tied.alias("tied"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(_lines(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_lines(spark, sf_dir))


def _nodes(lines: DataFrame) -> DataFrame:
    return lines.select("graph_id", "node_id", "label")


def _edges(lines: DataFrame) -> DataFrame:
    """Both kinds of edges in one pass over the lines of an order: no join of the lines with themselves."""
    edge = lambda kind, step: F.struct((F.col("node_id") + step).alias("dst"), F.lit(kind).alias("label"), F.col(f"label{step}").alias("lv"))
    both = F.array(F.when(F.col("label1").isNotNull(), edge("seq", 1)), F.when(F.col("l_returnflag") == F.col("l_returnflag2"), edge("flag", 2)))
    out = lines.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("lu"), F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e"))
    return out.select("graph_id", "src", F.col("e.dst").alias("dst"), F.col("e.label").alias("label"), "lu", F.col("e.lv").alias("lv"))


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the folder of spark.checkpoint.dir, or in a temporary one where that is unset and Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{gettempdir()}/checkpoints"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df cut from its lineage: a table in a new folder."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, whose join sorts and merges. Tables of a corpus are compressed so well that Spark takes them for small ones and would broadcast them."""
    return df.hint("merge")


def _bucketed(lines: DataFrame, n: int, what: str = "lines") -> DataFrame:
    """lines as an external table in n buckets of graph_id."""
    spark, name = lines.sparkSession, f"graphloom_{what}_{uuid.uuid4().hex}"
    lines.write.bucketBy(n, "graph_id").option("path", new_folder(spark)).saveAsTable(name)
    return spark.table(name)


LINES = 50_000  # of a bucket
ROWS = 500_000  # of a task, where tasks follow the rows


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt to, at ROWS each; 0, for the session's number, where that is enough."""
    n = -(-rows // ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks; as it is, where that is 0."""
    return df.repartition(tasks, *keys) if tasks else df


def by_graph(df: DataFrame, rows: int) -> DataFrame:
    """df cut from its lineage: a table in buckets of graph_id of about ROWS of its rows, so that what groups by graph_id needs no shuffle, and a task's rows don't grow with the table."""
    n = min(2048, max(1, -(-rows // ROWS)))
    return _bucketed(df.repartition(n, "graph_id"), n, "rows")


_DERIVED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _state_of_files(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Path, size and time of change of the files of some tables."""
    found = []
    for name in names:
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(found)


def derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the order graphs, derived once for a session and the present state of their input files.

    The lines are joined, dealt by graph_id and ordered once and written in buckets of graph_id, so that what groups by graph_id needs no
    shuffle; nodes and edges are read from them row by row. Every query would otherwise sort lineitem again for each use of a corpus.
    Only the first columns of the order are shuffled; orders in which they leave lines tied are derived again by all of them.
    """
    key = (spark.sparkContext.applicationId, _state_of_files(spark, sf_dir, "lineitem", "part"))
    if key not in _DERIVED:
        n = min(2048, max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES)))
        lines = _bucketed(_lines(spark, sf_dir, n, _FIRST), n)
        tied = saved(lines.where("tied").select("graph_id").distinct())
        if not tied.isEmpty():
            lines = _bucketed(lines.join(tied, "graph_id", "left_anti").union(_lines(spark, sf_dir, n, orders=tied)), n)
        _DERIVED[key] = _nodes(lines), _edges(lines)
    return _DERIVED[key]


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    ways = F.array(F.struct("src", "dst", "lu", "lv"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("lv").alias("lu"), F.col("lu").alias("lv")))
    return e.select("graph_id", "label", F.explode(ways).alias("w")).select("graph_id", "w.src", "w.dst", "label", "w.lu", "w.lv")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderstatus").alias("target"))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, src, dst, weight): transitions between the event types of a user's consecutive events."""
    by_time = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("src"), F.lead("event_type").over(by_time).alias("dst"))
    return steps.where("dst is not null").groupBy("graph_id", "src", "dst").agg(F.count("*").alias("weight"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): the embedding vectors as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def validate(n: DataFrame, e: DataFrame, most: int = 50) -> DataFrame:
    """(graph_id, problem, n): loops, edges to missing nodes, unlabelled nodes, repeated edges and graphs of more than most nodes."""
    count = lambda df, problem: df.groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(problem).alias("problem"), "n")
    ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    large = n.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("graph_id", F.lit("too large").alias("problem"), "n")
    repeated = e.groupBy("graph_id", "src", "dst").count().where("count > 1")
    return count(e.where("src = dst"), "loop").union(count(ends.join(n, ["graph_id", "node_id"], "left_anti"), "missing node")).union(count(n.where("label is null"), "no label")).union(count(repeated, "repeated edge")).union(large)
