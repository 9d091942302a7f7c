"""Near-duplicate documents by a chosen-path similarity join on word shingles.

Every document has the set of its distinct 5-word shingles. Documents with equal sets form one class, which has a
number of its own. In each of several independent trees a class follows the path of its minwise
tokens: a node holds the classes whose first tokens of that tree agree. Nodes of few members
are compared exhaustively, larger ones branch further. The last depth is the deepest that still brings a pair at
the threshold together in some tree with the wanted recall. Members are first compared with the smallest id of their
node; pairs that this has already connected need no second look, so a large group of near copies costs a link each and
not all pairs. Nodes that are large at the last depth and still hold several components have their members compared
with a few hubs, for some rounds; then the members that are still outside the largest component are compared with all
members, block by block. Each candidate is confirmed on its full sets: the sets of a group stream past one that is held.
"""

from __future__ import annotations

from math import comb, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import pieces, small_side, written
from .words import mix, series, shingle_sets

WIDTH = 5  # words in a shingle
PERCENT = 85  # of the union that two linked sets share
TREES = 16
LOSS = 1e-3  # chance that a pair exactly at the threshold shares no node of the last depth
SMALL = 16  # members of a node that is compared exhaustively
COORDINATES = 128  # minwise tokens of a document
HUB_ROUNDS = 2
WIDE_ROWS = 1000  # rows with a text, a set or tokens in an Arrow batch
BLOCK = 256  # candidates of one document that meet its set in one group
HELD = 1 << 18  # shingles of a block whose sets a task holds, on average
SKIPPED = 1e-6  # chance that a pair exactly at the threshold agrees in too few tokens to be confirmed; 0: all are confirmed

_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
_MULTIPLIERS = series(COORDINATES, 7)
_PATHS = [np.argsort(series(COORDINATES, 11 + t)).tolist() for t in range(TREES)]


def depths(percent: int, loss: float = LOSS) -> tuple[int, int]:
    """Tokens that the members of a node share, at the first and at the last level; 0 where only a node of all members loses no more than loss."""
    share = 1 - loss ** (1 / TREES)  # chance of a meeting in one tree that gives the recall in all
    last = max(0, floor(log(share) / log(percent / 100))) if percent < 100 else COORDINATES // 2
    return -(-last // 2), last


def least_shared(percent: int, skipped: float = SKIPPED) -> int:
    """The most tokens that a pair at the threshold agrees in with a chance of at least 1 - skipped."""
    p, below, k = percent / 100, 0.0, 0
    while k < COORDINATES and (below := below + comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) <= skipped:
        k += 1
    return k


def _sums(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, of the sets one after another and their sizes; 0 for empty ones."""
    full = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        out[0, full] = np.add.reduceat(sets, first)
        out[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def _sketches(batches):
    for batch in pieces(batches, "text"):
        blobs = [(t or "").encode() for t in batch.column("text").to_pylist()]
        sets, sizes = shingle_sets(blobs, WIDTH)
        full = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[full]
        set_a, set_b = _sums(sets, sizes)
        tokens = np.zeros((len(blobs), COORDINATES), "<u4")
        if len(full):
            for j, m in enumerate(_MULTIPLIERS):
                tokens[full, j] = np.minimum.reduceat(sets * m, first) >> np.uint64(32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(blobs) + 1, dtype=np.int32) * COORDINATES), pa.array(tokens.view(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(set_a), pa.array(set_b), lists], names=_SKETCH.names)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, tokens): the size and 128-bit sum of a document's set, and its minwise tokens."""
    return docs.select("doc_id", "text").mapInArrow(_sketches, _SKETCH)


def _nodes(rows: DataFrame, depth: int) -> DataFrame:
    """(tree, node, doc) of each (doc, tokens) in all trees, or in those that a column trees lists; the node is a hash of the first tokens on the tree's path."""
    node = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *(F.get("tokens", F.lit(k)) for k in _PATHS[t][:depth])).alias("node"))
    each = F.array(*map(node, range(TREES)))
    if "trees" in rows.columns:
        each = F.filter(each, lambda x: F.array_contains("trees", x["tree"]))
    return rows.select("doc", F.explode(each).alias("at")).select("at.tree", "at.node", "doc")


def _tokens(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, COORDINATES)


def _agreeing(pairs: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that share at least so many tokens."""

    def shared(batches):
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                agree = (_tokens(part.column("x")) == _tokens(part.column("y"))).sum(1)
                yield part.select(["a", "b"]).filter(pa.array(agree >= least))

    sides = pairs.join(tokens.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(shared, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """(doc, n, hashes): the full shingle set of each class (doc, doc_id, n_shingles, set_a, set_b), from a row with that doc_id and set."""

    def of(batches):
        for batch in pieces(batches, "text"):
            values, sizes = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], WIDTH)
            first, second = _sums(values, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first), pa.array(second), pa.array([x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "hashes"])

    classes = written(classes)
    count = classes.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(classes.select("doc_id").distinct() if repeated else classes.select("doc_id"), count), "doc_id", "left_semi")
    found = texts.mapInArrow(of, "doc_id long, n_shingles long, set_a long, set_b long, hashes binary").join(small_side(classes, count), ["doc_id", "n_shingles", "set_a", "set_b"])
    found = found.select("doc", F.col("n_shingles").alias("n"), "hashes")
    return written(found.dropDuplicates(["doc"]) if repeated else found, WIDE_ROWS)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least percent of their union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least percent of their union.

    The candidates of one a are dealt to blocks. In each block its set comes once, before the sets of the block's
    candidates, so a task holds one set at a time.
    """

    def compare(batches):
        own = None
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (b, hashes) in enumerate(zip(batch.column("b"), batch.column("hashes"), strict=True)):
                values = np.frombuffer(hashes.as_buffer(), np.uint64)
                if b.is_valid:
                    kept[i] = _alike(own, values, percent)
                else:
                    own = values.copy()
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = written(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block")))
    first = placed.select("a", "block").distinct().join(sets.select(F.col("doc").alias("a"), "hashes"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "hashes")
    rest = placed.join(sets.select(F.col("doc").alias("b"), "hashes"), "b").select("a", "block", "b", "hashes")
    rows = first.union(rest).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return written(rows.select("a", "b", "hashes").mapInArrow(compare, "a long, b long"), WIDE_ROWS)


def _mixed(members: DataFrame, state: DataFrame) -> DataFrame:
    """The members of nodes that hold several components, with their component."""
    placed = written(members.join(state.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    mixed = written(placed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("node"))
    return written(placed.join(small_side(mixed, mixed.count()), "node"))


def _hub_pairs(large: DataFrame, turn: int) -> DataFrame:
    """Pairs of each member with a few hubs of its node in other components: the member that is in the largest nodes, and two by hash."""
    weight = large.groupBy("doc").agg(F.sum("members").alias("weight"))
    one = F.struct("doc", "component")
    hubs = written(large.join(weight, "doc").groupBy("node").agg(F.array(F.max_by(one, F.struct("weight", "doc")), F.max_by(one, F.xxhash64("doc", F.lit(turn))), F.min_by(one, F.xxhash64("doc", F.lit(turn)))).alias("hubs")))
    pairs = large.join(small_side(hubs, hubs.count()), "node").select("doc", "component", F.explode("hubs").alias("hub")).where("component <> hub.component")
    return pairs.select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")).distinct()


def _across(large: DataFrame, tokens: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """The links (a, b) of members outside their node's largest component with members of its other components.

    The outer members of a node are dealt to blocks of about HELD shingles. Each block meets each block of all members in a
    group of its own: the task holds the outer ones while the others stream past, and only links leave it. A pair that
    meets in several nodes is confirmed in the first of them.
    """
    main = large.groupBy("node", "component").agg(F.count("*").alias("count")).groupBy("node").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    main = written(main)
    rows = large.join(small_side(main, main.count()), "node").withColumn("outer", F.col("component") != F.col("main")).join(sets.select("doc", "n"), "doc")
    blocks = written(rows.groupBy("node").agg(F.ceil(F.sum(F.when(F.col("outer"), F.col("n"))) / HELD).alias("outers"), F.ceil(F.sum("n") / (8 * HELD)).alias("alls")))
    rows = rows.join(small_side(blocks, blocks.count()), "node").select("node", "doc", "component", "outer", "outers", "alls")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    held = rows.where("outer").select("node", own("outers").alias("x"), every("alls").alias("y"), F.lit(0).alias("side"), "doc", "component", "outer")
    passing = rows.select("node", every("outers").alias("x"), own("alls").alias("y"), F.lit(1).alias("side"), "doc", "component", "outer")
    places = large.groupBy("doc").agg(F.array(*(F.coalesce(F.max(F.when(F.col("tree") == t, F.col("node"))), F.lit(0)) for t in range(TREES))).alias("places"))
    dealt = held.union(passing).join(places, "doc").join(tokens, "doc").join(sets.select("doc", "hashes"), "doc")
    dealt = dealt.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y", "side")

    def compare(batches):
        group, block, stacked = None, [], None
        for batch in batches:
            links = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("node", "x", "y")), strict=True))
            side, doc, component, outer = (batch.column(c).to_pylist() for c in ("side", "doc", "component", "outer"))
            found, places, hashes = _tokens(batch.column("tokens")), batch.column("places").flatten().to_numpy().reshape(-1, TREES), batch.column("hashes")
            for i, key in enumerate(keys):
                if key != group:
                    group, block, stacked = key, [], None
                values = np.frombuffer(hashes[i].as_buffer(), np.uint64)
                if side[i] == 0:
                    block.append((doc[i], component[i], found[i].copy(), places[i].copy(), values.copy()))
                    continue
                if not block:
                    continue
                stacked = stacked or (np.array([x[0] for x in block]), np.array([x[1] for x in block]), np.stack([x[2] for x in block]), np.stack([x[3] for x in block]))
                docs, components_, tokens_, places_ = stacked
                fit = (components_ != component[i]) & ((tokens_ == found[i]).sum(1) >= least)
                if outer[i]:  # both are outer: once is enough
                    fit &= docs < doc[i]
                for j in np.flatnonzero(fit):
                    same = (places_[j] == places[i]) & (places[i] != 0)
                    if places[i][same.argmax()] == key[0] and _alike(block[j][4], values, percent):
                        links.append(sorted((block[j][0], doc[i])))
            yield pa.RecordBatch.from_arrays([pa.array([k[s] for k in links], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, loss: float = LOSS, skipped: float = SKIPPED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach (itself included); kept says that it is the row's own.
    Null or blank texts have n_shingles 0 and no links; so have rows without a doc_id, whose component_id is
    null and which are kept. Rows that repeat a doc_id are each returned with one component: what any of its texts is
    linked with. Other columns are ignored. loss and skipped are the chances that a pair exactly at the threshold is missed
    by the trees and by the tokens; pairs above it are missed less. With both at 0 all pairs are compared.
    """
    first, last = depths(percent, loss)
    least = least_shared(percent, skipped)
    sketches = written(sketch(docs), WIDE_ROWS)
    whole = sketches.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set_a", "set_b"]
    classes = written(whole.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens")).withColumn("doc", F.monotonically_increasing_id()))
    tokens = classes.select("doc", "tokens")
    again = written(sketches.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    repeated = not again.isEmpty()

    level, nodes = _nodes(tokens, first), []
    for depth in (first, last):
        sizes = written(level.groupBy("node").agg(F.count("*").alias("members"), F.min("doc").alias("pivot")).where("members > 1"))
        nodes.append(written(level.join(small_side(sizes, sizes.count()), "node").withColumn("last", F.lit(depth == last))))
        branching = nodes[-1].where(F.col("members") > SMALL)
        if depth == last or branching.isEmpty():
            break
        level = _nodes(branching.groupBy("doc").agg(F.collect_set("tree").alias("trees")).join(tokens, "doc"), last)
    members = nodes[0].union(nodes[-1]) if len(nodes) > 1 else nodes[0]
    sets = _sets(docs, classes.drop("tokens").join(nodes[0].select("doc").distinct(), "doc", "left_semi"), repeated)

    stars = members.where("pivot <> doc").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    links = _confirmed(written(_agreeing(stars, tokens, least), WIDE_ROWS), sets, percent)
    if repeated:  # classes that share an id are one component
        rows = written(whole.join(small_side(again, again.count()), "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.select(*key, "doc"), key))
        lowest = rows.groupBy("doc_id").agg(F.min("doc").alias("a"))
        links = written(links.union(rows.join(lowest, "doc_id").where("a < doc").select("a", F.col("doc").alias("b")).distinct()))
    state = written(components(links))

    for turn in range(HUB_ROUNDS):
        large = _mixed(members.where((F.col("members") > SMALL) & F.col("last")), state)
        if large.isEmpty():
            break
        links = written(links.union(_confirmed(written(_agreeing(_hub_pairs(large, turn), tokens, least), WIDE_ROWS), sets, percent)))
        state = written(components(links))

    placed = _mixed(members.where((F.col("members") <= SMALL) | F.col("last")), state)
    small = placed.where(F.col("members") <= SMALL).select("node", "doc", "component")
    rest = small.alias("p").join(small.alias("q"), "node").where("p.doc < q.doc and p.component <> q.component").select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"))
    more = _confirmed(written(_agreeing(rest.distinct(), tokens, least), WIDE_ROWS), sets, percent)
    large = placed.where(F.col("members") > SMALL)
    if not large.isEmpty():
        more = written(more.union(_across(large, tokens, sets, percent, least)), WIDE_ROWS)
    if not more.isEmpty():
        state = written(components(links.union(more)))

    placed = classes.select(*key, "doc_id", "doc").join(state.withColumnRenamed("id", "doc"), "doc", "left")
    joined = placed.where("component is not null")
    smallest = written(joined.groupBy("component").agg(F.min("doc_id").alias("found")))
    grouped = joined.join(small_side(smallest, smallest.count()), "component").select(*key, "found").union(placed.where("component is null").select(*key, F.col("doc_id").alias("found")))
    out = sketches.drop("tokens").join(grouped, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    if repeated:  # the rows of an id have its smallest component, also those with empty texts
        own = written(out.where("doc_id is not null").select("doc_id", "found").join(small_side(again, again.count()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("found").alias("lowest")))
        out = out.join(small_side(own, own.count()), "doc_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "found", "doc_id"))
    return out.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
