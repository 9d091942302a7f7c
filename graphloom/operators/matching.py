"""Matching: sources with donors, requirements with components, points with their neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SMALL, bucket, uniform
from ..sources.corpora import saved, spread
from .cuts import cut_edges, cut_index, edge_contexts, pair_hash, shared_nodes, virtual_cut
from .proposals import node_sets
from .ranking import numbered


def rewrite_pairs(index: DataFrame) -> DataFrame:
    """(cut_key, n_source, n_donor, n_pairs): sources are even graphs, donors odd ones; a pair has equal keys and different subgraphs.

    Frequencies of distinct subgraphs are multiplied, so that no pair is ever formed.
    """
    side = lambda parity, name: index.where(F.col("graph_id") % 2 == parity).groupBy("cut_key", "assoc_hash").agg(F.count("*").alias(name))
    both = side(0, "s").join(side(1, "d"), ["cut_key", "assoc_hash"], "full").na.fill(0, ["s", "d"])
    out = both.groupBy("cut_key").agg(F.sum("s").alias("n_source"), F.sum("d").alias("n_donor"), F.sum(F.col("s") * F.col("d")).alias("same"))
    return out.where("n_source > 0 and n_donor > 0").select("cut_key", "n_source", "n_donor", (F.col("n_source") * F.col("n_donor") - F.col("same")).alias("n_pairs"))


def effective_sources(index: DataFrame) -> DataFrame:
    """(cut_key, n_source, n_same): the sources of each signature that have a donor of another hash, and those of them whose own hash donors offer as well (exchanges with those would change nothing)."""
    donors = index.where("graph_id % 2 = 1").groupBy("cut_key", "assoc_hash").agg(F.count("*").alias("d"))
    kinds = donors.groupBy("cut_key").agg(F.count("*").alias("kinds"))
    sources = index.where("graph_id % 2 = 0").groupBy("cut_key", "assoc_hash").agg(F.count("*").alias("s"))
    both = sources.join(kinds, "cut_key").join(donors, ["cut_key", "assoc_hash"], "left").where("kinds > if(d is null, 0, 1)")
    return both.groupBy("cut_key").agg(F.sum("s").alias("n_source"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("s"))), F.lit(0)).alias("n_same"))


def components(edges: DataFrame) -> DataFrame:
    """(graph_id, inode, img_type, deg): each subgraph's hash and how many others share nodes with it."""
    return pair_hash(edge_contexts(edges)).select("graph_id", "inode", F.col("assoc_hash").alias("img_type"), F.size("near").cast("long").alias("deg"))


def buckets(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("img_type", "deg").agg(F.count("*").alias("n_components"))


def port_types(edges: DataFrame) -> DataFrame:
    """(graph_id, i, j, type, cnt): for each neighbour j of subgraph i, the labels of the nodes they share."""
    ports = edge_contexts(edges).select("graph_id", F.col("inode").alias("i"), F.explode("near").alias("x"))
    counted = F.transform(F.array_distinct("x.types"), lambda t: F.struct(t.alias("type"), F.size(F.filter("x.types", lambda y: y.eqNullSafe(t))).cast("long").alias("cnt")))
    return ports.select("graph_id", "i", "x.j", F.explode(counted).alias("t")).select("graph_id", "i", "j", "t.type", "t.cnt")


def ports(edges: DataFrame) -> DataFrame:
    """(img_type, port, n): how often a subgraph type has a port of a given multiset of labels."""
    each = pair_hash(edge_contexts(edges)).select(F.col("assoc_hash").alias("img_type"), F.explode("near").alias("x"))
    counted = F.transform(F.array_distinct("x.types"), lambda t: F.concat_ws("x", t, F.size(F.filter("x.types", lambda y: y.eqNullSafe(t))).cast("string")))
    return each.select("img_type", F.array_join(F.array_sort(counted), ",").alias("port")).groupBy("img_type", "port").agg(F.count("*").alias("n"))


def containing_ports(edges: DataFrame, required: dict[str, int]) -> DataFrame:
    """(graph_id, i, j): ports that hold every required label at least as often as required (relational division)."""
    need = F.create_map(*(x for k, v in required.items() for x in (F.lit(k), F.lit(v))))
    met = port_types(edges).withColumn("need", need[F.col("type")]).where("cnt >= need")
    return met.groupBy("graph_id", "i", "j").agg(F.count("*").alias("met")).where(F.col("met") == len(required)).select("graph_id", "i", "j")


def injective_matches(edges: DataFrame, requirements: list[dict[str, int]]) -> DataFrame:
    """(graph_id, i, ports): for subgraphs that meet all requirements by different ports, the first such ports in order.

    A requirement is labels with how often a port must hold them at least. Larger requirements (labels in all, then kinds of
    them) are matched first, as in ports; of several ways the one with the smallest neighbours wins. The work is bounded by the
    neighbours of one subgraph to the power of the number of requirements, of which there may be three.
    """
    if not 1 <= len(requirements) <= 3:
        raise ValueError("from one to three requirements")
    wanted = sorted(requirements, key=lambda r: (-sum(r.values()), -len(r), sorted(r.items())))

    def able(need: dict[str, int]):
        def holds(x):
            met = F.lit(True)
            for label, n in sorted(need.items()):
                met &= F.size(x["types"]) - F.size(F.array_remove(x["types"], label)) >= n
            return met

        return F.transform(F.filter("near", holds), lambda x: x["j"])

    def extended(ways, more):
        return F.flatten(F.transform(ways, lambda w: F.transform(F.filter(more, lambda j: ~F.array_contains(w, j)), lambda j: F.concat(w, F.array(j)))))

    ways = F.transform(able(wanted[0]), lambda j: F.array(j))
    for need in wanted[1:]:
        ways = extended(ways, able(need))
    found = edge_contexts(edges).select("graph_id", F.col("inode").alias("i"), F.array_min(ways).alias("ports")).where("ports is not null")
    return found.select("graph_id", "i", F.array_join(F.transform("ports", lambda j: j.cast("string")), ",").alias("ports"))


def inverted_candidates(edges: DataFrame) -> DataFrame:
    """(type, mult, n_candidates): subgraphs that have a label at least mult times on some port."""
    held = port_types(edges).select("graph_id", "i", "type", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))).alias("mult")).distinct()
    return held.groupBy("type", "mult").agg(F.count("*").alias("n_candidates"))


def port_profiles(parts: DataFrame) -> DataFrame:
    """(graph_id, inode, profile, ports): the different label multisets of a subgraph's ports, and their text; parts has edge_contexts' columns."""
    counted = lambda types: F.array_sort(F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda y: y.eqNullSafe(t))).alias("cnt"))))
    each = parts.where(F.size("near") > 0).select("graph_id", "inode", F.array_sort(F.array_distinct(F.transform("near", lambda x: counted(x["types"])))).alias("ports"))
    return each.select("graph_id", "inode", F.to_json("ports").alias("profile"), "ports")


def retrieved(asked: DataFrame, held: DataFrame, chain: int = 3) -> DataFrame:
    """(profile, holder): which profiles of held meet every requirement of a profile of asked, each on some port.

    Both have (profile, ports: arrays of (type, cnt)), a row a profile. A port meets a requirement that it holds each label of at
    least as often. Postings say which holders have a label how often on some port. Of each requirement the rarest posting
    counts; the rarest of a profile gives its candidates, the next ones (chain in all) filter them by semi-joins, and what is left is
    checked exactly.
    """
    held = held.select(F.col("profile").alias("holder"), F.col("ports").alias("has"))
    times = lambda x: F.transform(F.sequence(F.lit(1), x["cnt"]), lambda m: F.struct(x["type"].alias("type"), m.alias("mult")))
    flat = F.array_distinct(F.flatten(F.transform("has", lambda p: F.flatten(F.transform(p, times)))))
    postings = saved(held.select("holder", F.explode(flat).alias("k")).select("k.*", "holder"))
    frequency = postings.groupBy("type", "mult").agg(F.count("*").alias("f"))
    need = asked.select("profile", F.posexplode("ports").alias("req", "p")).select("profile", "req", F.explode("p").alias("x")).select("profile", "req", F.col("x.type").alias("type"), F.col("x.cnt").alias("mult"))
    rarest = need.join(frequency, ["type", "mult"], "left").na.fill(0, ["f"]).groupBy("profile", "req").agg(F.min(F.struct("f", "type", "mult")).alias("r"))
    keys = rarest.groupBy("profile").agg(F.array_sort(F.collect_set("r")).alias("keys")).where(F.get("keys", F.lit(0))["f"] > 0)
    key = lambda i: [F.get("keys", F.lit(i))[c].alias(c) for c in ("type", "mult")]
    found = saved(keys.select("profile", "keys", *key(0)).join(postings, ["type", "mult"]).select("profile", "keys", "holder"))
    for i in range(1, chain):
        more = found.select("*", *key(i))
        found = more.where("mult is null").select(found.columns).union(more.where("mult is not null").join(postings, ["type", "mult", "holder"], "left_semi").select(found.columns))
    both = found.drop("keys").join(asked, "profile").join(held, "holder")
    enough = lambda port, x: F.exists(port, lambda y: y["type"].eqNullSafe(x["type"]) & (y["cnt"] >= x["cnt"]))
    met = F.forall("ports", lambda p: F.exists("has", lambda port: F.forall(p, lambda x: enough(port, x))))
    return both.where(met).select("profile", "holder")


def retrieval_counts(sources: DataFrame, donors: DataFrame) -> DataFrame:
    """(graph_id, inode, n_candidates): for each source the donors that meet all its ports; sources and donors have edge_contexts' columns.

    Subgraphs with equal profiles are alike, so profiles are matched with profiles and counted; no pair of subgraphs is formed.
    Sources without ports ask for nothing and get no row.
    """
    return profile_counts(saved(port_profiles(sources)), saved(port_profiles(donors)))


def profile_counts(own: DataFrame, other: DataFrame) -> DataFrame:
    """retrieval_counts of sources and donors whose port_profiles are written already."""
    kinds = lambda df: saved(df.groupBy("profile").agg(F.first("ports").alias("ports"), F.count("*").alias("n")))
    held = kinds(other)
    pairs = retrieved(kinds(own).drop("n"), held.drop("n"))
    counts = pairs.join(held.select(F.col("profile").alias("holder"), "n"), "holder").groupBy("profile").agg(F.sum("n").alias("n_candidates"))
    return own.join(counts, "profile").select("graph_id", "inode", "n_candidates")


def transitions(edges: DataFrame, most: int = 256, small: int = SMALL) -> DataFrame:
    """(prev, role, next, n, rank): which subgraph type follows another over a shared label, the most frequent ones by (prev, role)."""
    each = edge_contexts(edges.where("graph_id is not null"), small, hashed=True).select(F.col("assoc_hash").alias("prev"), F.explode("near").alias("x"))
    steps = each.select("prev", F.explode(F.array_distinct("x.types")).alias("role"), F.col("x.assoc_hash").alias("next"))
    counted = steps.groupBy("prev", "role", "next").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("prev", "role").orderBy(F.desc("n"), "next"))).where(F.col("rank") <= most)


def image_edge_violations(edges: DataFrame, expected: int = 1) -> DataFrame:
    """(graph_id, n_violations): neighbouring subgraphs that share another number of nodes than expected."""
    return shared_nodes(edges).where((F.col("i") < F.col("j")) & (F.col("shared") != expected)).groupBy("graph_id").agg(F.count("*").alias("n_violations"))


def virtual_matches(nodes: DataFrame, edges: DataFrame, seed: str = "21") -> DataFrame:
    """(graph_id, a, b, cut_key, n_donors, donor_graph, donor_inode): a donor for pairs of nodes of even graphs at which something could be hung.

    The labels of the pair are a virtual cut's key; donors are subgraphs of odd graphs with that key. Each pair draws one of
    the entries in seeded order, so a subgraph that occurs more often is drawn more often.
    """
    known = virtual_cut(edges).where("graph_id % 2 = 1 and cut_size = 2").select("cut_key", "graph_id", "inode")
    number = F.row_number().over(W.partitionBy("cut_key").orderBy("graph_id", "inode")).cast("long")
    donors = known.select("cut_key", F.col("graph_id").alias("donor_graph"), F.col("inode").alias("donor_inode"), number.alias("draw"))
    counts = known.groupBy("cut_key").agg(F.count("*").alias("n_donors"))
    sets = node_sets(nodes.where("graph_id % 2 = 0"), 2)
    pairs = sets.select("graph_id", F.get("members", F.lit(0)).alias("a"), F.get("members", F.lit(1)).alias("b"), F.col("key").alias("cut_key")).join(counts, "cut_key")
    u = uniform(F.concat_ws("|", F.lit(seed), F.col("graph_id").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")))
    return pairs.withColumn("draw", F.floor(u * F.col("n_donors")) + 1).join(donors, ["cut_key", "draw"]).select("graph_id", "a", "b", "cut_key", "n_donors", "donor_graph", "donor_inode")


def anchor_matches(edges: DataFrame) -> DataFrame:
    """(cut_key, n): boundary signatures of sources that some donor offers as well (semi-join), and how many sources have them."""
    index = cut_index(edges)
    donors = index.where("graph_id % 2 = 1").select("cut_key").distinct()
    return index.where("graph_id % 2 = 0").join(donors, "cut_key", "left_semi").groupBy("cut_key").agg(F.count("*").alias("n"))


def anchor_mapping(anchors: DataFrame, nodes: DataFrame, assigned: DataFrame, seed: str = "0", whole: bool = False) -> DataFrame:
    """(graph_id, inode, inner, outer, mapped, n_covered): for each subgraph a random injective mapping of its anchors to nodes of a target graph.

    anchors: (graph_id, inode, inner, outer, type, target); nodes: (graph_id, node_id, type); assigned: (graph_id, subgraph, node_id) of the target's
    neighbours that a mapping has to touch, at least one of them, or each if whole. Anchors go to nodes of their own type; a subgraph is left out
    if a type has too few nodes, or its mapping doesn't cover. Nodes of a type stand in one seeded order, which each subgraph enters at
    a place of its own, so an anchor meets one node only.
    """
    typed = W.partitionBy("graph_id", "type")
    order = typed.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "graph_id", "node_id")), "node_id")
    placed = nodes.select(F.col("graph_id").alias("target"), "type", F.col("node_id").alias("mapped"), (F.row_number().over(order) - 1).alias("place"), F.count("*").over(typed).alias("n"))
    own = W.partitionBy("graph_id", "inode")
    asked = anchors.withColumn("k", F.row_number().over(W.partitionBy("graph_id", "inode", "type").orderBy("inner", "outer")) - 1).withColumn("n_anchors", F.count("*").over(own))
    sizes = placed.where("place = 0").select("target", "type", "n")
    entered = asked.join(sizes, ["target", "type"]).where("k < n").withColumn("place", (F.col("k") + bucket(F.concat_ws("|", F.lit(seed), "graph_id", "inode", "type"), 31)) % F.col("n"))
    found = saved(entered.drop("n").join(placed.drop("n"), ["target", "type", "place"]).withColumn("n_mapped", F.count("*").over(own)).where("n_mapped = n_anchors").select("graph_id", "inode", "target", "inner", "outer", "mapped"))
    wanted = assigned.select(F.col("graph_id").alias("target"), "subgraph", F.col("node_id").alias("mapped"))
    covered = found.join(wanted, ["target", "mapped"]).groupBy("graph_id", "inode", "target").agg(F.countDistinct("subgraph").alias("n_covered"))
    if whole:
        covered = covered.join(wanted.groupBy("target").agg(F.countDistinct("subgraph").alias("n_covered")), ["target", "n_covered"], "left_semi")
    return found.join(covered.drop("target"), ["graph_id", "inode"]).select("graph_id", "inode", "inner", "outer", "mapped", "n_covered")


def next_graph_mapping(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """anchor_mapping of the subgraphs of even graphs to the graph that follows: anchors are boundary edges, a type is the outer end's label, and edges are to be touched."""
    anchors = cut_edges(edges.where("graph_id % 2 = 0")).select("graph_id", "inode", "inner", "outer", F.substring_index("ekey", "|", -1).alias("type"), (F.col("graph_id") + 1).alias("target"))
    other = edges.where("graph_id % 2 = 1").select("graph_id", F.concat_ws("|", "src", "dst", "label").alias("subgraph"), F.explode(F.array("src", "dst")).alias("node_id"))
    return anchor_mapping(anchors, nodes.where("graph_id % 2 = 1").select("graph_id", "node_id", F.col("label").alias("type")), other)


BLOCK = 8192  # left points that a task holds while all right points stream past them
DIFFERENCES = 2**21  # that are held at a time


CELLS = 64  # tasks among which the pairs of two sets of points are dealt


def met(left: DataFrame, right: DataFrame, block: int, by: str | None = None) -> DataFrame:
    """Rows of left (side 0) and of right (side 1), by cell and left first, for a fold over the rows of a partition.

    A cell is a block of left points and a share of the right ones, and each pair meets in one cell. Left points are sent once to each share and right
    points once to each block; there are as many of both as send fewest rows. With by, the rows of a cell stand by its values, which meet only themselves.
    """
    n, m = left.count(), right.count()
    fewest = max(1, -(-n // block))
    dealt = lambda blocks: (blocks, max(1, min(-(-CELLS // blocks), -(-m // 64))))
    blocks, shares = min((dealt(b) for b in range(fewest, max(fewest, min(CELLS, -(-n // 64))) + 1)), key=lambda d: n * d[1] + m * d[0])
    at = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = left.withColumn("b", at(blocks)).withColumn("s", every(shares)).withColumn("side", F.lit(0))
    other = right.withColumn("b", every(blocks)).withColumn("s", at(shares)).withColumn("side", F.lit(1))
    order = ["cell", by, "side"] if by else ["cell", "side"]
    rows = own.unionByName(other).withColumn("cell", F.col("b") * shares + F.col("s")).drop("b", "s")
    return rows.repartitionById(blocks * shares, "cell").sortWithinPartitions(*order)


def sides(batches, *key: str):
    """The runs of rows of one key and side in batches, as (key, side, rows)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "side")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
            yield tuple(c[start] for c in columns[:-1]), columns[-1][start], batch.slice(start, end - start)


def vectors(rows) -> np.ndarray:
    return rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def pair_distances(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distances of x[p] and y[q], from their differences."""
    step = max(1, DIFFERENCES // max(1, x.shape[1]))
    parts = [np.sqrt(((x[p[s : s + step]] - y[q[s : s + step]]) ** 2).sum(-1)) for s in range(0, len(p), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances by one product of matrices, and a bound of their error; infinite where numbers are too large or missing for that."""
    with np.errstate(all="ignore"):
        u, v = (x * x).sum(1), (y * y).sum(1)
        error = 1e-13 * max(x.shape[1], 10) * (u.max(initial=0) + v.max(initial=0))
        return u[:, None] + v[None] - 2 * (x @ y.T), error if np.isfinite(error) else np.inf


class Lists:
    """The k nearest right points of each left point so far: by distance rounded to places, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, places: int, group: np.ndarray | None):
        self.ids, self.x, self.k, self.places, self.group = ids, x, k, places, group
        self.row, self.j, self.d, self.other = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.most = np.full(len(ids), np.inf)  # the k-th distance

    def meet(self, j: np.ndarray, y: np.ndarray, group: np.ndarray | None) -> None:
        """With groups, only points of other groups at a distance above 0 count."""
        for width in range(0, len(j), 8192):
            b = slice(width, width + 8192)
            step = max(1, DIFFERENCES // len(j[b]))
            for start in range(0, len(self.ids), step):
                self._meet(slice(start, start + step), j[b], y[b], None if group is None else group[b])

    def _meet(self, a: slice, j: np.ndarray, y: np.ndarray, group: np.ndarray | None) -> None:
        x, loose = self.x[a], 2 * 10.0**-self.places
        d2, error = squares(x, y)
        closed = self.ids[a][:, None] == j[None] if group is None else self.group[a][:, None] == group[None]
        if not np.isfinite(error):  # every pair by its differences
            p, q = np.nonzero(~closed)
            d2 = np.full(closed.shape, np.inf)
            with np.errstate(all="ignore"):
                d = pair_distances(x, y, p, q)
                d2[p, q] = np.where(np.isfinite(d), d, np.inf) ** 2
            error = 0.0 if np.isfinite(d).all() else 1e-9
            d2[np.isinf(d2)] = 1e308
        d2[closed] = np.inf
        if group is not None:
            p, q = np.nonzero(d2 <= 4 * 10.0 ** (-2 * self.places) + error)
            same = np.round(pair_distances(x, y, p, q), self.places) == 0
            d2[p[same], q[same]] = np.inf
        bound = lambda d: (d + loose) ** 2 + error
        near = (d2 <= bound(self.most[a])[:, None]) & (d2 < np.inf)
        if near.sum() > 4 * self.k * len(x) and d2.shape[1] > self.k:
            last = np.partition(d2, self.k - 1, axis=1)[:, self.k - 1]
            near &= d2 <= bound(np.sqrt(np.maximum(last, 0) + error))[:, None]
        p, q = np.nonzero(near)
        with np.errstate(all="ignore"):
            d = pair_distances(x, y, p, q)
        keep = np.isfinite(d)
        self._add(p[keep] + a.start, j[q[keep]], d[keep], np.zeros(keep.sum(), np.int64) if group is None else group[q[keep]])

    def _add(self, row, j, d, other) -> None:
        if not len(row):
            return
        old = np.isin(self.row, row)
        rows, js, ds, others = (np.concatenate([v[old], w]) for v, w in ((self.row, row), (self.j, j), (self.d, d), (self.other, other)))
        order = np.lexsort((js, np.round(ds, self.places), rows))
        rows, js, ds, others = (v[order] for v in (rows, js, ds, others))
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        self.most[rows[place == self.k - 1]] = ds[place == self.k - 1]
        kept = place < self.k
        self.row, self.j, self.d, self.other = (np.concatenate([v[~old], w[kept]]) for v, w in ((self.row, rows), (self.j, js), (self.d, ds), (self.other, others)))

    def found(self) -> pa.RecordBatch:
        group = np.zeros(len(self.row), np.int64) if self.group is None else self.group[self.row]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.ids[self.row], group, self.j, self.other, self.d)], names=["i", "a", "j", "b", "d"])


def nearest_lists(left: DataFrame, right: DataFrame, k: int, places: int = 9, block: int = BLOCK) -> DataFrame:
    """(i, a, j, b, d): for each left point the k nearest right points (id, x) of each share of them, ties by d rounded to places to smaller ids; none of the same id.

    The k nearest of all are among them. If both have c, a group, then points of other groups at a rounded distance above 0 (a and b name the groups). A product of matrices says which
    points can be among the nearest, up to a bound of its error; distances are those of their differences.
    """
    grouped = "c" in left.columns

    def near(batches):
        key = lists = None
        for at, side, rows in sides(batches, "cell"):
            ids, x = rows.column("id").to_numpy(), vectors(rows)
            group = rows.column("c").to_numpy() if grouped else None
            if side == 0:
                if at == key:  # a block may come in several batches
                    ids, x = np.concatenate([lists.ids, ids]), np.concatenate([lists.x, x])
                    group = np.concatenate([lists.group, group]) if grouped else None
                elif lists is not None:
                    yield lists.found()
                key, lists = at, Lists(ids, x, k, places, group)
            elif at == key:
                lists.meet(ids, x, group)
        if lists is not None:
            yield lists.found()

    columns = ["id", "x", "c"] if grouped else ["id", "x"]
    usable = lambda df: df.where("id is not null and x is not null").select(*columns)
    return met(usable(left), usable(right), block).mapInArrow(near, "i long, a long, j long, b long, d double")


def nearest(points: DataFrame, k: int = 5, block: int = BLOCK, others: DataFrame | None = None) -> DataFrame:
    """(i, j, rank, d): the k nearest other points by Euclidean distance, ties to smaller ids; from points (id, x), among others if given."""
    found = nearest_lists(points.select("id", "x"), (points if others is None else others).select("id", "x"), k, 9, block)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.round("d", 9), "j")))
    return ranked.where(F.col("rank") <= k).select("i", "j", "rank", F.round("d", 6).alias("d"))


def nearest_of_vectors(asked: DataFrame, k: int, others: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, near): for each vector of asked (x; all distinct) the ids of its k nearest among others (id, x), by distance rounded to 9 places and id.

    The k classes of equal vectors that come first by distance and smallest id hold them, and of a class no more than its k smallest ids count.
    """
    asked = saved(saved(asked.select("x")).withColumn("id", -1 - F.monotonically_increasing_id()))
    first = others.withColumn("place", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("place") <= k)
    classes = first.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k
    classes = saved(numbered(classes, F.col("ids")[0], name="id"))
    lists = nearest_lists(asked, classes.select("id", "x"), k, 9, block).select("i", F.col("j").alias("id"), F.round("d", 9).alias("d"))
    each = lists.join(spread(classes.select("id", "ids")), "id").select("i", "d", F.explode("ids").alias("j"))
    near = each.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, k).alias("near"))  # of k^2
    return asked.withColumnRenamed("id", "i").join(spread(near), "i").select("x", F.col("near.j").alias("near"))


def nearest_of_copies(points: DataFrame, k: int, others: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j): the rows of nearest(points, k, block, others), where many points are equal: each distinct vector is searched once, for one more, as a point isn't its own neighbour."""
    left, right = (df.where("id is not null and x is not null").select("id", "x") for df in (points, others))
    own = left.join(spread(nearest_of_vectors(left.select("x").distinct(), k + 1, right, block)), "x")
    return own.select(F.col("id").alias("i"), F.explode(F.slice(F.filter("near", lambda j: j != F.col("id")), 1, k)).alias("j"))


def mutual_nearest(points: DataFrame, k: int = 5) -> DataFrame:
    """(i, j, d), i < j: pairs that are among each other's k nearest."""
    near = saved(nearest(points, k))
    return near.where("i < j").join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi").select("i", "j", "d")


def _sums(x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> tuple[int, float, float]:
    """How many pairs are wanted, the sum of their distances and the largest. Where the product of matrices isn't exact enough, differences are taken."""
    d2, error = squares(x, y)
    p, q = np.nonzero(wanted & ~(d2 > 1e6 * error))
    with np.errstate(all="ignore"):
        d = np.sqrt(np.maximum(d2, 0))
        d[p, q] = pair_distances(x, y, p, q)
    d = d[wanted]
    return len(d), d.sum(), d.max() if len(d) else 0.0


def distances(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, n, mean_d, max_d): all distances between points of one label, i < j.

    Blocks of a label's points meet all its points; pairs with a missing component or of different lengths count without a distance.
    """

    def measured(batches):
        key, held = None, []
        for at, side, rows in sides(batches, "cell", "label"):
            width = rows.column("width").to_numpy()
            part = {w: rows.filter(pa.array(width == w)) for w in np.unique(width)}
            part = {w: (r.column("id").to_numpy(), vectors(r) if w > 0 else np.zeros((r.num_rows, 0))) for w, r in part.items()}
            if side == 0:
                held = [*held, part] if at == key else [part]
                key = at
                continue
            if at != key:
                continue
            n, m, total, most = 0, 0, 0.0, []
            for left in held:
                for w, (i, x) in left.items():
                    for v, (j, y) in part.items():
                        step = max(1, DIFFERENCES // len(j))
                        for s in range(0, len(i), step):
                            wanted = i[s : s + step, None] < j[None]
                            n += int(wanted.sum())
                            if w == v and w >= 0 and wanted.any():
                                count, some, largest = _sums(x[s : s + step], y, wanted)
                                m, total, most = m + count, total + some, [*most, largest]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((at[1], pa.int64()), (n, pa.int64()), (m, pa.int64()), (total, pa.float64()), (np.max(most) if most else None, pa.float64()))], names=["label", "n", "m", "total", "most"])

    whole = F.col("x").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False))
    kind = points.schema["label"].dataType
    each = points.where("label is not null and id is not null").select(F.col("label").cast("long").alias("label"), "id", F.when(whole, F.col("x")).otherwise(F.expr("cast(array() as array<double>)")).alias("x"), F.when(whole, F.size("x")).otherwise(-1).alias("width"))
    found = met(each, each, block, "label").mapInArrow(measured, "label long, n long, m long, total double, most double")
    out = found.groupBy("label").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.max("most").alias("most")).where("n > 0")
    return out.select(F.col("label").cast(kind).alias("label"), "n", F.round(F.col("total") / F.nullif("m", F.lit(0)), 6).alias("mean_d"), F.round("most", 6).alias("max_d"))


def similarity_entropy(near: DataFrame, source: DataFrame) -> DataFrame:
    """(n, entropy, score): how mixed the neighbourhoods of sources and others are, against the mix of all points.

    near has (i, j), source (id, own boolean); the entropy of each neighbourhood's shares, on average, over that of all.
    """
    h = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    share = near.join(source.select(F.col("id").alias("j"), "own"), "j").groupBy("i").agg(F.avg(F.col("own").cast("double")).alias("p"))
    whole = source.agg(h(F.avg(F.col("own").cast("double"))).alias("all"))
    out = share.agg(F.count("*").alias("n"), F.avg(h(F.col("p"))).alias("e")).join(F.broadcast(whole), F.lit(True))
    return out.select("n", F.round("e", 6).alias("entropy"), F.round(F.when(F.col("all") > 0, F.col("e") / F.col("all")).otherwise(0.0), 6).alias("score"))


def closest_to_mean(points: DataFrame) -> DataFrame:
    """(label, id, d): by label, the point nearest to the label's mean vector, ties to smaller ids."""
    each = points.select("label", "id", F.posexplode("x").alias("dim", "v"))
    mean = each.groupBy("label", "dim").agg(F.avg("v").alias("m"))
    d = each.join(mean, ["label", "dim"]).groupBy("label", "id").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) ** 2)).alias("d"))
    best = d.groupBy("label").agg(F.min_by(F.struct("id", "d"), F.struct(F.round("d", 9), "id")).alias("b"))
    return best.select("label", "b.id", F.round("b.d", 6).alias("d"))
