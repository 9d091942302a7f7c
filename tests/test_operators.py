"""Golden facts on literal graphs, and invariants of the operators that SQL doesn't express."""

import hashlib
import math
import random
import shutil
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashing
from graphloom.functions.hashing import wl_hash
from graphloom.operators import contexts, cuts, decompositions, matching, models, optimise, paths, proposals, ranking, repair, rewriting, sampling, statistics, structure, traversal
from graphloom.sources import checkpoints, corpora
from graphloom.sources.corpora import both_ways, validate


def path(spark, n, graph_id=1, labels=None):
    nodes = spark.createDataFrame([(graph_id, i, (labels or "a" * n)[i - 1]) for i in range(1, n + 1)], "graph_id long, node_id int, label string")
    edges = spark.createDataFrame([(graph_id, i, i + 1, "seq", (labels or "a" * n)[i - 1], (labels or "a" * n)[i]) for i in range(1, n)], "graph_id long, src int, dst int, label string, lu string, lv string")
    return nodes, edges


def test_cut_of_path_of_three(spark):
    _, edges = path(spark, 3)
    assert sorted((r["inode"], r["inner"], r["outer"]) for r in cuts.cut_edges(edges).collect()) == [(1, 2, 3), (2, 2, 1)]
    assert {r["cut_size"] for r in cuts.cut_signature(edges).collect()} == {1}


def test_whole_graph_has_the_empty_key(spark):
    _, edges = path(spark, 2)
    assert [(r["cut_size"], r["cut_key"]) for r in cuts.cut_signature(edges).collect()] == [(0, "")]


def test_isomorphic_graphs_have_one_hash(spark):
    n1, e1 = path(spark, 4, 1, "abca")
    n2, e2 = path(spark, 4, 2, "acba")
    found = {r["graph_id"]: r["hash"] for r in wl_hash(n1.union(n2), both_ways(e1.union(e2)), ["graph_id"]).collect()}
    assert found[1] == found[2]
    n3, e3 = path(spark, 4, 3, "aabc")
    assert wl_hash(n3, both_ways(e3), ["graph_id"]).first()["hash"] != found[1]


def test_missing_edges_of_a_path(spark):
    nodes, edges = path(spark, 4)
    assert sorted((r["src"], r["dst"]) for r in rewriting.missing_edges(nodes, edges).collect()) == [(1, 3), (1, 4), (2, 4)]


def test_missing_edges_of_a_large_graph(spark):
    nodes, edges = path(spark, 40)
    found = {(r["src"], r["dst"]) for r in rewriting.missing_edges(nodes, edges).collect()}
    assert found == {(i, j) for i in range(1, 41) for j in range(i + 2, 41)}
    assert rewriting.edge_neighbours(nodes, edges).count() == 1 and rewriting.beam_step(nodes, edges).count() == 3


def test_components_and_distances(spark):
    nodes, edges = path(spark, 5)
    cut = edges.where("src <> 3")
    assert {r["node_id"]: r["component"] for r in paths.component_labels(nodes, cut).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    weighted = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.5), (0, 2, 2.0), (2, 3, 0.0)], "src long, dst long, w double")
    assert {r["id"]: r["dist"] for r in paths.shortest_distances(weighted, 0).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}


def test_long_paths_are_followed_to_their_end(spark):
    nodes, edges = path(spark, 90)
    assert {r["component"] for r in paths.component_labels(nodes, edges).collect()} == {1}
    nodes, edges = nodes.where("node_id <= 25"), edges.where("dst <= 25")
    assert {r["node_id"]: r["level"] for r in paths.hops(nodes, edges).collect()} == {i: abs(i - 2) for i in range(1, 26)}


def test_spanning_tree(spark):
    d = [[0, 1, 2, 3, 4], [1, 0, 1.5, 2.5, 3.5], [2, 1.5, 0, 1, 2], [3, 2.5, 1, 0, 1], [4, 3.5, 2, 1, 0]]
    edges = spark.createDataFrame([(i, j, float(d[i][j])) for i in range(5) for j in range(i + 1, 5)], "src long, dst long, w double")
    assert sorted((r["src"], r["dst"]) for r in paths.spanning_tree(edges).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_allocation_uses_up_the_total(spark):
    weights = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "key string, weight long")
    assert {r["key"]: r["n"] for r in statistics.allocated(weights, 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_power_law_finds_its_own_curve(spark):
    points = spark.createDataFrame([("x", n, 1.0 - 0.5 * n**-0.7) for n in (1, 2, 4, 8, 16)], "key string, n long, y double")
    row = statistics.power_law(points).first()
    assert row["alpha"] == 0.7 and math.isclose(row["a"], 1.0, abs_tol=1e-3) and math.isclose(row["b"], -0.5, abs_tol=1e-3)


def test_nearest_ties_go_to_smaller_ids(spark):
    points = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, x array<double>")
    found = {(r["i"], r["rank"]): r["j"] for r in matching.nearest(points, 2, block=2).collect()}
    assert found[(2, 1)] == 1 and found[(2, 2)] == 3 and found[(0, 1)] == 1


def test_path_scores_read_whole_paths(spark):
    import pandas as pd
    from types import SimpleNamespace

    from graphloom.plans.queries import _path_similarities

    values = [float(i) for i in range(13)] + [3.5, 9.25, 0.5, 20.0, 7.75]
    events = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate(values)], "event_id long, user_id long, ts long, value double")
    each = []
    for i, v in enumerate(values):
        for side in (range(i + 1, len(values)), range(i)):
            gap, sim = pd.Series([abs(j - i) for j in side], dtype=float).rank(), pd.Series([-abs(values[j] - v) for j in side], dtype=float).rank()
            if len(gap) > 1 and sim.nunique() > 1:
                each.append(gap.corr(sim))
    found = statistics.path_scores(_path_similarities(SimpleNamespace(table=lambda name: events))).first()
    assert math.isclose(found["score"], -sum(each) / len(each), abs_tol=1e-6)


def test_farthest_points_are_distinct(spark):
    points = some_points(spark)[1]
    assert sampling.farthest_points(points, 5).select("id").distinct().count() == 5


def test_replacement_pairs_differ_and_exist(spark, sf_dir):
    from graphloom.plans.queries import QUERIES

    rows = QUERIES["p_replace_single"](spark, sf_dir)
    assert rows.where("graph_id % 2 <> 0 or donor_graph % 2 <> 1").isEmpty() and not rows.isEmpty()


def test_validate_reports_loops_and_missing_nodes(spark):
    nodes, edges = path(spark, 2)
    bad = edges.union(spark.createDataFrame([(1, 2, 2, "seq", "a", "a"), (1, 1, 9, "seq", "a", "a")], edges.schema))
    assert {r["problem"] for r in validate(nodes, bad).collect()} == {"loop", "missing node"}


def test_stream_gives_the_batch_counts(spark, sf_dir, tmp_path):
    from graphloom.streaming import events

    stream = events.running_weights(events.read_events(spark, sf_dir)).writeStream.outputMode("complete").format("memory").queryName("weights").start()
    stream.processAllAvailable()
    stream.stop()
    batch = events.running_weights(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert sorted(map(tuple, spark.table("weights").collect())) == sorted(map(tuple, batch.collect()))


def test_empty_corpus(spark):
    nodes, edges = path(spark, 3)
    nothing = edges.where(F.lit(False))
    assert cuts.cut_index(nothing).isEmpty() and matching.rewrite_pairs(cuts.cut_index(nothing)).isEmpty()
    assert models.unknown_features(spark.createDataFrame([], "graph_id long, hash string"), spark.createDataFrame([], "hash string")).isEmpty()


@pytest.fixture(scope="module")
def order_graphs(spark, sf_dir):
    return corpora.derived(spark, sf_dir)


def as_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("small", [0, 9])
def test_packed_graphs_give_what_joins_give(order_graphs, small):
    """small = 0: all graphs go by joins; 9: some do."""
    n, e = (df.where("graph_id < 200") for df in order_graphs)
    context = lambda k: cuts.edge_contexts(e, k).select("graph_id", "inode", "u", "v", F.array_sort("cut").alias("cut"), F.array_sort(F.transform("near", lambda x: F.struct(x["j"], F.array_sort(x["types"])))).alias("near"))
    assert as_rows(context(small)) == as_rows(context(64))
    assert as_rows(cuts.radius_hash(n, e, 1, small)) == as_rows(cuts.radius_hash(n, e, 1, 64))
    assert as_rows(cuts.radius_hash(n, e, 2, small)) == as_rows(cuts.radius_hash(n, e, 2, 64))
    assert as_rows(hashing.graph_hashes(n, e, 3, small)) == as_rows(hashing.graph_hashes(n, e, 3, 64))


def test_replacement_keeps_the_boundary(order_graphs):
    """A rewritten graph has its donor's two nodes under fresh ids, and hangs them on the same outer nodes by the same edge labels."""
    e = order_graphs[1].where("graph_id < 400")
    chosen = {r["graph_id"]: r for r in rewriting.replacements(e).collect()}
    old = {}
    for r in e.collect():
        old.setdefault(r["graph_id"], []).append(r)
    part = {(r["graph_id"], r["inode"]): (r["u"], r["v"]) for r in cuts.edge_decomposition(e).collect()}
    new = {}
    for r in rewriting.replaced(e).collect():
        new.setdefault(r["graph_id"], []).append(r)
    assert chosen and set(new) == set(chosen)
    for g, c in chosen.items():
        inside, fresh = part[(g, c["inode"])], {c["n_nodes"] + 1, c["n_nodes"] + 2}
        outer = sorted((r["label"], x) for r in old[g] for x, y in ((r["src"], r["dst"]), (r["dst"], r["src"])) if y in inside and x not in inside)
        assert outer == sorted((r["label"], r["src"]) for r in new[g] if r["dst"] in fresh and r["src"] not in fresh)
        assert not any(x in inside for r in new[g] for x in (r["src"], r["dst"]))


def test_shortest_and_disjoint_paths(spark):
    rows = [(0, 1, 1.0), (1, 3, 1.0), (0, 2, 1.5), (2, 3, 1.0), (0, 3, 9.0), (3, 4, float("inf"))]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    assert paths.shortest_path(edges, 0, 3) == [0, 1, 3] and paths.shortest_path(edges, 0, 4) == []
    got = sorted((r["path"], r["pos"], r["id"]) for r in paths.disjoint_paths(edges, 0, 3, 5).collect())
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 3), (2, 0, 0), (2, 1, 2), (2, 2, 3), (3, 0, 0), (3, 1, 3)]


def test_disjoint_paths_of_many_pairs_at_once(spark):
    """Each pair's paths are those that it has alone; pairs without a path have none, a pair of one node that node."""
    rng = random.Random(5)
    rows = [(i, j, float(rng.randint(1, 40)) / 8) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.3] + [(20, 21, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    pairs = [(1, 0, 13), (2, 13, 0), (3, 3, 9), (4, 0, 21), (5, 20, 21), (6, 2, 2), (7, 50, 0)]
    got = defaultdict(lambda: defaultdict(list))
    for r in sorted(paths.disjoint_paths_between(edges, spark.createDataFrame(pairs, "pair long, source long, target long"), 2).collect(), key=lambda r: r["pos"]):
        got[r["pair"]][r["path"]].append(r["id"])
    for pair, source, target in pairs:
        left, want = {(min(a, b), max(a, b)): w for a, b, w in rows}, {}
        for k in (1, 2):
            dist = {source: 0.0}
            for _ in range(30):
                for (a, b), w in left.items():
                    for x, y in ((a, b), (b, a)):
                        if x in dist and dist[x] + w < dist.get(y, math.inf):
                            dist[y] = dist[x] + w
            if target not in dist or source == 50:
                break
            way = [target]
            while way[-1] != source:
                at = way[-1]
                way.append(min((round(dist[x] + left[min(x, at), max(x, at)], 12), x) for x in dist if (min(x, at), max(x, at)) in left)[1])
            want[k] = way[::-1]
            for x, y in zip(way, way[1:], strict=False):
                left.pop((min(x, y), max(x, y)))
        assert {k: v for k, v in got[pair].items()} == want


def _sparse_by_force(x, k):
    """Kruskal's tree over all distances and mutual neighbours, with the distances."""
    d = {(i, j): round(math.dist(x[i], x[j]), 6) for i in x for j in x if i != j}
    name, tree = {i: i for i in x}, {}
    for w, i, j in sorted((w, i, j) for (i, j), w in d.items() if i < j and w > 0):
        if name[i] != name[j]:
            tree[i, j] = w
            old, new = name[i], name[j]
            name = {n: new if c == old else c for n, c in name.items()}
    near = {i: sorted((j for j in x if j != i), key=lambda j: (round(math.dist(x[i], x[j]), 9), j)) for i in x}
    mutual = {(i, j): d[i, j] for i in x for j in near[i][:k] if i < j and i in near[j][:k] and d[i, j] > 0}
    return {**mutual, **tree}, near


def _clusters():
    """Tight groups, so that no list of nearest points leaves its group; copies; and a far point."""
    rng = random.Random(11)
    x = {g * 10 + i: [10.0 * g + rng.random(), 7.0 * (g % 2) + rng.random()] for g in range(4) for i in range(8)}
    x[100], x[101], x[102], x[103] = x[0], x[0], x[0], [500.0, -3.0]
    return x


def test_sparse_graph_spans_all_distances(spark):
    x = _clusters()
    points = spark.createDataFrame(list(x.items()), "id long, x array<double>")
    want, _ = _sparse_by_force(x, 2)
    assert {(r["src"], r["dst"]): r["w"] for r in contexts.sparse_graph(points, 2, block=7).collect()} == want
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, x array<double>")
    got = {(r["src"], r["dst"]): r["w"] for r in contexts.sparse_graph(same, 2).collect()}
    assert {(0, j) for j in range(1, 5)} <= set(got) and set(got.values()) == {1e-6}
    assert contexts.sparse_graph(same.limit(0)).count() == 0 and contexts.sparse_graph(same.where("id = 1")).count() == 0


def test_context_of_pairs(spark):
    x = _clusters()
    points = spark.createDataFrame(list(x.items()), "id long, x array<double>")
    pairs = spark.createDataFrame([(1, 1, 37), (2, 103, 12), (3, 5, 6)], "pair long, source long, target long")
    sparse, near = _sparse_by_force(x, 3)
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in sparse.items()], "src long, dst long, w double")
    on_path = defaultdict(set)
    for r in paths.disjoint_paths_between(edges, pairs, 2).collect():
        on_path[r["pair"]].add(r["id"])
    want = set()
    for pair, ids in on_path.items():
        seen = sorted(ids)
        for i in sorted(ids):
            seen += [j for j in near[i] if j not in seen][:2]
        want |= {(pair, i, i in ids) for i in seen}
    got = [(r["pair"], r["id"], r["on_path"]) for r in contexts.pair_contexts(points, pairs, 3, 2, 2, block=9).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(on_path) == 3


def test_traversal_order_with_restarts(spark):
    """A queue in Python; by rows and by joins."""
    rng = random.Random(3)
    nodes, edges, want = [], [], {}
    for g in range(1, 7):
        n = rng.randint(1, 12)
        links = {tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(n)} if n > 2 else set()
        nodes += [(g, i, "a") for i in range(1, n + 1)]
        edges += [(g, a, b, "seq", "a", "a") for a, b in sorted(links)] + [(g, a, b, "flag", "a", "a") for a, b in sorted(links)[:2]] + [(g, 1, 1, "seq", "a", "a"), (g, 1, 99, "seq", "a", "a")]
        near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(1, n + 1)}
        rank = lambda i, near=near: (-len(near[i]), i)
        queue, met, at, component = [], set(), 0, -1
        while at < n:
            if at == len(queue):
                component += 1
                queue.append((min(set(near) - met, key=rank), 0, component))
                met.add(queue[-1][0])
            i, level, _ = queue[at]
            for j in sorted(near[i] - met, key=rank):
                queue.append((j, level + 1, component))
                met.add(j)
            at += 1
        want |= {(g, i): (c, level, p) for p, (i, level, c) in enumerate(queue)}
    n = spark.createDataFrame(nodes, "graph_id long, node_id int, label string")
    e = spark.createDataFrame(edges, "graph_id long, src int, dst int, label string, lu string, lv string")
    for small in (64, 6):
        got = {(r["graph_id"], r["node_id"]): (r["component"], r["level"], r["pos"]) for r in traversal.traversal_order(n, e, small).collect()}
        assert got == want
    assert traversal.traversal_order(n.limit(0), e.limit(0)).count() == 0


def test_equivalent_data_size(spark):
    """Points on the fitted curve need as much data as they have; points of twice the data have a ratio of 1."""
    fits = spark.createDataFrame([("k", 0.5, 10.0, -4.0)], "key string, alpha double, a double, b double")
    on = spark.createDataFrame([("k", n, 10 - 4 * (m * n) ** -0.5) for m in (1, 2) for n in (2, 4, 8)][:3], "key string, n long, y double")
    ahead = spark.createDataFrame([("k", n, 10 - 4 * (2 * n) ** -0.5) for n in (2, 4, 8)], "key string, n long, y double")
    assert abs(statistics.equivalent_data_size(on, fits).first()["eds"]) < 1e-3 and abs(statistics.equivalent_data_size(ahead, fits).first()["eds"] - 1) < 1e-3
    assert abs(sum(r["w"] for r in statistics.gain_weights(on, fits).collect()) - 1) < 1e-9


def random_graphs(spark, seed=1, n_graphs=6, least=1, most=14, labels="ABC"):
    """Random graphs with parallel edges in both directions, loops and isolated nodes, numbered from 1."""
    r, nodes, edges = random.Random(seed), [], []
    for g in range(n_graphs):
        n = r.randint(least, most)
        kind = {i: r.choice(labels) for i in range(1, n + 1)}
        nodes += [(g, i, kind[i]) for i in kind]
        edges += [(g, a, b, "e", kind[a], kind[b]) for a, b in ((r.randint(1, n), r.randint(1, n)) for _ in range(r.randint(0, 2 * n)))]
    return spark.createDataFrame(nodes, "graph_id long, node_id int, label string"), spark.createDataFrame(edges, "graph_id long, src int, dst int, label string, lu string, lv string"), nodes, edges


def features_by_hand(nodes, edges):
    """Degree, clustering and betweenness from breadth-first searches and all pairs of nodes."""
    out = {}
    for g in {x[0] for x in nodes}:
        ids = [x[1] for x in nodes if x[0] == g]
        near = {i: {b for e in edges if e[0] == g for a, b in (e[1:3], e[2:0:-1]) if a == i and b != i} for i in ids}
        dist, count = {}, {}
        for s in ids:
            dist[s, s], count[s, s], frontier = 0, 1, [s]
            while frontier:
                following = []
                for v in frontier:
                    for w in near[v]:
                        if (s, w) not in dist:
                            dist[s, w], count[s, w] = dist[s, v] + 1, 0
                            following.append(w)
                        if dist[s, w] == dist[s, v] + 1:
                            count[s, w] += count[s, v]
                frontier = following
        n = len(ids)
        for v in ids:
            through = sum(count[s, v] * count[v, t] / count[s, t] for s in ids for t in ids if len({s, v, t}) == 3 and (s, t) in dist and (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t])
            d = len(near[v])
            closed = sum(b in near[a] for a in near[v] for b in near[v] if a < b)
            out[g, v] = (d / (n - 1) if n > 1 else 0, 2 * closed / (d * (d - 1)) if d > 1 else 0, through / ((n - 1) * (n - 2)) if n > 2 else 0)
    return out


@pytest.mark.parametrize("small", [64, 0])
def test_node_features_by_hand(spark, small):
    nodes, edges, n, e = random_graphs(spark)
    got = {(r["graph_id"], r["node_id"]): (r["degree"], r["clustering"], r["betweenness"]) for r in structure.node_features(nodes, edges, small).collect()}
    want = features_by_hand(n, e)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_scaler_leaves_constant_columns(spark):
    nodes, edges, *_ = random_graphs(spark, 2)
    features = structure.node_features(nodes, edges).withColumn("clustering", F.lit(0.5))
    by = structure.scaler(features, structure.STRUCTURAL)
    out = structure.scaled(features, by).agg(*(F.avg(c) for c in structure.STRUCTURAL), *(F.stddev_pop(c) for c in structure.STRUCTURAL)).first()
    assert by["clustering"] == (0.5, 1.0) and list(out) == pytest.approx([0, 0, 0, 1, 0, 1], abs=1e-9)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_ranks_are_all_sets(spark, k):
    ranks = spark.range(math.comb(9, k)).withColumnRenamed("id", "rank")
    picks = [tuple(r["picks"]) for r in proposals.unranked(ranks, "rank", k).orderBy("rank").collect()]
    assert picks == sorted(combinations(range(9), k), key=lambda c: c[::-1])


def test_ranks_of_many_nodes(spark):
    n, r = 1_500_000, random.Random(1)
    ranks = sorted({0, math.comb(n, 3) - 1, *(r.randrange(math.comb(n, 3)) for _ in range(200)), *(math.comb(c, 3) + d for c in (3, 77, 999_999) for d in (-1, 0, 1))})
    for row in proposals.unranked(spark.createDataFrame([(x,) for x in ranks], "rank long"), "rank", 3).collect():
        a, b, c = row["picks"]
        assert 0 <= a < b < c < n and math.comb(c, 3) + math.comb(b, 2) + a == row["rank"]


@pytest.mark.parametrize("small", [64, 0])
def test_sets_of_nodes(spark, small):
    nodes, *_ , n, _ = random_graphs(spark, 3)
    label = {x[:2]: x[2] for x in n}
    want = {(g, c): ";".join(sorted(label[g, i] for i in c)) for g in {x[0] for x in n} for c in combinations(sorted(i for h, i in label if h == g), 3)}
    rows = proposals.node_sets(nodes, 3, small=small).collect()
    assert {(r["graph_id"], tuple(r["members"])): r["key"] for r in rows} == want and len(rows) == len(want)
    some = [(r["graph_id"], tuple(r["members"])) for r in proposals.node_sets(nodes, 3, 10, small=small).collect()]
    assert set(some) <= want.keys() and len(set(some)) == len(some) == sum(min(10, sum(g == h for h, _ in want)) for g in {g for g, _ in want})


def test_proposals_stop_in_time(spark, sf_dir):
    nodes, edges = corpora.derived(spark, sf_dir)
    rows = proposals.proposals(nodes, edges, wanted=1, misses=2, attempts=5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["graph_id"]].append(r)
    assert rows and all(len(x) == 1 for x in by.values()) and all(g % 2 == 0 for g in by) and all(r["donor_graph"] % 2 == 1 and len(r["nodes"].split(",")) == r["k"] for r in rows)


def test_retrieval_is_full_division(spark):
    r = random.Random(5)
    def parts(n, first):
        rows = [(g, i, [(j, [r.choice("ABC") for _ in range(r.randint(1, 3))]) for j in range(r.randint(0, 3))]) for g in range(first, first + n) for i in range(1, 4)]
        return rows, spark.createDataFrame(rows, "graph_id long, inode int, near array<struct<j:int,types:array<string>>>")
    (own, sources), (other, donors) = parts(25, 0), parts(40, 100)
    covers = lambda need, near: all(any(not Counter(p) - Counter(q) for _, q in near) for _, p in need)
    want = {(g, i): sum(covers(near, x) for *_, x in other if x) for g, i, near in own if near}
    got = {(x["graph_id"], x["inode"]): x["n_candidates"] for x in matching.retrieval_counts(sources, donors).collect()}
    assert got == {k: n for k, n in want.items() if n}


# places, decompositions, pruning


def test_places_of_skewed_classes(spark):
    """Two thirds of the rows in one class and many ties: gapless places in order."""
    rows = [(i, "big" if i % 3 else f"c{i % 7}", i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, by string, key int")
    placed = ranking.numbered(df, F.desc("key"), "id").collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["position"])] == [i for i, *_ in sorted(rows, key=lambda r: (-r[2], r[0]))] and {r["position"] for r in placed} == set(range(900))
    inside = defaultdict(list)
    for r in ranking.numbered_in(df, "by", "key", "id").collect():
        inside[r["by"]].append((r["pos"], r["key"], r["id"]))
    assert all([p for p, *_ in sorted(x)] == list(range(1, len(x) + 1)) and [y[1:] for y in sorted(x)] == sorted(y[1:] for y in x) for x in inside.values())
    assert ranking.numbered(df.limit(0), "id").isEmpty() and ranking.numbered_in(df.limit(0), "by", "id").isEmpty()


def test_bootstrap_and_resample(spark):
    targets = spark.createDataFrame([(i, "big" if i % 5 else "small") for i in range(600)], "graph_id long, target string")
    drawn = statistics.bootstrapped(targets).collect()
    total = Counter()
    for r in drawn:
        total[r["target"]] += r["times"]
    assert total == {"big": 480, "small": 120} and 0.55 < len(drawn) / 600 < 0.72  # about 1 - 1/e of them
    kept = Counter(r["target"] for r in statistics.resampled(targets, 118).collect())
    assert kept == {"big": 118, "small": 120}


def test_index_of_edges_is_the_cut_index(spark, order_graphs):
    nodes, edges = order_graphs
    general = decompositions.index(decompositions.by_edge(nodes, edges), nodes, edges)
    special = cuts.cut_index(edges).select(general.columns)
    assert sorted(map(tuple, general.collect())) == sorted(map(tuple, special.collect()))


def test_decompositions_of_a_small_graph(spark):
    """A triangle with a tail and a node of its own."""
    nodes = spark.createDataFrame([(1, i, "AABBC"[i - 1]) for i in range(1, 6)], "graph_id long, node_id int, label string")
    edges = spark.createDataFrame([(1, 1, 2, "e", "A", "A"), (1, 2, 3, "e", "A", "B"), (1, 1, 3, "e", "A", "B"), (1, 3, 4, "f", "B", "B")], "graph_id long, src int, dst int, label string, lu string, lv string")
    sets = lambda members: {frozenset(x) for x in by_part(members).values()}
    def by_part(members):
        out = defaultdict(set)
        for r in members.collect():
            out[r["inode"]].add(r["node_id"])
        return out
    assert sets(decompositions.by_triangle(nodes, edges)) == {frozenset({1, 2, 3})}
    assert by_part(decompositions.by_neighbourhood(nodes, edges)) == {1: {1, 2, 3}, 2: {1, 2, 3}, 3: {1, 2, 3, 4}, 4: {3, 4}, 5: {5}}
    assert by_part(decompositions.by_component(nodes, edges)) == {1: {1, 2, 3, 4}, 5: {5}}
    triangle = decompositions.by_triangle(nodes, edges)
    keys = {s: decompositions.index(triangle, nodes, edges, s).first()["cut_key"] for s in decompositions.SCOPES}
    assert keys == {"none": "", "label": "f", "inner": "f|B", "outer": "f|B", "both": "f|B|B"}
    with pytest.raises(ValueError):
        decompositions.boundary(triangle, edges, "all")


def pruned_by_hand(nodes, edges, least, seed):
    key = lambda e: (hashlib.md5("|".join(map(str, (seed, *e[:4]))).encode()).hexdigest(), e[1], e[2], e[3])
    label, out = {x[:2]: x[2] for x in nodes}, []
    for g in {x[0] for x in nodes}:
        left, own, step = {i for h, i in label if h == g}, [e for e in edges if e[0] == g], 0
        while options := [e for e in own if e[1] != e[2] and e[1] in left and e[2] in left and len(left) - 2 >= least]:
            u, v = min(options, key=key)[1:3]
            left -= {u, v}
            met = {b for e in own for a, b in (e[1:3], e[2:0:-1]) if a in (u, v) and b in left}
            step += 1
            out.append((g, step, u, v, len(left), len(met), ";".join(sorted(label[g, b] for b in met))))
    return sorted(out)


@pytest.mark.parametrize("small", [64, 0])
def test_pruning_to_the_end(spark, small):
    nodes, edges, n, e = random_graphs(spark, 4, 8)
    got = decompositions.pruning_sequences(nodes, edges, 2, "s", small)
    assert sorted(map(tuple, got.collect())) == pruned_by_hand(n, e, 2, "s")
    assert decompositions.pruning_sequences(nodes.limit(0), edges.limit(0)).isEmpty()


# selection


def some_points(spark, n=30, seed=8):
    r = random.Random(seed)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], r.choice([0.1, 0.5, 0.5, 0.9]), r.randint(0, 9), r.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, score double, wins int, losses int")


near = lambda a, b: 1 / (1 + math.dist(a, b))


def test_greedy_selection_by_all_similarities(spark):
    rows, points = some_points(spark)
    chosen = []
    while len(chosen) < 6:
        chosen.append(min((x for x in rows if x not in chosen), key=lambda x: (-round(x[2] - 0.6 * max((near(x[1], c[1]) for c in chosen), default=0), 9), x[0])))
    assert [r["id"] for r in optimise.greedy_selection(points, 6, 0.6).orderBy("rank").collect()] == [c[0] for c in chosen]
    assert optimise.greedy_selection(points.limit(2), 6, 0.6).count() == 2 and optimise.greedy_selection(points.limit(0), 6, 0.6).isEmpty()


def test_beta_draws_have_the_mean_and_spread_of_beta(spark):
    df = spark.range(4000).select(optimise.beta_draw(F.lit(6), F.lit(2), F.col("id"), "s").alias("b"))
    mean, std = df.agg(F.avg("b"), F.stddev("b")).first()
    assert abs(mean - 0.7) < 0.01 and abs(std - math.sqrt(7 * 3 / (100 * 11))) < 0.01
    assert sorted(r["rank"] for r in optimise.thompson_selection(some_points(spark)[1], 5, 0.5, 0.7).collect()) == [1, 2, 3, 4, 5]


def test_swaps_against_all_swaps(spark):
    rows, points = some_points(spark)
    reward = lambda s: sum(x[2] for x in s) - 0.7 * sum(max(near(x[1], y[1]) for y in s if y is not x) for x in s)
    members = rows[:4]
    for _ in range(2):
        last = sorted(members, key=lambda x: (round(x[2] - 0.7 * max(near(x[1], y[1]) for y in members if y is not x), 9), x[0]))[:2]
        swaps = [(-round(reward([*(m for m in members if m is not o), x]), 9), x[0], o[0], [*(m for m in members if m is not o), x]) for o in last for x in rows if x not in members]
        best = min(swaps, key=lambda s: s[:3])
        if -best[0] > reward(members) + 1e-9:
            members = best[3]
    got = optimise.swapped(points, spark.createDataFrame([(x[0],) for x in rows[:4]], "id long"), 2, 0.7, 2)
    assert sorted(r["id"] for r in got.collect()) == sorted(x[0] for x in members)


# checkpoints


def test_resumed_run_gives_the_same_rows(spark, tmp_path):
    start = lambda: {"t": spark.range(5).withColumn("n", F.lit(0).cast("long"))}
    ran = []

    def step(k, tables, stop=None):
        ran.append(k)
        if k == stop:
            raise RuntimeError("lost")
        return {"t": tables["t"].withColumn("n", F.col("n") * 3 + F.col("id") + k)}

    whole = checkpoints.resumable(spark, str(tmp_path / "a"), "s", start, step, 4)["t"]
    with pytest.raises(RuntimeError):
        checkpoints.resumable(spark, str(tmp_path / "b"), "s", start, lambda k, t: step(k, t, 3), 4)
    ran.clear()
    (tmp_path / "b" / "manifests" / ".left.part").write_text("{")  # of a run that ended while it wrote one
    again = checkpoints.resumable(spark, str(tmp_path / "b"), "s", start, step, 4)["t"]
    assert ran == [3, 4] and sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        checkpoints.load(spark, str(tmp_path / "b"), "other")
    assert checkpoints.load(spark, str(tmp_path / "none"), "s") is None


def test_growing_goes_on_after_a_stop(spark, order_graphs, tmp_path):
    nodes, edges = (df.where("graph_id < 400") for df in order_graphs)
    whole = sorted(map(tuple, rewriting.grown(nodes, edges, 3, str(tmp_path / "a")).collect()))
    rewriting.grown(nodes, edges, 3, str(tmp_path / "b"))
    for f in (tmp_path / "b" / "manifests").glob("*00000000[23].json"):
        f.unlink()  # as if the run had ended after its first step
    assert sorted(map(tuple, rewriting.grown(nodes, edges, 3, str(tmp_path / "b")).collect())) == whole and whole
    with pytest.raises(ValueError):
        rewriting.grown(nodes, edges.limit(3), 3, str(tmp_path / "b"))


def test_derived_graphs_follow_their_files(spark, sf_dir, tmp_path):
    """Tables rewritten in place under the same names are read again."""
    folder = tmp_path / "tables"
    folder.mkdir()
    for name in ("lineitem", "part"):
        shutil.copy(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    before = corpora.derived(spark, str(folder))[0].count()
    assert corpora.derived(spark, str(folder))[0].count() == before
    part = pq.read_table(f"{sf_dir}/lineitem.parquet").filter(pc.field("l_orderkey") < 100)
    pq.write_table(part, folder / "lineitem.parquet")
    assert 0 < corpora.derived(spark, str(folder))[0].count() == len(part) < before


# diffusion terms


def test_diffusion_terms_by_hand(spark):
    """Every term of one graph from dense matrices and the same draws."""
    nodes = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A"), (2, 1, "C")], "graph_id long, node_id int, label string")
    m, labels, betas = np.array([0.5, 0.25, 0.25]), "ABC", [0.2, 0.7]
    bars = np.cumprod(1 - np.array(betas))
    u = lambda *key: (int(hashlib.md5("|".join(map(str, ("37", *key))).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    mix = lambda w: w * np.eye(3) + (1 - w) * m
    got = {(r["graph_id"], r["t"]): r for r in models.diffusion_terms(nodes, statistics.node_marginals(nodes), betas).collect()}
    for t in (1, 2):
        one, before = mix(1 - betas[t - 1]), mix(bars[t - 2] if t > 1 else 1.0)
        q = one.T[None] * before[:, None] + 1e-7  # x, z, s
        q /= q.sum(2, keepdims=True)
        predicted = 0.5 * q + 0.5 * np.einsum("x,xzs->zs", m, q)[None]
        loss = 2 * (q * np.log(q / predicted)).sum(2)
        total = 0
        for node, x in ((1, 0), (2, 1), (3, 0)):
            z = x if u("keep", 1, node, t) < bars[t - 1] else int(np.searchsorted(np.cumsum(m), u("label", 1, node, t), side="right"))
            total += loss[x, z]
        row = got[1, t]
        assert row["loss_t"] == pytest.approx(total, abs=2e-5) and row["log_pn"] == pytest.approx(math.log(0.5), abs=1e-5)
        assert row["nll"] == pytest.approx(-row["log_pn"] + row["kl_prior"] + row["loss_t"] - row["log_p0"], abs=3e-5) and row["kl_prior"] > 0 and row["loss_t"] >= 0


# contexts and repairs


@pytest.mark.parametrize("block", [4096, 3])
def test_contexts_are_an_epsilon_net(spark, block):
    """Greedy by hand, also where contexts come in many blocks."""
    r = random.Random(9)
    rows = [(g, i, r.choice("kl"), [float(r.randint(0, 3)) for _ in range(2)]) for g in range(20) for i in range(1, 4)]
    index = spark.createDataFrame([(g, i, k, "a", "m") for g, i, k, _ in rows], "graph_id long, inode int, cut_key string, assoc_hash string, edge_map_sig string")
    found = spark.createDataFrame([(g, i, x) for g, i, _, x in rows], "graph_id long, inode int, context array<double>")
    got = [(x["cut_key"], x["freq"], x["variant"], x["context"]) for x in cuts.distinct_contexts(index, found, 1.2, block).collect()]
    want = []
    for k in "kl":
        kept = []
        for _, _, key, x in sorted(rows):
            if key == k and all(math.dist(x, y) > 1.2 for y in kept):
                kept.append(x)
        want += [(k, sum(key == k for _, _, key, _ in rows), n, x) for n, x in enumerate(kept, 1)]
    assert sorted(got) == sorted(want)
    assert cuts.distinct_contexts(index.limit(0), found, 1.2).isEmpty()


def test_nearest_among_others_breaks_ties_by_id(spark):
    own = spark.createDataFrame([(0, [0.0, 0.0])], "id long, x array<double>")
    others = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 1e-13 * i]) for i in range(1, 40)], "id long, x array<double>")
    assert [r["j"] for r in matching.nearest(own, 5, others=others).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_repair_is_the_best_of_all_rewrites(spark, order_graphs):
    """The cosine of the repaired graph itself is the one that was promised, and boundaries stay."""
    nodes, edges = (df.where("graph_id < 300") for df in order_graphs)
    graphs = nodes.select("graph_id").distinct()
    chosen = corpora.saved(repair.repairs(nodes, edges, graphs.where("graph_id % 2 = 0"), graphs.where("graph_id % 2 = 1")))
    rows = chosen.collect()
    after = repair.repaired(edges, chosen)
    assert rows and all(r["after"] <= 1 for r in rows)
    before = {r["graph_id"]: r["n"] for r in edges.join(chosen, "graph_id").groupBy("graph_id").agg(F.count("*").alias("n")).collect()}
    assert {r["graph_id"]: r["n"] for r in after.groupBy("graph_id").agg(F.count("*").alias("n")).collect()} == before
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("lu").alias("label")), F.struct(F.col("dst").alias("node_id"), F.col("lv").alias("label")))
    labels = {g: sorted(x) for g, x in ((r["graph_id"], r["l"]) for r in after.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.*").distinct().groupBy("graph_id").agg(F.collect_list("label").alias("l")).collect())}
    old = defaultdict(list)
    for r in nodes.collect():
        old[r["graph_id"]].append(r["label"])
    assert all(len(labels[r["graph_id"]]) == len(old[r["graph_id"]]) for r in rows)


def test_anchor_mapping_is_injective_and_covers(spark):
    anchors = spark.createDataFrame([(1, 1, 1, 9, "A", 5), (1, 1, 2, 9, "A", 5), (1, 1, 2, 8, "B", 5), (1, 2, 1, 7, "B", 5), (1, 2, 1, 6, "B", 5), (1, 3, 1, 6, "A", 6), (1, 4, 1, 6, None, 5)], "graph_id long, inode int, inner int, outer int, type string, target long")
    nodes = spark.createDataFrame([(5, 1, "A"), (5, 2, "A"), (5, 3, "A"), (5, 4, "B"), (6, 1, "A")], "graph_id long, node_id int, type string")
    assigned = spark.createDataFrame([(5, "x", 4), (5, "y", 1), (5, "y", 2), (5, "y", 3)], "graph_id long, subgraph string, node_id int")
    kinds = {1: "A", 2: "A", 3: "A", 4: "B"}
    seen = set()
    for seed in map(str, range(12)):
        got = matching.anchor_mapping(anchors, nodes, assigned, seed, whole=True).collect()
        assert {r["inode"] for r in got} == {1}  # 2 needs two nodes of B, 3 touches nothing, 4 has no type
        assert len({r["mapped"] for r in got}) == len(got) == 3
        assert all(kinds[r["mapped"]] == ("B" if r["outer"] == 8 else "A") and r["n_covered"] == 2 for r in got)
        seen.add(tuple(sorted((r["inner"], r["outer"], r["mapped"]) for r in got)))
    assert len(seen) > 1
    more = spark.createDataFrame([(5, "z", 7)], assigned.schema)
    assert matching.anchor_mapping(anchors, nodes, assigned.union(more), whole=True).isEmpty()
    assert matching.anchor_mapping(anchors, nodes, assigned.union(more)).count() == 3
    assert matching.anchor_mapping(anchors.limit(0), nodes, assigned).isEmpty()


def test_divergence_and_ranking_against_plain_formulas(spark):
    draw = random.Random(3)
    points = [(i % 3, [draw.gauss(0, 1) for _ in range(4)], [draw.gauss(-1, 0.3) for _ in range(4)]) for i in range(30)] + [(0, None, [1.0]), (0, [1.0], [1.0, 2.0])]
    got = {r["g"]: r for r in models.latent_divergence(spark.createDataFrame(points, "g int, mean array<double>, logstd array<double>"), "g").collect()}
    for g in range(3):
        own = [sum(1 + 2 * s - m * m - math.exp(s) ** 2 for m, s in zip(mean, std)) for k, mean, std in points[:30] if k == g]
        assert got[g]["n"] == 10 and got[g]["kl"] == pytest.approx(0.5 / 10 * sum(own) / 10, abs=1e-6)
    rows = [(i % 2, i, int(i % 5 < 2), draw.random()) for i in range(40)] + [(2, 100, 1, 0.5), (3, 101, None, 0.5)]
    loss = {r["g"]: r for r in models.ranking_loss(spark.createDataFrame(rows, "g int, id int, y int, p double"), "g", ["id"], 6).collect()}
    for g in range(2):
        sides = [[p for _, i, y, p in sorted(rows[:40], key=lambda r: hashlib.md5(f"0|{r[1]}".encode()).hexdigest()) if i % 2 == g and y == k][:6] for k in (1, 0)]
        each = [math.log(1 + math.exp(b - a)) for a, b in zip(*sides)]
        assert loss[g]["n_pairs"] == len(each) == 6 and loss[g]["loss"] == pytest.approx(sum(each) / 6, abs=1e-6)
    assert (loss[2]["n_pairs"], loss[2]["loss"]) == (0, 0.0) and set(loss) == {0, 1, 2}
