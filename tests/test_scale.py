"""Plans and results at the places where large inputs failed."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cuts, matching, proposals
from graphloom.sources import corpora


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return corpora.derived(spark, sf_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_balls_of_packed_graphs_are_those_of_joins(corpus):
    n, e = corpus
    assert rows(cuts.balls(n, e)) == rows(cuts._joined_balls(n, e, 2)) == rows(cuts.balls(n, e, small=3))


def test_balls_neither_broadcast_nor_shuffle_the_corpus(corpus):
    found = plan(cuts.balls(*corpus))
    assert "Broadcast" not in found and "Exchange" not in found


def test_contexts_do_not_broadcast_the_corpus(corpus):
    assert "Broadcast" not in plan(cuts.contexts(*corpus))


@pytest.mark.parametrize("k", [2, 3])
def test_node_sets_do_not_broadcast_the_nodes(corpus, k):
    assert "Broadcast" not in plan(proposals.node_sets(corpus[0], k))


def test_proposals_deal_attempts_by_graph_once(corpus, monkeypatch):
    """Attempts lie in buckets whose rows don't grow with the table; at first the last step dealt them by graph_id to a fixed number of tasks."""
    found = proposals.proposals(*corpus)
    assert "hashpartitioning(graph_id" not in plan(found)
    monkeypatch.setattr(corpora, "ROWS", 500)
    dealt = proposals.proposals(*corpus)
    assert plan(dealt).count("REPARTITION_BY_NUM") == 2 and rows(dealt) == rows(found)


def test_retrieval_makes_profiles_once(spark, sf_dir, monkeypatch):
    """At first all subgraphs got their profiles twice, for the sources and again for the donors."""
    import __spark_entry__ as entry

    calls, made = [], matching.port_profiles
    monkeypatch.setattr(matching, "port_profiles", lambda parts: calls.append(1) or made(parts))
    assert entry.queries()["j_retrieve"](spark, sf_dir).count() > 0 and len(calls) == 1


def test_corpus_is_written_once_in_buckets(corpus):
    n, e = corpus
    assert n.inputFiles() and sorted(n.inputFiles()) == sorted(e.inputFiles())
    assert "Exchange" not in plan(e.groupBy("graph_id").count())


def _points(spark, n, seed, copies=False):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 4)).astype(float) if copies else rng.normal(size=(n, 4))
    return spark.createDataFrame([(int(i) * 3, [float(v) for v in x[i]], int(i) % 3) for i in range(n)], "id long, x array<double>, label int")


def _brute(df, k):
    import numpy as np

    got = [(r["id"], np.array(r["x"])) for r in df.collect()]
    out = []
    for i, x in got:
        d = [(round(float(np.sqrt(((x - y) ** 2).sum())), 9), j) for j, y in got if j != i]
        out += [(i, j, rank, round(w, 6)) for rank, (w, j) in enumerate(sorted(v for v in d if np.isfinite(v[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("copies", [False, True])
def test_nearest_lists_are_those_of_all_pairs(spark, copies):
    points = _points(spark, 150, 1, copies)
    assert rows(matching.nearest(points, 5, block=40)) == _brute(points, 5)


def test_nearest_of_numbers_too_large_for_squares(spark):
    points = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 3.0]), (3, [1e200, 7.0]), (4, [float("nan"), 0.0])], "id long, x array<double>")
    assert rows(matching.nearest(points, 2)) == _brute(points, 2)


def test_nearest_sends_a_point_once_to_a_block_of_points(spark):
    found = plan(matching.nearest(_points(spark, 60, 2)))
    assert "Join" not in found


def test_distances_with_missing_components_and_copies(spark):
    data = [(1, [0.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0], 1), (7, [2.0], 2), (8, None, 3), (9, [1.0], 3), (10, [1.0], None)]
    points = spark.createDataFrame(data, "id long, x array<double>, label int")
    assert rows(matching.distances(points)) == [(1, 15, round(10 / 3, 6), 5.0), (3, 1, None, None)]
    assert "Join" not in plan(matching.distances(points))


def test_path_scores_make_no_row_of_a_pair(spark, monkeypatch):
    """Groups of few pairs, equal values and missing ones; the rows of all pairs give the same scores."""
    from types import SimpleNamespace

    from graphloom.operators import statistics
    from graphloom.plans import queries as plans

    data = [(p * 100 + i, p, i // 2, float((i * 7 + p) % 11) / 3) for p in range(5) for i in range(3 + 8 * p)] + [(900 + i, 9, i, 1.5) for i in range(4)]
    t = SimpleNamespace(table=lambda name: spark.createDataFrame(data, "event_id long, user_id long, ts long, value double"))
    by_rows = rows(statistics.path_scores(plans._path_similarities(t)))
    assert len(by_rows) == 5 and rows(statistics.value_path_scores(plans._paths(t))) == by_rows
    assert "Join" not in plan(plans._BY_NAME["a_path_score"](t))
    monkeypatch.setattr(statistics, "PAIRS", 60)
    monkeypatch.setattr(statistics, "CELLS", 50)
    assert rows(statistics.value_path_scores(plans._paths(t))) == by_rows
    holes = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate([1.0, None, 4.0, 2.0, float("nan"), 3.0])], "path long, pos int, value double")
    assert statistics.value_path_scores(holes).count() == 1


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_of_copies_are_those_of_all_points(spark, k):
    """Negative ids, points that are among the others, classes larger and smaller than k; equal vectors are searched once."""
    points = _points(spark, 200, 5, True).withColumn("id", F.col("id") - 300)
    left, right = points.where("label < 2"), points.where("label > 0")
    found = matching.nearest_of_copies(left, k, right, 7)
    assert rows(found) == rows(matching.nearest(left, k, others=right).select("i", "j"))
    assert matching.nearest_of_copies(left.limit(0), k, right).isEmpty() and matching.nearest_of_copies(left, k, right.limit(0)).isEmpty()


def test_repairs_search_equal_vectors_once(spark, corpus, monkeypatch):
    from graphloom.operators import repair

    met, seen = matching.met, []
    monkeypatch.setattr(matching, "met", lambda left, right, *more: seen.append((left, right)) or met(left, right, *more))
    n, e = (df.where("graph_id < 200") for df in corpus)
    graphs = n.select("graph_id").distinct()
    repair.repairs(n, e, graphs.where("graph_id % 2 = 0"), graphs.where("graph_id % 2 = 1"))
    assert seen and all(side.count() == side.select("x").distinct().count() for sides in seen for side in sides)


def test_places_in_many_classes_are_not_broadcast(spark):
    from graphloom.operators.ranking import numbered_in

    df = spark.createDataFrame([(str(i % 40) if i % 7 else None, i) for i in range(200)], "c string, v int")
    found = numbered_in(df, "c", "v", many=True)
    assert "SortMergeJoin" in plan(found) and rows(found.na.fill("")) == rows(numbered_in(df, "c", "v").na.fill(""))


def test_variants_broadcast_no_table_of_entries(spark, corpus, monkeypatch):
    """Neither the plan of the result nor those of the steps before it."""
    index, found = cuts.cut_index(corpus[1]), cuts.contexts(*corpus)
    plans, save = [], cuts.saved
    monkeypatch.setattr(cuts, "saved", lambda df: plans.append(plan(df)) or save(df))
    result = plan(cuts.distinct_contexts(index, found, 1.5, 8))
    small = "_pos_all_range", "_variant_all_range"  # as many rows as ranges
    assert len(plans) >= 3
    for line in "\n".join([*plans, result]).splitlines():
        assert "BroadcastHashJoin" not in line or any(x in line for x in small)


@pytest.mark.parametrize("scope", ["label", "both"])
def test_index_of_packed_graphs_is_that_of_joins(corpus, scope):
    """Also for nodes without edges, members that aren't nodes and graphs without edges."""
    from graphloom.operators import decompositions as d

    n, e = (df.where("graph_id < 150") for df in corpus)
    e = e.where("graph_id % 5 <> 0")
    members = d.by_component(n, e.where("label = 'flag'")).union(n.select("graph_id", F.lit(900), F.col("node_id") + 1))
    members = members.union(n.select("graph_id", F.lit(901), F.lit(77)).distinct())
    by_joins = rows(d._joined_index(members, n, e, scope))
    assert rows(d.index(members, n, e, scope)) == by_joins and rows(d.index(members, n, e, scope, small=4)) == by_joins


def test_index_of_neighbourhoods_needs_no_shuffle(corpus):
    from graphloom.operators import decompositions as d

    assert "Exchange" not in plan(d.index(d.by_neighbourhood(*corpus), *corpus))


def test_pairs_of_points_meet_once_and_few_rows_are_sent(spark):
    """A grid of blocks and shares: with blocks alone, all right points went to each of 64 blocks."""
    points = _points(spark, 4096, 3)
    sent = matching.met(points.select("id", "x"), points.select("id", "x"), 8192).select("id", "side", "cell").toPandas()
    assert len(sent) <= 4096 * 16
    left, right = (sent[sent["side"] == k].groupby("cell")["id"].apply(list) for k in (0, 1))
    pairs = sum(len(left[c]) * len(right[c]) for c in left.index if c in right.index)
    assert pairs == 4096**2 and set(left.index) == set(right.index)


def test_largest_component_searches_nothing(spark, monkeypatch):
    """Two distant clusters, the larger with far more points: only the smaller asks for its nearest point outside."""
    from graphloom.operators import contexts

    data = [(i, [float(i), 0.0]) for i in range(60)] + [(1000 + i, [1e4 + i, 0.0]) for i in range(20)]
    points = spark.createDataFrame(data, "id long, x array<double>")
    asked, search = [], contexts._nearest_outside
    monkeypatch.setattr(contexts, "_nearest_outside", lambda shut, *more: asked.append({r["id"] for r in shut.collect()}) or search(shut, *more))
    tree = rows(contexts.spanning_tree_of_points(points, matching.nearest(points, 2)))
    assert len(tree) == 79 and (59, 1000, 9941.0) in tree
    assert asked and asked[-1] and asked[-1] <= {i for i, _ in data[60:]}


def test_labels_are_followed_by_doubling(spark, monkeypatch):
    from graphloom.operators import paths

    label = spark.createDataFrame([(i, i) for i in range(201)] + [(300, 300), (301, 301)], "id long, c long")
    chosen = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (301, 300)], "a long, b long")
    saves, save = [], paths.saved
    monkeypatch.setattr(paths, "saved", lambda df: saves.append(1) or save(df))
    assert rows(paths.followed_labels(label, chosen)) == [(i, 200) for i in range(201)] + [(300, 300), (301, 300)]
    assert len(saves) <= 12


def test_lines_that_tie_are_ordered_by_all_columns(spark, sf_dir, tmp_path, monkeypatch):
    """Only the first columns of the order are shuffled, and lines that they leave tied come out as by all of them."""
    for name in ("lineitem", "part"):
        df = corpora.table(spark, sf_dir, name)
        if name == "lineitem":
            df = df.where("l_orderkey < 200")
            twin = df.where("l_orderkey % 7 = 0").withColumns({"l_tax": F.col("l_tax") / 2, "l_returnflag": F.when(F.col("l_returnflag") == "N", "R").otherwise("N")})
            df = df.union(twin)
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    shuffled, lines = [], corpora._lines
    monkeypatch.setattr(corpora, "_lines", lambda *a, **k: shuffled.append(lines(*a, **k)) or shuffled[-1])
    n, e = corpora.derived(spark, str(tmp_path))
    assert "l_shipdate" not in plan(shuffled[0]) and "Exchange" not in plan(e.groupBy("graph_id").count())
    assert len(shuffled) == 2 and shuffled[1].select("graph_id").distinct().count() == twin.select("l_orderkey").distinct().count()
    monkeypatch.undo()
    assert rows(n) == rows(corpora.nodes(spark, str(tmp_path))) and rows(e) == rows(corpora.edges(spark, str(tmp_path)))


def test_paths_are_traced_by_doubling(spark, monkeypatch):
    """A path of 100 nodes: tables are written a round of distances, but none a node on the way back."""
    from graphloom.operators import paths

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(99)], "src long, dst long, w double")
    before = edges.select(F.lit(1).cast("long").alias("pair"), F.col("dst").alias("id"), F.col("src").alias("to"))
    pairs = spark.createDataFrame([(1, 0, 99), (2, 5, 5)], "pair long, source long, target long")
    saves, save = [], paths.saved
    monkeypatch.setattr(paths, "saved", lambda df: saves.append(1) or save(df))
    assert rows(paths._traced(before, pairs)) == sorted([(1, i, 99 - i) for i in range(100)] + [(2, 5, 0)])
    assert len(saves) <= 15


def test_levels_of_packed_graphs_are_those_of_joins(spark, corpus):
    """Also for loops, parallel edges, isolated nodes, graphs without edges and edges to missing nodes; and without a shuffle."""
    from graphloom.operators import paths

    n, e = (df.where("graph_id < 120") for df in corpus)
    e = e.where("graph_id % 5 <> 0 and (graph_id % 3 <> 0 or label = 'flag')")
    e = e.union(e).union(e.where("graph_id % 2 = 0").withColumn("dst", F.col("src"))).union(e.where("graph_id % 7 = 0").withColumn("dst", F.col("dst") + 50))
    want = rows(paths._joined_hops(n, e))
    assert rows(paths.hops(n, e)) == want and rows(paths.hops(n, e, small=3)) == want
    assert "Exchange" not in plan(paths.hops(*corpus))


def test_transitions_join_nothing(spark, corpus):
    """Neighbours bring their hashes along in their graph's row: at first two tables of all subgraphs' hashes were broadcast. Large graphs, which go by joins, give the same rows."""
    e = corpus[1]
    assert "Join" not in plan(matching.transitions(e)) and "Join" not in plan(cuts.overlap_signatures(e))
    few = e.where("graph_id < 300")
    types = matching.components(few).select("graph_id", "inode", "img_type")
    steps = matching.port_types(few).join(types.toDF("graph_id", "i", "prev"), ["graph_id", "i"]).join(types.toDF("graph_id", "j", "next"), ["graph_id", "j"])
    want = rows(steps.groupBy("prev", "type", "next").count())
    assert want == rows(matching.transitions(few).drop("rank")) == rows(matching.transitions(few, small=3).drop("rank"))
    assert rows(cuts.overlap_signatures(few)) == rows(cuts.overlap_signatures(few, small=3))


def test_contexts_in_the_row_of_a_graph(corpus):
    """The contexts and entries that joins give, without a shuffle: at first each was dealt by subgraph several times."""
    n, e = corpus
    assert "Exchange" not in plan(cuts.indexed_contexts(n, e))
    n, e = (df.where("graph_id < 400") for df in corpus)
    want = rows(cuts.cut_index(e).join(cuts.contexts(n, e), ["graph_id", "inode"]))
    assert rows(cuts.indexed_contexts(n, e)) == want == rows(cuts.indexed_contexts(n, e, small=3))
    made = cuts.distinct_contexts(cuts.cut_index(e), cuts.contexts(n, e), 1.5)
    assert rows(cuts.variants(n, e, 1.5)) == rows(made) == rows(cuts.distinct_contexts(cuts.cut_index(e), cuts.contexts(n, e), 1.5, 2))


def test_keys_of_entries_are_not_shuffled_by_subgraph(corpus, monkeypatch):
    """Subgraphs are grouped by a digest of their entry; the key's text comes from the first subgraph of each entry."""
    plans, save = [], cuts.saved
    monkeypatch.setattr(cuts, "saved", lambda df: plans.append(plan(df)) or save(df))
    cuts.variants(*corpus, 1.5)
    assert plans and "numbered" not in "".join(plans) and all("cut_key" not in line for p in plans for line in p.splitlines() if "Exchange" in line)


def test_repairs_of_copies_are_scored_once(spark, corpus, monkeypatch):
    """Copies of a source have its repair, and make no more rewrites to score; at first each graph had its own. A graph that is source and donor isn't its own donor."""
    from graphloom.operators import repair

    made, save = [], repair.saved
    monkeypatch.setattr(repair, "saved", lambda df: made.append(save(df)) or made[-1])
    n, e = (df.where("graph_id < 160") for df in corpus)
    own = n.select("graph_id").distinct()
    again = lambda df: df.union(df.where("graph_id % 2 = 0").withColumn("graph_id", F.col("graph_id") + 10_000))
    odd = own.where("graph_id % 2 = 1")
    once = rows(repair.repairs(n, e, own.where("graph_id % 2 = 0"), odd))
    scored = [df.count() for df in made if {"donor_ends", "edge"} <= set(df.columns)]
    made.clear()
    twice = rows(repair.repairs(again(n), again(e), again(own).where("graph_id % 2 = 0"), odd))
    assert twice == sorted(once + [(g + 10_000, *x) for g, *x in once]) and once
    assert scored and scored == [df.count() for df in made if {"donor_ends", "edge"} <= set(df.columns)]
    mixed = rows(repair.repairs(n, e, own, own))
    assert mixed and all(r[0] != r[2] for r in mixed)


def test_rewritten_graphs_are_broadcast_nowhere(corpus, monkeypatch):
    """Neither the subgraphs nor the rewritten edges: the corpus is compressed so well that Spark takes them for small."""
    from graphloom.operators import rewriting

    plans, save = [], rewriting.saved
    chosen = save(rewriting.replacements(corpus[1]))
    monkeypatch.setattr(rewriting, "saved", lambda df: plans.append(plan(df)) or save(df))
    result = plan(rewriting.replaced(corpus[1], chosen))
    assert plans and "BroadcastHashJoin" not in "".join([*plans, result])


def test_contexts_keep_what_a_graph_holds(corpus):
    """Also those of large graphs, which go by joins; and where all edges are given, that these are part of."""
    from graphloom.functions.hashing import SMALL

    e = corpus[1].where("graph_id < 200").withColumn("asked", F.col("graph_id") * 2)
    found = [cuts.edge_contexts(e, small, keep=("asked",), within=corpus[1]) for small in (SMALL, 3)]
    sorted_parts = lambda df: rows(df.withColumns({c: F.array_sort(c) for c in ("cut", "near")}))
    assert sorted_parts(found[0]) == sorted_parts(found[1]) and found[0].where("asked <> 2 * graph_id").isEmpty()
