"""The registered queries over the order graphs, the embedding points and the events."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bucket, graph_hashes
from ..operators import contexts, cuts, decompositions, matching, models, optimise, paths, proposals, repair, rewriting, sampling, statistics, structure, traversal
from ..sources import corpora
from ..streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]


class _Tables:
    """What the queries start from, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        make = {"t": corpora.targets, "p": corpora.points, "u": corpora.user_edges}
        self.__dict__.update({k: f(spark, sf_dir) for k, f in make.items()})

    @cached_property
    def n(self) -> DataFrame:
        return corpora.derived(self.spark, self.dir)[0]

    @cached_property
    def e(self) -> DataFrame:
        return corpora.derived(self.spark, self.dir)[1]

    def table(self, name: str) -> DataFrame:
        return corpora.table(self.spark, self.dir, name)

    @property
    def hashes(self) -> DataFrame:
        return graph_hashes(self.n, self.e)


def _graph_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and other graphs: md5 of graph_id modulo 10 under 6, and the rest."""
    part = bucket(F.col("graph_id").cast("string"), 32) % 10
    return df.where(part < 6), df.where(part >= 6)


def _model_scores(t: _Tables) -> DataFrame:
    c = t.table("customer")
    return c.groupBy(F.col("c_nationkey").alias("model")).agg(F.avg("c_acctbal").alias("m1"), F.stddev_pop("c_acctbal").alias("s1"), F.avg(F.length("c_name") + F.col("c_custkey") % 7).cast("double").alias("m2"), F.stddev_pop(F.col("c_custkey") % 7).alias("s2"))


def _label_pairs(t: _Tables) -> DataFrame:
    """Predictions to score: whether an order is urgent, guessed from its price."""
    return t.table("orders").select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), (F.col("o_totalprice") > 200000).cast("int").alias("z"))


def _paths(t: _Tables) -> DataFrame:
    """(path, pos, value): users' event values along time."""
    from pyspark.sql import Window as W

    return t.table("events").select(F.col("user_id").alias("path"), "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


def _path_similarities(t: _Tables) -> DataFrame:
    """The paths with the similarity of each two positions as a row, for path_scores: quadratic in a user's events."""
    all_ = _paths(t)
    other = all_.select("path", F.col("pos").alias("other"), F.col("value").alias("w"))
    return all_.join(other, "path").select("path", "pos", "other", F.round(-F.abs(F.col("value") - F.col("w")), 6).alias("sim"))


def _line_weights(t: _Tables) -> DataFrame:
    return t.table("lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))


def _line_means(t: _Tables, where: str = "true") -> DataFrame:
    """(key, n, y): the mean quantity by return flag and line number, a learning curve to fit."""
    return t.table("lineitem").where(where).groupBy(F.col("l_returnflag").alias("key"), F.col("l_linenumber").cast("long").alias("n")).agg(F.round(F.avg("l_quantity"), 6).alias("y"))


def _nation_links(t: _Tables) -> DataFrame:
    """(src, dst, w): nations linked by orders, w falls with the number of lines from suppliers of one to customers of the other."""
    lines = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.select(F.least("c_nationkey", "s_nationkey").cast("long").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg((1.0 / F.count("*")).alias("w"))


def _label_ends(t: _Tables) -> DataFrame:
    """(pair, source, target): the first and the last point of each label."""
    ends = t.p.where("label is not null").groupBy(F.col("label").cast("long").alias("pair")).agg(F.min("id").alias("source"), F.max("id").alias("target"))
    return ends.where("source <> target")


def _asked_pairs(t: _Tables) -> DataFrame:
    """Every class of node pairs: both kinds, all bins, all pairs of part types."""
    kinds = t.table("part").select(F.col("p_type").alias("lu")).distinct()
    other = kinds.select(F.col("lu").alias("lv"))
    classes = kinds.join(F.broadcast(other), F.col("lu") <= F.col("lv"))
    return classes.withColumn("kind", F.explode(F.array(F.lit("within"), F.lit("between")))).withColumn("ratio_bin", F.explode(F.sequence(F.lit(0), F.lit(statistics.BINS - 1))))


def _scored_points(t: _Tables) -> DataFrame:
    """The points with a score, and a record of wins (components over 0) and losses."""
    wins = F.size(F.filter("x", lambda v: v > 0))
    return t.p.select("id", "x", (F.col("id") % 17 / 17.0).alias("score"), wins.alias("wins"), (F.size("x") - wins).alias("losses"))


def _by_status(t: _Tables, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subgraphs of orders in progress (status P), and those of the others."""
    asked = t.t.where("target = 'P'").select("graph_id")
    return parts.join(asked, "graph_id", "left_semi"), parts.join(asked, "graph_id", "left_anti")


def _profiles_by_status(t: _Tables) -> tuple[DataFrame, DataFrame]:
    """The port profiles of _by_status. Both parts come from one pass over the subgraphs, while these still lie by graph_id."""
    asked = t.t.where("target = 'P'").select("graph_id").distinct().withColumn("asked", F.lit(True))
    every = corpora.saved(matching.port_profiles(cuts.edge_contexts(t.e)).join(asked, "graph_id", "left"))
    return every.where("asked").drop("asked"), every.where("asked is null").drop("asked")


def _sources_donors(t: _Tables) -> tuple[DataFrame, DataFrame]:
    """Orders in progress (status P) to repair, and finished ones (F) as donors."""
    return tuple(t.t.where(F.col("target") == s).select("graph_id") for s in "PF")


def _query(f: Callable[[_Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_Tables(spark, sf_dir))


_BY_NAME: dict[str, Callable[[_Tables], DataFrame]] = {
    "k_cut_edges": lambda t: cuts.cut_edges(t.e),
    "k_edge_key": lambda t: cuts.edge_keys(t.e),
    "k_cut_signature": lambda t: cuts.cut_signature(t.e),
    "k_cut_index": lambda t: cuts.cut_index(t.e),
    "k_cut_dedup": lambda t: cuts.deduplicated(cuts.cut_index(t.e)),
    "k_cut_merge": lambda t: cuts.merged(*(cuts.deduplicated(cuts.cut_index(t.e.where(F.col("graph_id") % 2 == k))) for k in (0, 1))),
    "k_cut_size_hist": lambda t: cuts.cut_sizes(t.e),
    "k_ball": lambda t: cuts.balls(t.n, t.e),
    "k_radius_hash": lambda t: cuts.radius_hash(t.n, t.e),
    "k_anchor_type": lambda t: cuts.anchor_types(t.n, t.e),
    "k_node_keys": lambda t: cuts.radius_hash(t.n, t.e).groupBy("hash").agg(F.count("*").alias("n")),
    "k_virtual_cut": lambda t: cuts.virtual_cut(t.e),
    "k_virtual_candidates": lambda t: proposals.virtual_candidates(t.n, t.e),
    "k_virtual_candidates_3": lambda t: proposals.virtual_candidates(t.n, t.e, 3),
    "k_virtual_sample": lambda t: proposals.sampled_candidates(t.n, t.e),
    "p_virtual_propose": lambda t: proposals.proposals(t.n, t.e),
    "j_retrieve": lambda t: matching.profile_counts(*_profiles_by_status(t)),
    "k_overlap_sig": lambda t: cuts.overlap_signatures(t.e),
    "k_rewrite_pairs": lambda t: matching.effective_sources(cuts.cut_index(t.e)),
    "j_rewrite_pairs": lambda t: matching.rewrite_pairs(cuts.cut_index(t.e)),
    "j_bucket": lambda t: matching.buckets(t.e),
    "j_inverted_semi": lambda t: matching.inverted_candidates(t.e),
    "j_multiset_contains": lambda t: matching.containing_ports(t.e, {"PROMO": 1}),
    "j_transitions": lambda t: matching.transitions(t.e),
    "j_anchor_filter": lambda t: matching.anchor_matches(t.e),
    "j_anchor_mapping": lambda t: matching.next_graph_mapping(t.n, t.e),
    "j_image_edge_anti": lambda t: matching.image_edge_violations(t.e),
    "j_knn": lambda t: matching.nearest(t.p),
    "j_mutual_knn": lambda t: matching.mutual_nearest(t.p),
    "j_pairwise": lambda t: matching.distances(t.p),
    "a_group_target": lambda t: statistics.group_targets(t.t),
    "a_image_groups": lambda t: statistics.image_groups(t.hashes),
    "a_allocate": lambda t: statistics.allocated(t.t.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("weight")), 1000),
    "a_edge_stats": lambda t: statistics.edge_statistics(statistics.node_pairs(t.n, t.e)),
    "a_label_hist": lambda t: statistics.label_histogram(t.n, t.t),
    "a_size_hist": lambda t: statistics.size_histogram(t.n, t.t),
    "a_density": lambda t: statistics.density(t.n, t.e, t.t),
    "a_edge_marginals": lambda t: statistics.edge_marginals(t.n, t.e),
    "a_quantile_stats": lambda t: statistics.quantile_statistics(t.table("orders"), "o_orderpriority", "o_totalprice"),
    "a_trimmed": lambda t: statistics.trimmed_statistics(t.table("orders"), "o_orderpriority", "o_totalprice", "o_orderkey"),
    "a_equalize": lambda t: statistics.equalised(t.t),
    "a_err_prop": lambda t: statistics.propagated(_model_scores(t).withColumnRenamed("model", "key")),
    "a_quality_scores": lambda t: statistics.quality_scores(t.table("customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 97 / 97.0).alias("real"), (F.col("c_custkey") % 89 / 89.0).alias("gen"), (F.col("c_custkey") % 83 / 83.0).alias("both"), (F.col("c_custkey") % 79 / 79.0).alias("accuracy"), (F.col("c_custkey") % 73 / 73.0).alias("similarity"))),
    "a_score_rank": lambda t: statistics.dominance_ranks(_model_scores(t)),
    "a_powerlaw": lambda t: statistics.power_law(_line_means(t)),
    "a_eds": lambda t: statistics.equivalent_data_size(_line_means(t, "l_orderkey % 2 = 0"), statistics.power_law(_line_means(t))),
    "j_injective": lambda t: matching.injective_matches(t.e, [{"PROMO": 1}, {"STANDARD": 1}]),
    "j_virtual_match": lambda t: matching.virtual_matches(t.n, t.e),
    "s_disjoint_paths": lambda t: paths.disjoint_paths(_nation_links(t), 0, 24),
    "g_sparse_neighbors": lambda t: contexts.sparse_graph(t.p),
    "p_pair_context": lambda t: contexts.pair_contexts(t.p, _label_ends(t)),
    "g_traversal_order": lambda t: traversal.traversal_order(t.n, t.e.where("label = 'flag'")),
    "a_path_score": lambda t: statistics.value_path_scores(_paths(t)),
    "a_degree_penalty": lambda t: statistics.degree_penalty(_line_weights(t)),
    "a_beta_posterior": lambda t: statistics.beta_posterior(t.table("events").select(F.col("user_id").alias("key"), (F.pmod(F.col("event_id"), F.lit(101)) / 100.0).alias("r"))),
    "a_learned_weights": lambda t: statistics.learned_weights(t.table("events").select(F.col("user_id").alias("key"), (F.col("event_type") != "error").alias("ok"))),
    "a_edge_prob": lambda t: statistics.edge_probabilities(statistics.node_pairs(t.n, t.e), _asked_pairs(t)),
    "a_similarity_entropy": lambda t: matching.similarity_entropy(matching.nearest(t.p), t.p.select("id", (F.col("label") < 5).alias("own"))),
    "p_closest": lambda t: matching.closest_to_mean(t.p),
    "g_connect": lambda t: paths.bridges(paths.component_labels(t.n, t.e.where("label = 'flag'"))),
    "s_pairs": lambda t: sampling.random_pairs(t.t, "graph_id", "target"),
    "s_seeds": lambda t: sampling.seeds(t.t, "graph_id", 25),
    "s_weighted_order": lambda t: sampling.weighted_order(t.table("customer"), "c_nationkey", "c_custkey", "c_acctbal"),
    "s_topk": lambda t: sampling.top_k(t.table("orders"), "o_orderpriority", "o_orderkey", "o_totalprice", 10),
    "s_temperature": lambda t: sampling.temperature(t.table("customer"), "c_nationkey", "c_custkey", "c_acctbal", 0.5),
    "s_dedup": lambda t: sampling.first_of_each(t.hashes),
    "s_novel": lambda t: sampling.novel(t.hashes.where("graph_id % 2 = 1"), t.hashes.where("graph_id % 2 = 0")).select("graph_id"),
    "s_accept_interval": lambda t: sampling.accepted(t.table("part").select(F.col("p_partkey").alias("key"), F.array(F.col("p_size") / 50.0, 1 - F.col("p_size") / 50.0).alias("p")), "key", 0.4, 0.7),
    "s_unseen": lambda t: sampling.unseen(rewriting.state_keys(t.e).where("graph_id % 2 = 1").withColumnRenamed("state_key", "key"), rewriting.state_keys(t.e).where("graph_id % 2 = 0").withColumnRenamed("state_key", "key")).select("graph_id"),
    "s_beam": lambda t: sampling.beam(t.table("customer"), "c_nationkey", "c_custkey", "c_acctbal", 8),
    "s_farthest_point": lambda t: sampling.farthest_points(t.p, 8),
    "g_components": lambda t: paths.component_labels(t.n, t.e.where("label = 'flag'")),
    "g_largest_component": lambda t: paths.largest_components(t.n, t.e.where("label = 'flag'")),
    "g_bfs_order": lambda t: paths.hops(t.n, t.e),
    "g_shortest_path": lambda t: paths.shortest_distances(_nation_links(t), 0).select("id", F.round("dist", 6).alias("dist")),
    "g_mst_knn": lambda t: paths.spanning_tree(_nation_links(t)).select("src", "dst", F.round("w", 6).alias("w")),
    "g_node_features": lambda t: structure.rounded(structure.node_features(t.n, t.e).drop("betweenness")),
    "g_betweenness": lambda t: structure.rounded(structure.node_features(t.n, t.e)).select("graph_id", "node_id", "betweenness"),
    "g_scaled_features": lambda t: structure.scaled_features(t.n, t.e),
    "g_norm_adj": lambda t: paths.normalised_adjacency(t.n, t.e),
    "p_replace_single": lambda t: rewriting.replacements(t.e),
    "p_replace_graph": lambda t: rewriting.replaced(t.e),
    "p_prune_step": lambda t: rewriting.pruned(t.e),
    "p_missing_edges": lambda t: rewriting.missing_edges(t.n, t.e),
    "p_remove_edges": lambda t: rewriting.removed_edges(t.e, 0.5),
    "p_edge_neighbors": lambda t: rewriting.edge_neighbours(t.n, t.e),
    "p_edge_dataset": lambda t: rewriting.edge_dataset(t.e),
    "p_edge_prefixes": lambda t: rewriting.edge_prefixes(t.e),
    "p_edge_negatives": lambda t: rewriting.edge_negatives(t.n, t.e),
    "g_connect_all": lambda t: paths.connected(paths.component_labels(t.n, t.e.where("label = 'flag'"))),
    "p_beam_step": lambda t: rewriting.beam_step(t.n, t.e),
    "p_surgical_blame": lambda t: rewriting.edge_blame(t.e),
    "p_unify": lambda t: rewriting.unified(t.e),
    "p_components": lambda t: matching.components(t.e),
    "p_ports": lambda t: matching.ports(t.e),
    "p_assoc_map": lambda t: rewriting.association_map(t.e),
    "p_target_signatures": lambda t: rewriting.target_signatures(t.e),
    "p_seed_node": lambda t: rewriting.seed_nodes(matching.components(t.e)),
    "p_gran_sample": lambda t: rewriting.gran_sample(statistics.sizes(t.n), 0.3),
    "p_mmr_select": lambda t: optimise.greedy_selection(_scored_points(t), 8, 0.7),
    "p_thompson_select": lambda t: optimise.thompson_selection(_scored_points(t), 6, 0.5, 0.7),
    "p_swap_refine": lambda t: optimise.swapped(_scored_points(t), _scored_points(t).orderBy(F.desc("score"), "id").limit(6).select("id"), 2, 0.7, 2),
    "p_grow": lambda t: rewriting.grown(t.n, t.e),
    "p_prune_sequence": lambda t: decompositions.pruning_sequences(t.n, t.e),
    "k_index_neighbourhood": lambda t: decompositions.index(decompositions.by_neighbourhood(t.n, t.e), t.n, t.e),
    "k_index_triangle": lambda t: decompositions.index(decompositions.by_triangle(t.n, t.e), t.n, t.e, "inner"),
    "k_index_component": lambda t: decompositions.index(decompositions.by_component(t.n, t.e.where("label = 'flag'")), t.n, t.e, "label"),
    "a_bootstrap": lambda t: statistics.bootstrapped(t.t),
    "a_resample": lambda t: statistics.resampled(t.t, 100),
    "m_diffusion_nll": lambda t: models.diffusion_terms(t.n, statistics.node_marginals(t.n), [0.1, 0.3, 0.6]),
    "p_repair_choice": lambda t: repair.repairs(t.n, t.e, *_sources_donors(t)).withColumns({c: F.round(c, 6) for c in ("before", "after")}),
    "p_repair_graph": lambda t: repair.repaired(t.e, repair.repairs(t.n, t.e, *_sources_donors(t))),
    "k_cut_variants": lambda t: cuts.variants(t.n, t.e, 1.5).withColumn("context", F.array_join(F.transform("context", lambda v: v.cast("int").cast("string")), ",")),
    "p_resume_signature": lambda t: rewriting.resume_signature(t.hashes, "steps=50"),
    "m_beta_schedule": lambda t: models.beta_warm_up(t.spark),
    "m_cosine_schedule": lambda t: models.cosine_schedule(t.spark),
    "m_transition": lambda t: models.transition(statistics.edge_marginals(t.n, t.e).select("label", "p"), 0.1),
    "m_posterior": lambda t: models.posterior(statistics.edge_marginals(t.n, t.e).select("label", "p"), 0.1, 0.4),
    "m_vgae_loss": lambda t: models.weighted_cross_entropy(t.table("lineitem").select(F.col("l_returnflag"), (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_quantity") / 51.0).alias("p")), "l_returnflag"),
    "m_vgae_kl": lambda t: models.latent_divergence(t.table("embeddings").select("label", F.col("embedding").cast("array<double>").alias("mean"), F.transform("embedding", lambda x: x.cast("double") / 2 - 1).alias("logstd")), "label"),
    "m_vgae_ranking": lambda t: models.ranking_loss(t.table("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_quantity") / 51.0).alias("p")), "l_returnflag", ["l_orderkey", "l_linenumber"]),
    "m_latent_summary": lambda t: models.latent_summary(t.p),
    "m_threshold": lambda t: models.calibrated_threshold(t.table("lineitem").withColumn("q", F.col("l_quantity") / 51.0), "l_returnflag", "q", 0.2),
    "m_encode": lambda t: models.one_hot(t.n),
    "m_balanced_accuracy": lambda t: models.balanced_accuracy(_label_pairs(t)),
    "m_f1": lambda t: models.f1(_label_pairs(t)),
    "m_target_score": lambda t: models.target_scores(t.table("part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("predicted"), (F.col("p_partkey") % 50).alias("target"))),
    "m_unit_vectors": lambda t: models.unit_vectors(t.p),
    "m_context_sum": lambda t: models.context_sums(t.n.select("graph_id", "node_id", bucket(F.col("label"), 6).alias("bucket")), cuts.balls(t.n, t.e, 1)),
    "m_cosine": lambda t: models.cosines(t.n.groupBy(F.col("graph_id").alias("key"), bucket(F.col("label"), 6).alias("bucket")).agg(F.count("*").alias("n")), t.n.select(F.col("graph_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)),
    "f_feature_anti": lambda t: models.unknown_features(_graph_split(cuts.radius_hash(t.n, t.e))[1], _graph_split(cuts.radius_hash(t.n, t.e))[0]),
    "f_node_range": lambda t: models.outside_range(_graph_split(statistics.sizes(t.n))[1], _graph_split(statistics.sizes(t.n))[0]),
    "f_state_key": lambda t: rewriting.state_keys(t.e),
    "f_templates": lambda t: t.e.groupBy("label").agg(F.count("*").alias("n")),
    "f_validate": lambda t: corpora.validate(t.n, t.e, 10),
    "w_hourly_counts": lambda t: streams.hourly_counts(t.table("events")),
    "w_sessions": lambda t: streams.sessions(t.table("events")),
    "w_running_weights": lambda t: streams.running_weights(t.table("events")),
    "u_transitions": lambda t: t.u,
}

QUERIES: dict[str, Query] = {name: _query(f) for name, f in _BY_NAME.items()}
