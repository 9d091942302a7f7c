"""Formulas of the learned models that need no training: noise schedules, transitions, posteriors, losses, scores, cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.corpora import saved


def cosine_schedule(spark: SparkSession, steps: int = 50, s: float = 0.008, most: float = 0.9999) -> DataFrame:
    """(t, beta, alpha_bar): the discrete cosine noise schedule, and the running product of 1 - beta."""
    half_pi = 1.5707963267948966
    f = lambda t: F.cos(half_pi * ((t / float(steps + 2)) + s) / (1 + s)) ** 2
    beta = spark.range(steps + 1).select(F.col("id").cast("int").alias("t"), F.least(1 - f(F.col("id") + 1) / f(F.col("id")), F.lit(most)).alias("beta"))
    total = F.sum(F.log(1 - F.col("beta"))).over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return beta.select("t", F.round("beta", 6).alias("beta"), F.round(F.exp(total), 6).alias("alpha_bar"))


def transition(marginals: DataFrame, beta: float) -> DataFrame:
    """(i, j, v): (1 - beta) I + beta times the marginal rows, in coordinates; marginals has (label, p)."""
    i, j = marginals.select(F.col("label").alias("i")), marginals.select(F.col("label").alias("j"), "p")
    return i.join(F.broadcast(j), F.lit(True)).select("i", "j", F.round(F.lit(beta) * F.col("p") + F.when(F.col("i") == F.col("j"), 1 - beta).otherwise(0.0), 6).alias("v"))


def posterior(marginals: DataFrame, beta: float, alpha_bar: float) -> DataFrame:
    """(x, z, s, p): q(z_s | z_t = z, x) for all classes, from the one-step and the cumulative transition; 1e-7 added before normalising."""
    a = marginals.select(F.col("label").alias("x"))
    b = marginals.select(F.col("label").alias("z"), F.col("p").alias("pz"))
    c = marginals.select(F.col("label").alias("s"), F.col("p").alias("ps"))
    same = lambda l, r, keep: F.when(F.col(l) == F.col(r), keep).otherwise(0.0)
    raw = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True)).withColumn("w", (F.lit(beta) * F.col("pz") + same("s", "z", 1 - beta)) * (F.lit(1 - alpha_bar) * F.col("ps") + same("x", "s", alpha_bar)) + 1e-7)
    return raw.select("x", "z", "s", F.round(F.col("w") / F.sum("w").over(W.partitionBy("x", "z")), 6).alias("p"))


def beta_warm_up(spark: SparkSession, epochs: int = 40, warm: int = 20, most: float = 0.5) -> DataFrame:
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), F.round(F.least(F.col("id") / float(warm), F.lit(1.0)) * most, 6).alias("beta"))


def weighted_cross_entropy(df: DataFrame, by: str) -> DataFrame:
    """(by, n, loss) of predictions (by, y, p): binary cross-entropy, positives weighted by negatives over positives."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(F.when(F.col("y") == 1, -F.log(p)).otherwise(0.0)).alias("lp"), F.sum(F.when(F.col("y") == 0, -F.log(1 - p)).otherwise(0.0)).alias("ln"))
    weight = F.when(F.col("pos") > 0, (F.col("n") - F.col("pos")) / F.col("pos")).otherwise(1.0)
    return out.select(by, "n", F.round((weight * F.col("lp") + F.col("ln")) / F.col("n"), 6).alias("loss"))


def latent_divergence(points: DataFrame, by: str) -> DataFrame:
    """(by, n, kl) of latent points (by, mean, logstd): the term that a beta weighs, half the mean over points of sum(1 + 2 logstd - mean^2 - exp(2 logstd)), over their number.

    Points without one of the vectors, or with vectors of different lengths, take no part.
    """
    part = F.zip_with("mean", "logstd", lambda m, s: 1 + 2 * s - m * m - F.exp(2 * s))
    each = points.where(F.size("mean") == F.size("logstd")).select(by, F.aggregate(part, F.lit(0.0), lambda a, x: a + x).alias("v"))
    return each.groupBy(by).agg(F.count("v").alias("n"), F.round(0.5 * F.avg("v") / F.count("v"), 6).alias("kl"))


def ranking_loss(df: DataFrame, by: str, key: list[str], most: int = 256, seed: str = "0") -> DataFrame:
    """(by, n_pairs, loss) of predictions (by, y, p, key): mean softplus(p of a negative - p of a positive) over as many disjoint seeded pairs as there are, at most most.

    Rows without y or p take no part. A group without positives or without negatives has no pair and a loss of 0. Only the first most of a class are kept before the shuffle.
    """
    order = W.partitionBy(by, "y").orderBy(F.md5(F.concat_ws("|", F.lit(seed), *key)), "p")
    drawn = saved(df.where("y is not null and p is not null").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select(by, "y", "p", "k"))
    side = lambda y, name: drawn.where(F.col("y") == y).select(by, "k", F.col("p").alias(name))
    pairs = side(1, "positive").join(side(0, "negative"), [by, "k"])
    loss = pairs.groupBy(by).agg(F.count("*").alias("n_pairs"), F.avg(F.log1p(F.exp(F.col("negative") - F.col("positive")))).alias("loss"))
    return drawn.select(by).distinct().join(loss, by, "left").select(by, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.round(F.coalesce("loss", F.lit(0.0)), 6).alias("loss"))


def latent_summary(points: DataFrame) -> DataFrame:
    """(label, dim, mean, std): by label and dimension of points (label, x), the mean and population deviation plus 1e-4."""
    each = points.select("label", F.posexplode("x").alias("dim", "v"))
    return each.groupBy("label", "dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v") + 1e-4, 6).alias("std"))


def calibrated_threshold(df: DataFrame, by: str, value: str, density: float, previous: float = 0.5, smooth: float = 0.5) -> DataFrame:
    """(by, threshold): the 1 - density quantile, smoothed with the previous threshold and clipped to [0.05, 0.95]."""
    q = df.groupBy(by).agg(F.percentile(value, 1 - density).alias("q"))
    return q.select(by, F.round(F.least(F.greatest(smooth * previous + (1 - smooth) * F.col("q"), F.lit(0.05)), F.lit(0.95)), 6).alias("threshold"))


def one_hot(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, class): the index of each node's label in the sorted vocabulary."""
    vocabulary = nodes.select("label").distinct().withColumn("class", F.row_number().over(W.orderBy("label")) - 1)
    return nodes.join(vocabulary, "label").select("graph_id", "node_id", "class")


def balanced_accuracy(df: DataFrame) -> DataFrame:
    """(score, adjusted) of predictions (y, z): mean recall over classes, and the same with chance at 0."""
    recall = df.groupBy("y").agg(F.avg((F.col("y") == F.col("z")).cast("double")).alias("r"))
    out = recall.agg(F.avg("r").alias("s"), F.count("*").alias("k"))
    return out.select(F.round("s", 6).alias("score"), F.round(F.greatest((F.col("s") - 1.0 / F.col("k")) / (1 - 1.0 / F.col("k")), F.lit(0.0)), 6).alias("adjusted"))


def f1(df: DataFrame) -> DataFrame:
    """(n, f1) of predictions (y, z) of 0 and 1; the positive class is 1."""
    count = lambda c: F.count(F.when(c, 1))
    tp, fp, fn = count((F.col("y") == 1) & (F.col("z") == 1)), count((F.col("y") == 0) & (F.col("z") == 1)), count((F.col("y") == 1) & (F.col("z") == 0))
    return df.agg(F.count("*").alias("n"), F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 6).alias("f1"))


def target_scores(df: DataFrame) -> DataFrame:
    """(key, score): 1 / (1 + |predicted - target|) of rows (key, predicted, target)."""
    return df.select("key", F.round(1 / (1 + F.abs(F.col("predicted") - F.col("target"))), 6).alias("score"))


def unit_vectors(points: DataFrame) -> DataFrame:
    """(id, norm, first): the norm of each vector, and the first component of its unit vector; a zero vector keeps its length."""
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return points.select("id", F.round(norm, 6).alias("norm"), F.round(F.get("x", 0) / F.when(norm > 0, norm).otherwise(1.0), 6).alias("first"))


def context_sums(counts: DataFrame, balls: DataFrame) -> DataFrame:
    """(graph_id, root, bucket, n): summed features (graph_id, node_id, bucket) over each ball (graph_id, root, node_id)."""
    return balls.join(counts, ["graph_id", "node_id"]).groupBy("graph_id", "root", "bucket").agg(F.count("*").alias("n"))


def cosines(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of sparse vectors (key, bucket, n) for pairs (a, b); 0 where a norm is 0 or nothing is shared."""
    norm = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    left, right = vectors.select(F.col("key").alias("a"), "bucket", F.col("n").alias("x")), vectors.select(F.col("key").alias("b"), "bucket", F.col("n").alias("y"))
    dot = pairs.join(left, "a").join(right, ["b", "bucket"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col("key").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("key").alias("b"), F.col("norm").alias("nb")), "b", "left")
    return out.select("a", "b", F.round(F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)), 6).alias("cosine"))


def unknown_features(hashes: DataFrame, training: DataFrame) -> DataFrame:
    """(graph_id, n_violations): features (graph_id, hash) that the training features don't hold."""
    return hashes.join(training.select("hash").distinct(), "hash", "left_anti").groupBy("graph_id").agg(F.count("*").alias("n_violations"))


def outside_range(sizes: DataFrame, training: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, feasible): whether a graph's size is within the training sizes."""
    span = training.agg(F.min("n_nodes").alias("low"), F.max("n_nodes").alias("high"))
    return sizes.join(F.broadcast(span), F.lit(True)).select("graph_id", "n_nodes", F.col("n_nodes").between(F.col("low"), F.col("high")).alias("feasible"))


EPS = 1e-7


def diffusion_terms(nodes: DataFrame, marginals: DataFrame, betas: list[float], keep: float = 0.5, seed: str = "37") -> DataFrame:
    """(graph_id, t, log_pn, kl_prior, loss_t, log_p0, nll): the bound on -log p of each graph's node labels, for each step t of betas at once.

    marginals (label, p) is the limit of the noise; step t mixes the labels with it by betas[t - 1]. A noisy label is drawn for each node and
    t by seed. The predicted label is taken as the true one with a weight of keep and as the limit else. Only nodes that exist have
    rows, so nothing needs to be masked; distributions get 1e-7 and are normalised before logs. log_pn: of the graph's size among all
    sizes. kl_prior: of the last step to the limit. loss_t: steps times KL of q(z before | z, x) to its mean over predicted labels. log_p0: log of
    the predicted label. All terms follow from a node's label, noisy label and t, so they are computed once for each of those and joined.
    """
    spark, steps = nodes.sparkSession, len(betas)
    bars, bar = [], 1.0
    for b in betas:
        bar *= 1 - b
        bars.append(bar)
    times = spark.createDataFrame([(t + 1, float(betas[t]), bars[t], bars[t - 1] if t else 1.0) for t in range(steps)], "t int, beta double, bar double, before double")
    m = saved(marginals.select("label", "p"))
    one = lambda name, p=None: m.select(F.col("label").alias(name), *([F.col("p").alias(p)] if p else []))
    same = lambda a, b, w: F.when(F.col(a) == F.col(b), w).otherwise(0.0)

    every = times.join(F.broadcast(one("x")), F.lit(True)).join(F.broadcast(one("z", "pz")), F.lit(True)).join(F.broadcast(one("s", "ps")), F.lit(True))  # labels to the third power
    raw = (F.col("beta") * F.col("pz") + same("s", "z", 1 - F.col("beta"))) * ((1 - F.col("before")) * F.col("ps") + same("x", "s", F.col("before"))) + EPS
    q = saved(every.select("t", "x", "z", "s", raw.alias("raw")).withColumn("q", F.col("raw") / F.sum("raw").over(W.partitionBy("t", "x", "z"))).select("t", "x", "z", "s", "q"))
    mean = q.join(F.broadcast(one("x", "px")), "x").groupBy("t", "z", "s").agg(F.sum(F.col("q") * F.col("px")).alias("mean"))
    predicted = keep * F.col("q") + (1 - keep) * F.col("mean")
    loss = saved(q.join(mean, ["t", "z", "s"]).groupBy("t", "x", "z").agg((steps * F.sum(F.col("q") * F.log(F.col("q") / predicted))).alias("loss_t")))

    last = one("x").join(F.broadcast(one("s", "ps")), F.lit(True)).withColumn("q", (1 - bars[-1]) * F.col("ps") + same("x", "s", bars[-1]) + EPS).withColumn("limit", F.col("ps") + EPS)
    total = W.partitionBy("x")
    prior = last.withColumn("q", F.col("q") / F.sum("q").over(total)).withColumn("limit", F.col("limit") / F.sum("limit").over(total)).groupBy("x").agg(F.sum(F.col("q") * F.log(F.col("q") / F.col("limit"))).alias("kl"))
    zero = m.select(F.col("label").alias("x"), F.log((keep + (1 - keep) * F.col("p") + EPS) / (1 + EPS * F.count("*").over(W.partitionBy()))).alias("log_p"))
    own = prior.join(F.broadcast(zero), "x")

    cumulated = F.sum("p").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, 0))  # as many rows as labels
    limits = m.select("label", cumulated.alias("upto")).agg(F.array_sort(F.collect_list(F.struct("upto", "label"))).alias("limits"))
    u = lambda what: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), *(F.col(c).cast("string") for c in ("graph_id", "node_id", "t")))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    at = nodes.select("graph_id", "node_id", F.col("label").alias("x")).join(F.broadcast(times), F.lit(True)).join(F.broadcast(limits), F.lit(True))
    later = F.filter("limits", lambda y: y["upto"] > u("label"))
    noise = F.coalesce(F.get(later, F.lit(0))["label"], F.element_at("limits", F.lit(-1))["label"])
    drawn = at.select("graph_id", "t", "x", F.when(u("keep") < F.col("bar"), F.col("x")).otherwise(noise).alias("z"))
    terms = drawn.join(loss, ["t", "x", "z"]).join(own, "x").groupBy("graph_id", "t").agg(F.sum("kl").alias("kl_prior"), F.sum("loss_t").alias("loss_t"), F.sum("log_p").alias("log_p0"), F.count("*").alias("n"))
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("graphs"))
    sized = sizes.withColumn("log_pn", F.log(F.col("graphs") / F.sum("graphs").over(W.partitionBy()))).select("n", "log_pn")
    out = terms.join(sized, "n")
    nll = -F.col("log_pn") + F.col("kl_prior") + F.col("loss_t") - F.col("log_p0")
    return out.select("graph_id", "t", *(F.round(c, 5).alias(n) for n, c in (("log_pn", F.col("log_pn")), ("kl_prior", F.col("kl_prior")), ("loss_t", F.col("loss_t")), ("log_p0", F.col("log_p0")), ("nll", nll))))
