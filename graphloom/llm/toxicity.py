"""Toxicity by class-conditional Kneser-Ney models.

The toxic and the ordinary class have a model each of the words in labelled documents: absolute discounting of the
class's own counts, and a back-off that both share, the share of documents that hold the word over all documents,
labelled or not. So that rare and unseen expressions count as well, the back-off is tilted by a second pair
of Kneser-Ney models over the characters of words, whose lower orders are shared in the same way. A third pair knows the
order of words: bigrams, backed off to a word's continuation count in the class (the distinct words before it) and from there
to the shared counts. A document is judged by length-normalised log-likelihood ratios (of its most toxic words, of its most
toxic passage and of the whole), which a logistic regression on labelled documents that the models haven't seen turns into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import crc_fold, pieces, small_side, written

ORDER = 6
TILT = 4.0  # bound on what the characters add to a word's log-likelihood ratio
DISCOUNT = 0.75
PASSAGE = 8  # words
COUNTED = 40_000  # labelled documents behind the class counts, at most: those with the smallest hash of doc_id
CALIBRATED = 6_000  # labelled documents behind the calibration, at most
PAIRED = 12_000_000  # characters of the counted documents behind the word pairs, at most; a text over a fiftieth of that takes no part
START, END = "^", "$"
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000  # distinct words held in a task before it hands them on
_KNOWN = 400_000  # words whose ratio a task remembers


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, toxic_apart, ordinary_apart, docs) over docs (text, label: 1, 0 or null, apart).

    Occurrences by class, those in documents that are set apart for the calibration on their own, and documents of any label.
    """
    names = ["ordinary", "toxic", "ordinary_apart", "toxic_apart", "docs"]

    def count(batches):
        held = [Counter() for _ in names]

        def rows():
            for k, c in enumerate(held):
                n, none = pa.array(c.values(), pa.int64()), pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), *(n if k == j else none for j in range(len(names)))], names=["word", *names])
                c.clear()

        for batch in pieces(batches, "text"):
            for text, label, apart in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "apart")), strict=True):
                found = words(text)
                if label is not None:
                    held[label + 2 * apart].update(found)
                held[4].update(set(found))
            if sum(map(len, held)) > _FLUSH:
                yield from rows()
        yield from rows()

    out = docs.select("text", "label", "apart").mapInArrow(count, "word string, " + ", ".join(f"{n} long" for n in names))
    return out.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def character_ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) for the grams that a class has counted, and (context, ratio) for other characters after a context.

    ratio: log of the toxic model's probability over the ordinary one's. A context that neither class has seen has 0.
    """
    text = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    grams = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - order + 1), lambda i: F.substr(text, i, F.lit(order)))).alias("gram"), "toxic", "ordinary")
    grams = written(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))

    head, tail = F.expr("left(gram, length(gram) - 1)"), F.expr("substr(gram, 2)")
    continued = [grams.groupBy(tail.alias("gram")).agg(F.count("*").alias("n"))]
    for _ in range(order - 2):
        continued.append(continued[-1].groupBy(tail.alias("gram")).agg(F.count("*").alias("n")))
    singles = continued[-1].agg(F.sum("n")).first()[0] or 1
    shared = continued[-1].select("gram", (F.col("n") / singles).alias("p"))
    for level in continued[-2::-1]:
        context = level.groupBy(head.alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        with_context = level.withColumn("context", head).join(context, "context").withColumn("lower", tail)
        p = (F.col("n") - discount + discount * F.col("kinds") * F.col("p")) / F.col("all")
        shared = with_context.join(shared.withColumnRenamed("gram", "lower"), "lower").select("gram", p.alias("p"))

    seen = grams.where("toxic > 0 or ordinary > 0").withColumn("context", head)
    sums = [F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")] + [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    contexts = written(seen.groupBy("context").agg(*sums))
    left = {c: F.when(F.col(f"{c}_all") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0) for c in ("toxic", "ordinary")}
    own = {c: F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0) for c in ("toxic", "ordinary")}
    at = seen.join(contexts, "context").withColumn("lower", tail).join(shared.withColumnRenamed("gram", "lower"), "lower")
    return at.select("gram", F.log((own["toxic"] + left["toxic"] * F.col("p")) / (own["ordinary"] + left["ordinary"] * F.col("p"))).alias("ratio")), contexts.select("context", F.log(left["toxic"] / left["ordinary"]).alias("ratio"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(before, word, toxic, ordinary, toxic_apart, ordinary_apart) over docs (text, label, apart): how often a word follows another; START is before a text's first word."""
    names = ["ordinary", "toxic", "ordinary_apart", "toxic_apart"]

    def count(batches):
        for batch in pieces(batches, "text"):
            held = [Counter() for _ in names]
            for text, label, apart in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "apart")), strict=True):
                found = words(text)
                held[label + 2 * apart].update(zip([START, *found], found, strict=False))
            for k, c in enumerate(held):
                n, none = pa.array(c.values(), pa.int64()), pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in c], pa.string()), pa.array([w for _, w in c], pa.string()), *(n if k == j else none for j in range(len(names)))], names=["before", "word", *names])

    out = docs.select("text", "label", "apart").mapInArrow(count, "before string, word string, " + ", ".join(f"{n} long" for n in names))
    return out.groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in names))


def paired(counted: DataFrame, texts: DataFrame, characters: int = PAIRED) -> DataFrame:
    """The rows of counted (doc_id, label, apart; at most COUNTED) with the smallest hash of doc_id whose texts have so many characters together; longer ones than a fiftieth take no part."""
    sizes = texts.join(small_side(counted, COUNTED), "doc_id").groupBy("doc_id", "label", "apart").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    fitting = sizes.where(F.col("size") * 50 <= characters)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most COUNTED rows of numbers
    return fitting.withColumn("so_far", F.sum("size").over(order)).where(F.col("so_far") <= characters).select("doc_id", "label", "apart")


CLASSES = ("toxic", "ordinary")


class Pairs:
    """Kneser-Ney bigrams of both classes, from pair_counts and word_counts.

    P(w | v) = (c(v, w) - D) / c(v) + left(v) P(w), and P(w) = (k(w) - D) / k + left P'(w), where k(w) is the number of distinct
    words before w in the class, and P' the share of documents, which both classes have in common. A pair seen once is discounted whole (D = 1
    there), so only pairs that a class has twice are held; the mass taken goes to left(v), and probabilities sum to 1.
    """

    def __init__(self, pairs: DataFrame, counts: DataFrame, discount: float = DISCOUNT):
        taken = {c: F.when(F.col(c) > 1, discount).otherwise(F.col(c)).cast("double") for c in CLASSES}
        seen = pairs.where("toxic > 0 or ordinary > 0")
        after = seen.groupBy(F.col("word").alias("w")).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in CLASSES))
        before = seen.groupBy(F.col("before").alias("w")).agg(*(F.sum(c).alias(f"all_{c}") for c in CLASSES), *(F.sum(taken[c]).alias(f"left_{c}") for c in CLASSES))
        documents = counts.agg(F.sum("docs")).first()[0] or 1
        shared = counts.select(F.col("word").alias("w"), (F.col("docs") / documents).alias("shared"))
        columns = [*(f"{n}_{c}" for n in ("kinds", "all", "left") for c in CLASSES), "shared"]
        held = after.join(before, "w", "full").join(shared, "w", "left").select(F.xxhash64("w").alias("key"), *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in columns))
        self.keys, table = Ratios._held(held)
        table = np.c_[table, np.zeros(len(table))]  # the last column is any other word
        kinds, every, left = table[0:2], table[2:4], table[4:6]
        self.shared = np.where(table[6] > 0, table[6], 0.5 / documents)  # any other word, and START, count as half a document
        self.kinds = np.maximum(1, kinds.sum(1))
        self.own = np.maximum(kinds - discount, 0) / self.kinds[:, None]
        self.backed = np.where(kinds.sum(1) > 0, discount * (kinds > 0).sum(1) / self.kinds, 1.0)
        self.left = np.where(every > 0, left / np.maximum(every, 1), 1.0)
        top = seen.where("toxic > 1 or ordinary > 1").select(F.xxhash64("before").alias("v"), F.xxhash64("word").alias("w"), *(F.greatest(F.col(c) - taken[c], F.lit(0.0)).alias(c) for c in CLASSES)).toArrow()
        v, w = (self.ids(top.column(c).to_numpy()) for c in ("v", "w"))
        code = v * len(table[0]) + w
        by = np.argsort(code)
        self.code = code[by]
        self.top = np.stack([top.column(c).to_numpy() for c in CLASSES])[:, by] / np.maximum(every[:, v[by]], 1)
        # For many words at once: the ratio is a sum of one part by word before and one by word, but for the pairs that are held, which have theirs in full.
        self.before = np.log(self.left[0]) - np.log(self.left[1])
        low = self.own + self.backed[:, None] * self.shared
        self.alone = np.log(low[0]) - np.log(low[1])
        p = self.probabilities(v[by], w[by])
        self.whole = np.log(p[0]) - np.log(p[1])
        bits = int(8 * len(self.code) + 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # by hash of a pair: whether a pair with that hash is held
        self.maybe[self._slot(self.code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ratios(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log of the toxic probability over the ordinary one, as from probabilities."""
        r = self.before[v] + self.alone[w]
        code = v * len(self.before) + w
        at = np.flatnonzero(self.maybe[self._slot(code)])
        if len(at) and len(self.code):
            found = code[at]
            place = np.minimum(np.searchsorted(self.code, found), len(self.code) - 1)
            hit = self.code[place] == found
            r[at[hit]] = self.whole[place[hit]]
        return r

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Places of words by hash; one past the last for words that no class has."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By class, of words after words; a word that no class has seen has the probability of half a document, in both classes alike."""
        p = self.left[:, v] * (self.own[:, w] + self.backed[:, None] * self.shared[w])
        if len(self.code):
            code = v * (len(self.keys) + 1) + w
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            p += np.where(self.code[at] == code, self.top[:, at], 0)
        return p


class Ratios:
    """Log-likelihood ratios of words, from word_counts; with the character models of another instance, if one is given. pairs has those of words in order."""

    def __init__(self, counts: DataFrame, pairs: Pairs, characters: Ratios | None = None, discount: float = DISCOUNT):
        import xxhash

        self.pairs = pairs
        self.first = pairs.ids(np.array([xxhash.xxh64_intdigest(START.encode(), 42)], np.uint64).view(np.int64))
        if characters:
            self.grams, self.contexts = characters.grams, characters.contexts
        else:
            grams, contexts = character_ratios(counts)
            self.grams = self._held(grams.select(F.xxhash64("gram").alias("key"), F.col("ratio").cast("float")))
            self.contexts = self._held(contexts.select(F.xxhash64("context").alias("key"), F.col("ratio").cast("float")))
        sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("toxic", "ordinary", "docs")), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in ("toxic", "ordinary"))).first()
        self.all = {c: max(1, sums[c]) for c in ("toxic", "ordinary")}
        self.left = {c: discount * max(1, sums[f"{c}_kinds"]) for c in ("toxic", "ordinary")}
        seen = counts.where("toxic > 0 or ordinary > 0").select(F.xxhash64("word").alias("key"), *(F.greatest(F.col(c) - discount, F.lit(0.0)).cast("float").alias(c) for c in ("toxic", "ordinary")), (F.col("docs") / max(1, sums["docs"])).cast("float").alias("shared"))
        self.words = self._held(seen)
        self.unseen = 0.5 / max(1, sums["docs"])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.value, self.place = np.zeros(0), np.zeros(0, np.int64)

    @staticmethod
    def _held(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and the other columns as rows."""
        rows = df.toArrow()
        key = rows.column("key").to_numpy()
        by = np.argsort(key, kind="stable")
        return key[by], np.stack([c.to_numpy()[by] for c in rows.columns[1:]])

    @staticmethod
    def _found(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held[0]):
            return np.zeros(len(keys), bool), np.zeros((len(held[1]), len(keys)))
        at = np.minimum(np.searchsorted(held[0], keys), len(held[0]) - 1)
        hit = held[0][at] == keys
        return hit, np.where(hit, held[1][:, at], 0).astype(float)

    def learn(self, new: list[str]) -> None:
        """Adds words to those that are known: known has the index of a word in value (its ratio) and place (in pairs)."""
        import xxhash

        key = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)  # noqa: E731  as Spark's xxhash64 of a string
        keys = lambda strings, n: np.fromiter(map(key, strings), np.uint64, n).view(np.int64)
        padded = [START * (ORDER - 1) + w + END for w in new]
        size = np.array([len(w) + 1 for w in new])
        hit, value = self._found(self.grams, keys((p[i : i + ORDER] for p, n in zip(padded, size, strict=True) for i in range(n)), size.sum()))
        _, other = self._found(self.contexts, keys((p[i : i + ORDER - 1] for p, n in zip(padded, size, strict=True) for i in range(n)), size.sum()))
        tilt = np.clip(np.add.reduceat(np.where(hit, value[0], other[0]), np.cumsum(size) - size), -TILT, TILT)
        own = keys(new, len(new))
        _, (toxic, ordinary, shared) = self._found(self.words, own)
        shared = np.maximum(shared, self.unseen)
        p = (toxic + self.left["toxic"] * shared * np.exp(tilt / 2)) / self.all["toxic"]
        q = (ordinary + self.left["ordinary"] * shared * np.exp(-tilt / 2)) / self.all["ordinary"]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.value, self.place = np.append(self.value, np.log(p) - np.log(q)), np.append(self.place, self.pairs.ids(own))


FEATURES = 7


def _passages(r: np.ndarray) -> float:
    """The most toxic passage's ratio by word."""
    begin = np.arange(0, len(r), PASSAGE)
    return (np.add.reduceat(r, begin) / np.maximum(np.minimum(PASSAGE, len(r) - begin), PASSAGE // 2)).max()


def features(texts: list[str | None], ratios: Ratios) -> np.ndarray:
    """By text: the ratio of its most toxic word and of its three most toxic ones, of its most toxic passage by word, and of all by word; log of the words; the
    ratio by word of its most toxic passage and of all, with words in order."""
    found = [words(t) for t in texts]
    if len(ratios.known) > _KNOWN:
        ratios.forget()
    missing = list({w for ws in found for w in ws} - ratios.known.keys())
    if missing:
        ratios.learn(missing)
    out = np.zeros((len(texts), FEATURES))
    size = np.array([len(ws) for ws in found], np.int64)
    every = np.fromiter(map(ratios.known.__getitem__, chain.from_iterable(found)), np.int64, size.sum())
    end = np.cumsum(size)
    first, some = end - size, np.flatnonzero(size)
    value, place = ratios.value[every], ratios.place[every]
    before = np.append(ratios.first, place[:-1])
    before[first[some]] = ratios.first
    ordered = ratios.pairs.ratios(before[: len(place)], place)
    for i in some:
        r, q = value[first[i] : end[i]], ordered[first[i] : end[i]]
        top = np.sort(np.partition(r, -3)[-3:] if len(r) > 3 else r)[::-1]
        out[i] = top[0], top.sum() / 3, _passages(r), r.sum() / len(r), np.log1p(len(r)), _passages(q), q.sum() / len(r)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), and the means and scales of the features; Newton's method with a small ridge."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(FEATURES + 1)
    ridge = np.diag([0.1] * FEATURES + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return w, mean, scale


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= threshold).

    Labels count only where crc32 of doc_id as text, modulo folds, is not held_out. Half of them calibrates scores
    by models of the other half; the scores come from models of all. Null and empty texts have no words: their ratios are 0. Without labels of both classes
    every score is 0.5 or follows from the constant. Rows without a doc_id are scored and not held out; other columns are ignored.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_fold("doc_id", folds) != held_out).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    known = known.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    counted = written(known.orderBy(*by_hash).limit(COUNTED))
    calibrated = known.where("apart").orderBy(*by_hash).limit(CALIBRATED).select("doc_id", "label")
    texts = docs.select("doc_id", "text")

    counts = written(word_counts(texts.join(small_side(counted, COUNTED), "doc_id", "left")))
    pairs = written(pair_counts(texts.join(small_side(paired(counted, texts), COUNTED), "doc_id")))
    model = Ratios(counts, Pairs(pairs, counts))
    both = [(F.col(c) + F.col(f"{c}_apart")).alias(c) for c in CLASSES]
    final = Ratios(counts.select("word", "docs", *both), Pairs(pairs.select("before", "word", *both), counts), model)

    def labelled(batches):
        for batch in pieces(batches, "text"):
            x = features(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)], names=["label", *(f"x{k}" for k in range(FEATURES))])

    rows = texts.join(small_side(calibrated, CALIBRATED), "doc_id").select("text", F.col("label").cast("double")).mapInArrow(labelled, "label double, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toArrow().to_pandas().sort_values(["x0", "x1", "x2", "x3", "x4", "label"])
    weights, mean, scale = _logistic(rows.iloc[:, 1:].to_numpy(), rows["label"].to_numpy())

    def score(batches):
        for batch in pieces(batches, "text"):
            z = (features(batch.column("text").to_pylist(), final) - mean) / scale @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    out = texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
