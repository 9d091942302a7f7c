"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by its style (case, symbols, repetition,
word forms); gated attention, learned from document labels, weighs the encoded passages, and the weighted mean is
scored. The model is fitted in numpy on a bounded sample of labelled documents; every document is scored on its
whole text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_fold, pieces, written
from .words import word_hashes

PASSAGE = 64  # words
SAMPLE = 6000  # labelled documents that the model is fitted on, at most: those with the smallest hash of doc_id
SAMPLE_PASSAGES = 500_000  # passages of the sample that the model is fitted on, at most (60 bytes each)
HIDDEN, GATE = 16, 8
_PLAIN, _KINDS = b".,;:'\"()-?", 8
_KIND = np.full(256, 5, np.uint8)  # 0 lower case, 1 upper case, 2 digit, 3 usual punctuation, 4 other ASCII signs, 5 beyond ASCII, 6 '!' or '|', 7 white space
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[list(_PLAIN)], _KIND[list(b"!|")], _KIND[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3, 6, 7
FEATURES = 15


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(group, prepend=-1))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (passages x FEATURES) of all texts in order, and the number of passages of each (1 at least)."""
    blobs = [t.encode() for t in texts]
    hashes, counts = word_hashes(blobs)
    held = np.maximum(1, -(-counts // PASSAGE))
    out = np.zeros((held.sum(), FEATURES), np.float32)
    if not len(hashes):
        return out, held
    base = np.cumsum(held) - held
    doc = np.repeat(np.arange(len(blobs)), counts)
    passage = base[doc] + (np.arange(len(hashes)) - (np.cumsum(counts) - counts)[doc]) // PASSAGE
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    kind = _KIND[data]
    space = kind == 7
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    first, end = edge[::2], edge[1::2]
    at = np.flatnonzero(np.bincount(passage, minlength=len(out)))
    n = np.bincount(passage, minlength=len(out))[at].astype(np.float32)
    begin = first[_starts(passage)]
    sums = np.stack([np.add.reduceat((kind == k), begin, dtype=np.int64) for k in range(_KINDS)], 1).astype(np.float32)
    lines = np.add.reduceat(data == 10, begin, dtype=np.int64)
    length = (end - first).astype(np.float32)
    by = lambda x: np.add.reduceat(x.astype(np.float32), _starts(passage))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    pair = hashes.copy()
    pair[1:] ^= hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    size = sums[:, :7].sum(1)
    letters = sums[:, 0] + sums[:, 1] + sums[:, 5] + 1
    columns = [n / PASSAGE, length_mean := by(length) / n, np.sqrt(np.maximum(0, by(length**2) / n - length_mean**2)), sums[:, 1] / letters, *(sums[:, k] / size for k in (2, 3, 4, 5, 6)), lines / n, by(same) / n, by(data[end - 1] == 46) / n]
    for values in (hashes, pair):
        order = np.lexsort((values, passage))
        v, p = values[order], passage[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
        columns.append(np.bincount(p[new], minlength=len(out))[at] / n)
    columns.append(by(length == 1) / n)
    out[at] = np.stack(columns, 1)
    return out, held


class AttentionModel:
    """Gated attention over encoded passages: h = tanh(x W), weights softmax(w . (tanh(h V) * sigmoid(h U)))."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, held: np.ndarray):
        p, first = self.p, np.cumsum(held) - held
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, first), held))
        e /= np.repeat(np.add.reduceat(e, first), held)
        z = np.add.reduceat(h * e[:, None], first)
        return h, t, s, e, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def score(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        return self._forward(x, held)[-1]

    def fit(self, x: np.ndarray, held: np.ndarray, y: np.ndarray, steps: int = 1200, batch: int = 256, rate: float = 0.01) -> AttentionModel:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        rng, first = np.random.default_rng(1), np.cumsum(held) - held
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.choice(len(y), min(batch, len(y)), replace=False)
            size = held[pick]
            rows = np.repeat(first[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            xb = x[rows]
            h, t, s, e, z, out = self._forward(xb, size)
            p, g = self.p, (out - y[pick]) / len(pick)
            dz = g[:, None] * p["c"]
            dz_row = np.repeat(dz, size, 0)
            de = (h * dz_row).sum(1)
            da = e * (de - np.repeat(np.add.reduceat(e * de, np.cumsum(size) - size), size))
            dt, ds = da[:, None] * s * p["w"] * (1 - t**2), da[:, None] * t * p["w"] * s * (1 - s)
            dh = (e[:, None] * dz_row + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
            grad = {"W": ((xb - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "c": z.T @ g, "d": g.sum(keepdims=True)}
            for k in p:
                step_grad = grad[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * step_grad
                v[k] = 0.999 * v[k] + 0.001 * step_grad**2
                p[k] -= rate * (1 - step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(batches):
    for batch in pieces(batches, "text"):
        x, held = encode([t or "" for t in batch.column("text").to_pylist()])
        cut = np.split(x, np.cumsum(held)[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array([c.tobytes() for c in cut], pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> AttentionModel | None:
    """A model of labels (doc_id, label 0 or 1) over docs (doc_id, text), from at most sample documents; None without any.

    Of rows that repeat a doc_id one takes part. Where the sample's texts have more passages than the given number, documents
    are taken by the hash of doc_id and those that no longer fit are passed over: what the driver holds is bounded.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_bags, "doc_id long, label double, bag binary")
    bags = written(bags.groupBy("doc_id").agg(F.max(F.struct("bag", "label")).alias("one")).select("doc_id", "one.*"))
    room, within = passages * 4 * FEATURES, []
    for row in bags.select("doc_id", F.length("bag").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # a row for each of the sample
        if row["bytes"] <= room:
            room -= row["bytes"]
            within.append((row["doc_id"],))
    bags = bags.join(F.broadcast(docs.sparkSession.createDataFrame(within, "doc_id long")), "doc_id").select("label", "bag").toArrow()
    if not bags.num_rows:
        return None
    model = AttentionModel()
    cut = sorted(zip(bags.column("bag").to_pylist(), bags.column("label").to_pylist(), strict=True))  # the same order on every run
    x = np.frombuffer(b"".join(b for b, _ in cut), np.float32).reshape(-1, FEATURES).astype(float)
    return model.fit(x, np.array([len(b) // (4 * FEATURES) for b, _ in cut]), np.array([y for _, y in cut]))


def scored(docs: DataFrame, model: AttentionModel | None, name: str = "score") -> DataFrame:
    """docs with the column name: the model's probability of label 1 for the whole text; 0.5 for all without a model.

    A null text counts as empty. An empty text is one passage without words, and has that passage's score. Only the text
    goes through Python. A column of that name in docs is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [model.score(*encode([t or "" for t in piece.column("text").to_pylist()])) for piece in pieces([pa.record_batch([texts], names=["text"])], "text")]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= 0.5).

    Labels count only where crc32 of doc_id as text, modulo folds, is not held_out. Without any such label every
    score is 0.5. Rows without a doc_id are scored and not held out; other columns are ignored.
    """
    model = fit(docs, labels.where(crc_fold("doc_id", folds) != held_out).select("doc_id", F.col("quality").alias("label")))
    out = scored(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
