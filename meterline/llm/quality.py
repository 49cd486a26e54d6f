"""Quality classifier (operator 9): random-indexing word vectors, pooled, under a two-layer network.

Random indexing: every word has a sparse random *index vector*; its *context vector* sums the index vectors of the
words around it, over all documents. A document is the mean and the spread of the normalised context vectors of its
words, with a few counts of its shape. A two-layer network in numpy maps that to a logit, and a temperature fitted
on rows kept out of training makes it a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytewords import WORD_OR_MARK, words_of
from .tables import col, held_out, map_texts, steps, sum_vectors, texts_of

#: Words hash into this many vectors of this many dimensions; an index vector has so many entries of +1 or -1.
WORDS, DIM, ENTRIES, WINDOW = 1 << 13, 32, 2, 2
SHAPE = 7


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return r.integers(0, DIM, (WORDS, ENTRIES)), r.choice([-1.0, 1.0], (WORDS, ENTRIES))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(51)).astype(np.int64)


def word_vectors(documents: DataFrame, *, text: str = "text") -> np.ndarray:
    """The context vectors of all hashed words over all texts (WORDS x DIM); one partial sum a task, then sums by slice."""
    ship(documents.sparkSession)
    width = 256

    def run(batches):
        place, sign = _index_vectors()
        total = np.zeros(WORDS * DIM)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in steps(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                w = words_of(texts.slice(a, b - a), WORD_OR_MARK, lower=False)
                x = _buckets(w.hash)
                for o in range(1, WINDOW + 1):
                    same = np.flatnonzero(w.doc[o:] == w.doc[:-o])
                    left, right = x[same], x[same + o]
                    for e in range(ENTRIES):
                        total += np.bincount(left * DIM + place[right, e], sign[right, e], WORDS * DIM)
                        total += np.bincount(right * DIM + place[left, e], sign[left, e], WORDS * DIM)
        part = total.reshape(WORDS // width, width * DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)), pa.int32()), pa.array([p.astype("<f8").tobytes() for p in part], pa.binary())], names=["part", "v"])

    out = np.zeros((WORDS, DIM))
    parts = documents.select(col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "part int, v binary")
    for r in sum_vectors(parts, "<f8").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["v"], "<f8").reshape(width, DIM)
    return out


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row a text: mean and spread of its words' unit vectors, and SHAPE numbers. ``vectors`` has unit rows."""
    w = words_of(texts, WORD_OR_MARK, lower=False)
    n = len(w.first) - 1
    x = _buckets(w.hash)
    out = np.zeros((n, 2 * DIM + SHAPE))
    mark = WORD_OR_MARK[w.data[w.start]] == 2 if len(x) else np.zeros(0, bool)
    upper = (w.data[w.start] >= 65) & (w.data[w.start] <= 90) & (w.data[w.end - 1] >= 65) & (w.data[w.end - 1] <= 90) if len(x) else np.zeros(0, bool)
    digit = (w.data[w.start] >= 48) & (w.data[w.start] <= 57) if len(x) else np.zeros(0, bool)
    again = np.zeros(len(x), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    for d in range(n):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        seen = np.bincount(x[a:b], minlength=WORDS)
        at = np.flatnonzero(seen)
        share = seen[at] / (b - a)
        v = vectors[at]
        mean = share @ v
        out[d, :DIM] = mean
        out[d, DIM : 2 * DIM] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        chars = int(w.end[b - 1] - w.start[a])
        out[d, 2 * DIM :] = [np.log1p(b - a) / 10, mark[a:b].mean(), upper[a:b].mean(), digit[a:b].mean(), len(np.unique(w.hash[a:b])) / (b - a), chars / (b - a) / 10, again[a + 1 : b].sum() / (b - a)]
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray  # unit rows
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2 * DIM + SHAPE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2 * DIM + SHAPE))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rate: float, decay: float) -> list[np.ndarray]:
    """Two layers by Adam on minibatches, logistic loss."""
    r = np.random.default_rng(5)
    w = [r.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), r.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for s in range(0, len(x), 64):
            at = order[s : s + 64]
            h = np.tanh(x[at] @ w[0] + w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(e, w[2]) * (1 - h * h)
            g = [x[at].T @ back + decay * w[0], back.sum(axis=0), h.T @ e + decay * w[2], e.sum(keepdims=True)]
            step += 1
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def fit_quality(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows_each: int = 5000, hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4) -> QualityModel:
    """Word vectors from all texts, the network from labelled rows outside the held-out quarter.

    At most ``rows_each`` rows of each label (those of the smallest hash of id), a fifth of which only fit the
    temperature and the offset that gives back the labels' true shares. Null labels and ids teach nothing. Without labelled rows, or with one
    label only, every score is that label's share (0.5 if there is none).
    """
    v = word_vectors(documents, text=text)
    model = QualityModel(v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12))
    known = labels.select(col(doc_id).alias("doc_id"), col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not share:
        return model
    model.prior = share.get(1, 0) / sum(share.values())
    if len(share) == 1:
        return model
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_each)
        picked = some if picked is None else picked.unionByName(some)
    texts = documents.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    vectors = documents.sparkSession.sparkContext.broadcast(model.vectors)
    sample = map_texts(texts, "text", ("doc_id", "y"), lambda t: {"x": [r.tobytes() for r in pooled(t, vectors.value)]}, "x binary")
    rows = sorted(sample.select("row.doc_id", "row.y", "x").collect(), key=lambda r: str(r["doc_id"]))
    if len({r["y"] for r in rows}) < 2:
        return model
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    y = np.array([r["y"] for r in rows], float)
    check = np.arange(len(y)) % 5 == 4
    model.mean, model.scale = x[~check].mean(axis=0), x[~check].std(axis=0) + 1e-6
    model.layers = _train((x[~check] - model.mean) / model.scale, y[~check], hidden, epochs, rate, decay)
    drawn = y.mean()
    model.layers[3] = model.layers[3] + np.log(model.prior / (1 - model.prior)) - np.log(drawn / (1 - drawn))
    z = model.logits(x[check])
    weight = np.where(y[check] == 1, model.prior / drawn, (1 - model.prior) / (1 - drawn))
    grid = np.geomspace(0.25, 20, 89)
    loss = [(weight * np.logaddexp(0, np.where(y[check] == 1, -z, z) / t)).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def score_quality(documents: DataFrame, model: QualityModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the kept columns) and ``score``, 0 to 1, for every document.

    Null and empty texts, and texts without words, get the score of a document without any word. Whole texts
    count; repeated rows and null ids give a row each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return map_texts(documents, text, keep, lambda t: {"score": shared.value.probability(pooled(t, shared.value.vectors))}, "score double")
