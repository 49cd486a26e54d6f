"""Language identification (operator 2).

Multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
(proximal form, L1 and L2 penalties), then one temperature fitted on rows kept out of training.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import col, held_out, map_texts, settle

#: n-grams hash into this many features.
FEATURES = 1 << 14
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # features x languages, inverse document frequency included in the input
    idf: np.ndarray | None = None
    temperature: float = 1.0


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool))
    return _letters[0]


def _grams(text: str) -> tuple[np.ndarray, bool]:
    """Feature numbers of all 1-, 2- and 3-grams of the lowered text, other characters than letters as spaces; whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64), False
    edge = np.full(len(points) + 2, 32, np.uint32)
    edge[1:-1] = np.where(letter, points, 32)
    keep = np.ones(len(edge), bool)
    np.logical_or(edge[1:] != 32, edge[:-1] != 32, out=keep[1:])  # runs of spaces become one
    edge = edge[keep]
    parts, h = [], np.zeros(len(edge), np.uint32)
    for n in range(3):
        m = len(edge) - n
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + edge[n:] * _SEEDS[n] + np.uint32(n + 1)
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        parts.append((x >> np.uint32(18)).astype(np.int64))
    return np.concatenate(parts), True


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    grams, ok = _grams(text or "")
    c = np.bincount(grams, minlength=FEATURES) if ok else np.zeros(0, np.int64)
    at = np.flatnonzero(c)
    return at, c[at], ok


def _vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _document_frequency(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all training texts each feature occurs; partial sums per task, then one sum per slice of features."""
    width = 256

    def run(batches):
        settle()
        total = np.zeros(FEATURES, np.int64)
        n = 0
        for batch in batches:
            for t in batch.column(0):
                at, _, ok = _counts(t.as_py())
                total[at] += 1
                n += ok
        yield pa.RecordBatch.from_pydict({"slice": list(range(FEATURES // width)) + [-1], "n": [*total.reshape(-1, width).tolist(), [n]]}, schema=pa.schema([("slice", pa.int32()), ("n", pa.list_(pa.int64()))]))

    parts = train.select(col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "slice int, n array<bigint>")
    rows = parts.select("slice", F.posexplode("n").alias("i", "n")).groupBy("slice", "i").agg(F.sum("n").alias("n")).where("n > 0").collect()
    out = np.zeros(FEATURES, np.int64)
    for r in rows:
        if r["slice"] >= 0:
            out[r["slice"] * width + r["i"]] = r["n"]
    return out, sum(r["n"] for r in rows if r["slice"] < 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], k: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    z, n, w = (np.zeros((FEATURES, k)) for _ in range(3))
    order = np.random.default_rng(17)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            za, na = z[at], n[at]
            wa = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))
            p = _softmax(x @ wa)
            p[y[i]] -= 1
            g = np.outer(x, p)
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / alpha * wa
            n[at] = grown
    np.copyto(w, np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)))
    return w


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by a search over a fixed geometric grid."""
    grid = np.geomspace(0.1, 10, 101)
    if not len(y):
        return 1.0
    loss = [-np.log(np.clip(_softmax(logits / t)[np.arange(len(y)), y], 1e-12, 1)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language(documents: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 700, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3, epochs: int = 4) -> LanguageModel:
    """Fit on rows of known language outside the held-out quarter.

    Document frequencies count all such rows. The weights see at most ``per_language`` ids of each language (those of
    the smallest hash, one text each), a fifth of which only fit the temperature. Equally likely languages: the first by name. Rows with null text or
    language, or without a letter, teach nothing; with no row left the model knows no language.
    """
    train = documents.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # ids whose hash is under a share of the hashes that leaves three times the sample, so no task ranks a whole language
    share = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 32) / float(1 << 32)
    # a row a language, as many as the model has classes
    counts = train.groupBy("lang").agg((F.lit(3.0 * per_language) / F.count("*")).alias("most"))
    few = train.select("doc_id", "lang", share.alias("h")).join(F.broadcast(counts), "lang").where(F.col("h") < F.col("most")).groupBy("lang", "h", "doc_id").agg(F.count("*").alias("rows"))
    ids = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language).select("lang", "doc_id")
    sample = map_texts(train.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi"), "text", ["lang", "doc_id"], _sparse, "at binary, n binary").where("at is not null")
    sample = sample.groupBy("row.lang", "row.doc_id").agg(F.min(F.struct("at", "n")).alias("s")).select("lang", "doc_id", "s.at", "s.n")
    rows = sorted(sample.collect(), key=lambda r: (r["lang"], str(r["doc_id"])))
    if not rows:
        return LanguageModel()
    frequency, total = _document_frequency(train, "text")
    idf = np.log((1 + total) / (1 + frequency)) + 1
    languages = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in rows])
    x = [(a := np.frombuffer(r["at"], np.uint16).astype(np.int64), _vector(a, np.frombuffer(r["n"], np.uint32), idf)) for r in rows]
    check = np.arange(len(rows)) % 5 == 4
    w = _ftrl([v for v, c in zip(x, check) if not c], list(y[~check]), len(languages), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    logits = np.array([v @ w[a] for (a, v), c in zip(x, check) if c]).reshape(-1, len(languages))
    return LanguageModel(languages, w, idf, _temperature(logits, y[check]))


def _sparse(texts: pa.Array) -> dict:
    got = [_counts(t.as_py()) for t in texts]
    return {"at": [a.astype(np.uint16).tobytes() if ok else None for a, _, ok in got], "n": [c.astype(np.uint32).tobytes() if ok else None for _, c, ok in got]}


def predict_language(documents: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the kept columns), ``lang_pred``, ``score`` for every row of ``documents``.

    Null text, text without a letter, and every text where the model knows no language give ``und`` with score 0.
    The whole text counts, however long. Repeated rows and null ids give a row each; extra columns are ignored.
    """
    w = None if model.weights is None else model.weights.astype(np.float64)
    live = None if w is None else np.abs(w).sum(axis=1) > 0

    def fn(texts: pa.Array) -> dict:
        out, score = [], []
        for t in texts:
            at, c, ok = _counts(t.as_py())
            if not ok or w is None:
                out.append("und")
                score.append(0.0)
                continue
            x = _vector(at, c, model.idf)
            some = live[at]
            p = _softmax((x[some] @ w[at[some]]) / model.temperature)
            i = int(np.argmax(p))
            out.append(model.languages[i])
            score.append(float(p[i]))
        return {"lang_pred": out, "score": score}

    return map_texts(documents, text, keep, fn, "lang_pred string, score double")
