"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Fitting takes a bounded sample of labelled rows (``per_class`` of each label, the smallest hashes of their ids). Every
word of the sample's vocabulary gets a sparse random index vector, made from a hash of the word; a word's vector is the
sum of the index vectors of its neighbours. The same is done for word shapes (case, digits, last characters, length),
which stand in for words that the sample lacks. A document is the mean of its words' vectors and of its shapes' vectors,
with three figures of the whole text (length, share of repeated lines, share of distinct words). A network with one hidden
layer maps it to a logit, which a temperature fitted on rows kept aside turns into a probability; class weights
restore the labels' natural shares. Scoring reads only the text, all of it, in one pass without a shuffle.

Defined cases: a null text scores as the empty one, which has a score like any other; null labels and labels without a
document are not learnt from; with no labels, or only one class, every document scores that class's share (0.5 with
none); an empty table gives an empty result; repeated rows score alike; words of equal frequency enter the vocabulary in
the order of their characters; a null id counts as the empty text when folds are dealt; a very long text is read whole, in
runs of 65,536 words; columns other than the id and the text are not read. The temperature is 0.25 at least: on data that
the network parts without a mistake, sharper ones would only push scores to 0 and 1.
"""

from __future__ import annotations

import hashlib
import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.common import fresh, id_crc, table

WORD_DIM, SHAPE_DIM, NONZERO, VOCABULARY, SHAPES, REACH = 48, 24, 6, 20_000, 2_000, 2
CACHE, FIGURES = 200_000, 4


def shape(word: str) -> str:
    """Case, digits, the last character if it is no letter (and whether it repeats), and the length in steps of four."""
    case = "U" if word.isupper() and len(word) > 1 else "l" if word.islower() else "T" if word[:1].isupper() else "o"
    last = word[-1]
    tail = "" if last.isalnum() else last + ("+" if word[-2:-1] == last else "")
    return f"{case}{'d' if any(map(str.isdigit, word)) else ''}{min(len(word) // 4, 6)}{tail}"


def figures(text: str, words: list[str]) -> tuple[float, ...]:
    """Length, share of repeated lines, of distinct words, and of words equal to the one before."""
    if not words:
        return (0.0,) * FIGURES
    lines = [x for x in text.split("\n") if x.strip()]
    return math.log1p(len(words)) / 10, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / len(words), sum(map(operator.eq, words[1:], words)) / len(words)


def index_vectors(names: list[str], dim: int) -> np.ndarray:
    """Sparse ternary vectors, the same for a name in every run."""
    out = np.zeros((len(names), dim), dtype=np.float32)
    for i, name in enumerate(names):
        d = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=2 * NONZERO).digest()
        for k in range(NONZERO):
            out[i, d[2 * k] % dim] += 1 if d[2 * k + 1] & 1 else -1
    return out


def context_vectors(streams: list[np.ndarray], names: list[str], dim: int) -> np.ndarray:
    """Unit sums of the index vectors of the neighbours up to REACH places away; the last row is for unknown names (0)."""
    index, out = index_vectors(names, dim), np.zeros((len(names) + 1, dim), dtype=np.float32)
    index = np.vstack([index, np.zeros((1, dim), dtype=np.float32)])
    for s in streams:
        for at in range(1, REACH + 1):
            if len(s) > at:
                np.add.at(out, s[:-at], index[s[at:]])
                np.add.at(out, s[at:], index[s[:-at]])
    out[-1] = 0
    # Without the common direction that every word's neighbours share, else all vectors look alike.
    mean = out[:-1].mean(axis=0) if len(names) else 0
    out[:-1] = out[:-1] / np.maximum(np.linalg.norm(out[:-1], axis=1, keepdims=True), 1e-9) - mean / max(np.linalg.norm(mean), 1e-9)
    return out + 0.5 * index


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple = ()
    temperature: float = 1.0
    constant: float | None = None

    def codes(self):
        """word -> word id * number of shapes + shape id, remembered up to a bound."""
        model, n = self, len(self.shapes) + 1

        class Codes(dict):
            def __missing__(self, w):
                if len(self) >= CACHE:
                    self.clear()
                self[w] = c = model.words.get(w.lower(), n_words) * n + model.shapes.get(shape(w), n - 1)
                return c

        n_words = len(self.words)
        return Codes()

    def features(self, text: str, codes) -> np.ndarray:
        words, n = text.split(), len(self.shapes) + 1
        out = np.zeros(WORD_DIM + SHAPE_DIM + FIGURES, dtype=np.float32)
        if words:
            c = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
            for at in range(0, len(c), 1 << 16):  # bounded memory for very long texts
                part = c[at : at + (1 << 16)]
                out[:WORD_DIM] += self.word_vectors[part // n].sum(axis=0)
                out[WORD_DIM : WORD_DIM + SHAPE_DIM] += self.shape_vectors[part % n].sum(axis=0)
            out /= len(c)
            out[-FIGURES:] = figures(text, words)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = forward(self.layers, (x - self.mean) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def forward(layers, x):
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    return h, h @ w2 + b2[0]


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
    """Adam on the weighted log loss with weight decay."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            b = order[at : at + 128]
            h, z = forward(p, x[b])
            d = weight[b] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[b]) / weight[b].sum()
            dh = np.outer(d, p[2]) * (h > 0)
            grads, t = [x[b].T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])], t + 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted log loss, by a golden-section search over its logarithm."""

    def loss(t):
        a = z / math.exp(t)
        return float((weight * (np.logaddexp(0, a) - y * a)).sum())

    lo, hi, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(rows, totals: dict[int, int]) -> Model:
    """rows: (text, label); totals: labelled rows of each class, for the weights."""
    ids, streams, labels, stats = {}, [], [], []
    counts: Counter = Counter()
    for text, label in rows:
        words = text.split()
        streams.append(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64))
        counts.update(words)
        stats.append(figures(text, words))
        labels.append(label)
    seen = sorted(totals)
    if len(seen) < 2 or not streams:
        return Model({}, {}, np.zeros((1, WORD_DIM), np.float32), np.zeros((1, SHAPE_DIM), np.float32), constant=float(seen[0]) if seen else 0.5)
    lower, shaped = Counter(), Counter()
    for w, n in counts.items():
        lower[w.lower()] += n
        shaped[shape(w)] += n
    words = {w: i for i, (w, n) in enumerate(sorted(lower.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    shapes = {s: i for i, (s, n) in enumerate(sorted(shaped.items(), key=lambda x: (-x[1], x[0]))[:SHAPES])}
    word_of = np.array([words.get(w.lower(), len(words)) for w in ids], dtype=np.int64)
    shape_of = np.array([shapes.get(shape(w), len(shapes)) for w in ids], dtype=np.int64)
    model = Model(words, shapes, context_vectors([word_of[s] for s in streams], list(words), WORD_DIM), context_vectors([shape_of[s] for s in streams], list(shapes), SHAPE_DIM))
    x = np.zeros((len(streams), WORD_DIM + SHAPE_DIM + FIGURES))
    for i, s in enumerate(streams):
        if len(s):
            x[i] = np.concatenate([model.word_vectors[word_of[s]].mean(axis=0), model.shape_vectors[shape_of[s]].mean(axis=0), stats[i]])
    y = np.array(labels, dtype=float)
    have = Counter(labels)
    weight = np.array([totals[v] / have[v] for v in labels])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.scale
    aside = np.arange(len(x)) % 5 == 4  # rows come in the order of a hash
    if len(set(y[~aside])) < 2:
        aside[:] = False
    model.layers = train_network(x[~aside], y[~aside], weight[~aside])
    if aside.any():
        model.temperature = max(0.25, fit_temperature(forward(model.layers, x[aside])[1], y[aside], weight[aside]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``per_class`` rows of each class; ``labels`` has only rows that may be learnt from."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null")
    totals = {r["_y"]: r["count"] for r in given.groupBy("_y").count().collect()}
    hashed = given.withColumn("_h", F.xxhash64("_id"))
    picked = sorted((tuple(r) for y in sorted(totals) for r in hashed.filter(F.col("_y") == y).orderBy("_h", "_id").limit(per_class).collect()), key=lambda r: (r[2], r[0], r[1]))
    if not picked:
        return fit([], {})
    spark = docs.sparkSession
    few = spark.createDataFrame([(p, r[0], r[1]) for p, r in enumerate(picked)], f"_place int, _id {dict(given.dtypes)['_id']}, _y int")
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(few), F.col("_doc") == F.col("_id")).select("_place", "_text", "_y")
    # At most 2 * per_class texts come to the driver, a partition at a time: of rows that repeat an id the least text.
    rows = rows.groupBy("_place", "_y").agg(F.min("_text").alias("_text"))
    got = sorted(((r["_place"], r["_text"], r["_y"]) for r in rows.toLocalIterator()), key=lambda r: (r[0], r[1]))
    return fit([r[1:] for r in got], {k: v for k, v in totals.items() if any(r[2] == k for r in got)})


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, score and predicted, for every row; ``keep`` may not name one of these two."""
    if {c.lower() for c in keep} & {"score", "predicted"}:
        raise ValueError("score and predicted are columns of the result")
    body = fresh(docs, "body")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: VOCABULARY and SHAPES rows of vectors

    def run(batches):
        model = shared.value
        codes = model.codes()
        for b in batches:
            x = [model.features(t or "", codes) for t in b.column(body).to_pylist()]
            s = model.scores(np.array(x, dtype=np.float64).reshape(len(x), WORD_DIM + SHAPE_DIM + FIGURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    result = T.StructType(docs.select(*keep).schema.fields).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*keep, F.col(text_col).alias(body)).mapInArrow(run, result)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_crc("doc_id") % 4 == 2
    model = train(docs.select("doc_id", "text"), labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
