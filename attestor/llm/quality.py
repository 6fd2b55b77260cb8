"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature.

Every token counts as a word (its exact bytes) and as a shape (runs of letter cases, digits and marks; a token that
repeats the one before it has a shape of its own). Both fall into a fixed number of types by hash. Each type has a sparse random index
vector; its context vector is the sum of the index vectors around all its occurrences in all documents, an exact integer
sum that Spark adds up per type. A document is the mean of its tokens' normalised context vectors. The network is
trained on a sample of about ``SAMPLE`` labelled rows (a documented bound); a held-back part of it fits the temperature.

Defined cases: a null or empty text has a zero vector and the score that the network gives it. Several labels of one id
count as their mean, at least 0.5 being 1. Repeated rows get equal rows, null ids are scored and never learned from. Without
two labelled classes every score is the share of label 1 (0.5 if there is no label). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import texts

FOLDS, HELD_OUT = 5, 0
WORD_TYPES, SHAPE_TYPES, DIMENSIONS, NONZERO = 1 << 14, 1 << 12, 32, 2
SAMPLE = 20_000
THRESHOLD = 0.3
TYPES = WORD_TYPES + SHAPE_TYPES

_rng = np.random.default_rng(7)
_INDEX = _rng.integers(0, DIMENSIONS, (TYPES, NONZERO))
_SIGN = _rng.choice([-1.0, 1.0], (TYPES, NONZERO))
# Letters, digits and white space fall into classes; every other ASCII byte stands for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def types_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word type, shape type) of every token, and the first token of each text with the total."""
    words, starts, ends, bounds = texts.words(data, offsets, lower=False)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), bounds
    classes = _CLASS[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[starts] = True
    place = np.cumsum(fresh) - 1
    shapes = texts.span_hashes(classes[fresh], place[starts], place[ends - 1] + 1)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = False
    shapes = np.where(again, texts.mixed(shapes), shapes)
    return (words % np.uint64(WORD_TYPES)).astype(np.int64), WORD_TYPES + (shapes % np.uint64(SHAPE_TYPES)).astype(np.int64), bounds


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial context vectors of a task: one row for each type that occurs in it."""
    total = np.zeros(TYPES * DIMENSIONS)
    seen = np.zeros(TYPES, bool)
    for batch in batches:
        for _, _, data, offsets in texts.chunks(batch.column("text")):
            word, shape, bounds = types_of(data, offsets)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            seen[word] = True
            seen[shape] = True
            for reach in (1, 2):
                if len(word) <= reach:
                    continue
                near = owner[reach:] == owner[:-reach]
                for kind in (word, shape):
                    left, right = kind[:-reach][near] * DIMENSIONS, kind[reach:][near] * DIMENSIONS
                    for context in (word, shape):
                        before, after = context[:-reach][near], context[reach:][near]
                        for j in range(NONZERO):
                            total += np.bincount(left + _INDEX[after, j], _SIGN[after, j], len(total))
                            total += np.bincount(right + _INDEX[before, j], _SIGN[before, j], len(total))
    kept = np.flatnonzero(seen)
    own = total.reshape(TYPES, DIMENSIONS)[kept].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), *(pa.array(own[:, d]) for d in range(DIMENSIONS))], ["type", *(f"c{d}" for d in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised context vectors of all types over all documents; the table has a fixed number of rows."""
    names = [f"c{d}" for d in range(DIMENSIONS)]
    sums = docs.select("text").mapInArrow(texts.tidied(_contexts), "type int, " + ", ".join(f"{c} bigint" for c in names)).groupBy("type").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((TYPES, DIMENSIONS))
    own = np.stack([sums[c].to_numpy().astype(np.float64) for c in names], axis=1)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1)
    out[sums["type"].to_numpy()] = own
    return out.astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: the mean word vector, the mean shape vector, and the logarithm of the number of tokens."""
    word, shape, bounds = types_of(data, offsets)
    n = np.diff(bounds)
    out = np.zeros((len(n), 2 * DIMENSIONS + 1), np.float32)
    full = np.flatnonzero(n > 0)
    if len(full):
        out[full, :DIMENSIONS] = np.add.reduceat(vectors[word], bounds[full], axis=0) / n[full, None]
        out[full, DIMENSIONS:-1] = np.add.reduceat(vectors[shape], bounds[full], axis=0) / n[full, None]
    out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Two layers: tanh units, then one sigmoid divided by the temperature."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.layers = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        self.constant: float | None = None

    def _logits(self, x):
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.layers[0] + self.layers[1])
        return hidden, hidden @ self.layers[2] + self.layers[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        # Rounded, since the last digits depend on which rows are multiplied together.
        return np.round(1 / (1 + np.exp(-np.clip(self._logits(x)[1] / self.temperature, -500, 500))), 9)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: max(1, len(y) // 6)], order[max(1, len(y) // 6) :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-4
        first, second = [np.zeros_like(w) for w in self.layers], [np.zeros_like(w) for w in self.layers]
        step = 0
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
                hidden, logits = self._logits(x[own])
                error = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - y[own]) / len(own)
                back = np.outer(error, self.layers[2]) * (1 - hidden**2)
                inputs = (x[own] - self.mean) / self.scale
                step += 1
                for i, g in enumerate((inputs.T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                    g = g + decay * self.layers[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.layers[i] = self.layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        logits, target = self._logits(x[held])[1], y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(target == 1, -1, 1) * logits / t).mean()))
        return self


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, label, text) of about ``sample`` labelled rows outside the held-out fold, drawn by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & (texts.fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = sample / max(1, known.count())
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(known.where(draw < share)), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                rows = pooled(sent.value, data, offsets)
                values = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), batch.column("label").slice(a, b - a), values], ["key", "label", "x"])

    rows = labelled(docs, labels, sample).select(F.xxhash64("doc_id").alias("key"), "label", "text").mapInArrow(texts.tidied(run), "key bigint, label int, x binary").toArrow().sort_by([("key", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(rows), 2 * DIMENSIONS + 1).astype(np.float64)
    y = rows["label"].to_numpy().astype(np.float64)
    del rows
    model = Model(vectors, Network(2 * DIMENSIONS + 1).fit(x, y))
    del x, y
    sent.destroy()
    texts.give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                scores[a:b] = model.network.probabilities(pooled(model.vectors, data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(texts.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(texts.tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that are predicted to be of quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                keep[a:b] = model.network.probabilities(pooled(model.vectors, data, offsets)) >= THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(texts.tidied(run), docs.schema)
