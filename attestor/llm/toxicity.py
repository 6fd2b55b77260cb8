"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence ends at `.`, `!`, `?` or a line break. Its score is a logistic function of the weights of its words and of
their first 4, 5 and 6 bytes; a document's score combines its sentences by noisy-or, 1 - prod(1 - p). The weights are trained through
the noisy-or from document labels alone, on a sample of about ``SAMPLE`` rows of each label (a documented bound), so the
sentences that carry the label are found without sentence labels.

Defined cases: a null or empty text has no sentence and the score 0. Several labels of one id count as their maximum.
Repeated rows get equal rows, null ids are scored and never learned from. Without labels of both kinds every weight is 0 and every
sentence has the base score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import texts

FOLDS, HELD_OUT = 4, 2
SAMPLE = 2_500
THRESHOLD = 0.3
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
BASE = -8.0

_APART = np.ones(256, bool)
_APART[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r"]] = True


def sentences_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the words (a row each), the first word of every sentence, its text, and where the sentence begins and ends."""
    low = texts._LOWER[data]
    hashes, starts, ends, _ = texts.words(low, offsets, lower=False, space=_APART)
    if not len(hashes):
        none = np.empty(0, np.int64)
        return np.empty((0, 1 + len(PREFIXES)), np.int64), none, none, none, none
    parts = [hashes]
    for k in PREFIXES:
        short = texts.span_hashes(low, starts, np.minimum(starts + k, ends))
        parts.append(np.where(ends - starts >= k, texts.mixed(short + np.uint64(k)), texts.mixed(hashes + np.uint64(k))))
    features = (np.stack(parts, axis=1) % np.uint64(BUCKETS)).astype(np.int64)
    stops = _STOP[data]
    closes = np.flatnonzero(stops) + 1
    cuts = np.unique(np.concatenate([closes, offsets]))
    part = np.searchsorted(cuts, starts, side="right") - 1
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    owner = np.searchsorted(offsets, starts[first], side="right") - 1
    return features, first, owner, cuts[part[first]], cuts[part[first] + 1]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probability, text, begin, end) of every sentence with a word."""
        features, first, owner, begin, end = sentences_of(data, offsets)
        if not len(first):
            return np.empty(0), owner, begin, end
        z = np.add.reduceat(self.weights[features].sum(axis=1, dtype=np.float64), first) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))), owner, begin, end


def fit(features: list[np.ndarray], firsts: list[np.ndarray], labels: np.ndarray, rounds: int = 100, rate: float = 0.5, decay: float = 0.3) -> Model:
    """Penalised likelihood of the documents' noisy-or by gradient steps.

    A weight is learned in units of its feature's evidence, the signed root of the likelihood ratio between documents with
    and without the feature, so words that a few toxic documents share by chance stay small. Features met once get no weight.
    """
    weights = np.zeros(BUCKETS)
    toxic_docs, clean_docs = int((labels == 1).sum()), int((labels == 0).sum())
    if not toxic_docs or not clean_docs:
        return Model(weights, BASE)
    met = np.zeros((2, BUCKETS))
    for f, label in zip(features, labels, strict=True):
        met[int(label), np.unique(f)] += 1
    flat = np.concatenate(features)
    used, at = np.unique(flat, return_inverse=True)
    at = at.reshape(flat.shape).astype(np.int32)
    clean, toxic = met[:, used]
    n = clean + toxic
    expected = n * toxic_docs / len(labels)
    ratio = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / expected) + clean * np.log(np.maximum(clean, 1e-9) / (n - expected)))
    evidence = np.where(toxic > expected, np.sqrt(np.maximum(ratio, 0)), 0)
    unit = np.where(n >= 2, np.clip(evidence / 4, 0.05, 2), 0)

    words = np.cumsum([0, *(len(f) for f in features)])
    first = np.concatenate([s + w for s, w in zip(firsts, words[:-1], strict=True)])
    owner = np.repeat(np.arange(len(labels)), [len(s) for s in firsts])
    full = np.unique(owner)
    heads = np.searchsorted(owner, full)
    spans = np.diff(np.r_[first, len(flat)])
    is_toxic = labels[owner] == 1
    share = np.where(is_toxic, min(10.0, clean_docs / toxic_docs) ** 0.5, 1.0)
    u, speed = np.zeros(len(used)), np.zeros(len(used))
    for _ in range(rounds):
        w = u * unit
        z = BASE + sum(np.add.reduceat(w[at[:, j]], first) for j in range(at.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        log_none = np.zeros(len(labels))
        log_none[full] = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), heads)
        none = np.exp(log_none)[owner]
        slope = np.repeat(np.where(is_toxic, -none / np.maximum(1 - none, 1e-9) * p, p) * share, spans)
        gradient = sum(np.bincount(at[:, j], slope, len(used)) for j in range(at.shape[1])) * unit + decay * u
        speed += gradient**2
        u -= rate * gradient / (np.sqrt(speed) + 1)
    weights[used] = u * unit
    return Model(weights, BASE)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, label, text) of about ``sample`` rows of each label outside the held-out fold, drawn by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & (texts.fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    return docs.select("doc_id", "text").join(F.broadcast(known.where(draw < share)), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                features, first, owner, _, _ = sentences_of(data, offsets)
                heads = np.searchsorted(owner, np.arange(b - a + 1))
                words = np.r_[first, len(features)][heads]
                values = [features[i:j].astype(np.int32).tobytes() for i, j in zip(words[:-1], words[1:], strict=True)]
                cuts = [(first[i:j] - k).astype(np.int32).tobytes() for i, j, k in zip(heads[:-1], heads[1:], words[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(values, pa.binary()), pa.array(cuts, pa.binary())], ["key", "label", "x", "cuts"])

    rows = labelled(docs, labels, sample).select(F.xxhash64("doc_id", "text").alias("key"), "label", "text")
    rows = rows.mapInArrow(run, "key bigint, label int, x binary, cuts binary").toPandas().sort_values("key", kind="stable")
    return fit([np.frombuffer(v, np.int32).reshape(-1, 1 + len(PREFIXES)) for v in rows["x"]], [np.frombuffer(v, np.int32).astype(np.int64) for v in rows["cuts"]],
               rows["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence with its number of likely toxic sentences."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("n_offending", T.LongType()), T.StructField("worst_sentence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            scores, offending, worst = np.zeros(n), np.zeros(n, np.int64), [None] * n
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                p, owner, begin, end = sent.value.sentences(data, offsets)
                if not len(p):
                    continue
                full = np.unique(owner)
                heads = np.searchsorted(owner, full)
                scores[a + full] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-15)), heads))
                hits = np.flatnonzero(p >= THRESHOLD)
                np.add.at(offending, a + owner[hits], 1)
                for i in hits[np.argsort(p[hits], kind="stable")]:
                    worst[a + owner[i]] = bytes(data[begin[i] : end[i]]).decode().strip()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(offending), pa.array(worst, pa.string())],
                [f.name for f in schema.fields])

    return docs.select("doc_id", F.coalesce(texts.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(run, schema)


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each offending sentence: doc_id, its place in bytes of the text, its score and its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in texts.chunks(batch.column("text")):
                p, owner, begin, end = sent.value.sentences(data, offsets)
                hits = np.flatnonzero(p >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + owner[hits])), pa.array(begin[hits] - offsets[owner[hits]]), pa.array(end[hits] - offsets[owner[hits]]), pa.array(p[hits]),
                     pa.array([bytes(data[begin[i] : end[i]]).decode() for i in hits], pa.string())], [f.name for f in schema.fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
