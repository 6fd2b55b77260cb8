"""Language-model scoring: prediction by partial matching over bytes, beside a smoothed unigram baseline over words.

The corpus pass counts every byte n-gram and every word of all training documents, and names the n-grams that only other
documents have; all of this grows with the input and stays in Spark tables. Each n-gram's code length is exact: a seen one's
follows from the counts of its context, an unseen one's is looked up by joins, one context length after the other. Both parts
are read the same way: the commonest n-grams (at most ``MAX_GRAMS``) and words (at most ``FREQUENT``) are looked up in the
pass over the texts, all others are counted per row and joined. Neither bound changes a result.

Defined cases: a null text is read as the empty text, which has one token, its end. Rows with a null id are not learned
from and not held out. Repeated rows are scored one by one. Words are compared by a 64-bit hash. Without training documents
the model is uniform and the baseline's counts are 0. Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import ppm, texts
from attestor.session import cut_lineage

ORDER = 5
MAX_GRAMS = 1 << 19
FREQUENT = 1 << 17
FOLDS, HELD_OUT = 5, 1
GRAM, WORD, END, HEAD = 0, 1, 2, 3


def _corpus_counts(order: int):
    """kind, key and n; an n-gram of a row that is not learned from has n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, others, words, ends = texts.Tally(), texts.Tally(), texts.Tally(), 0

        def out(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        def unlearned():
            keys, n = others.take()
            return out(GRAM, keys, np.zeros_like(n))

        for batch in batches:
            learned = batch.filter(batch.column("learned"))
            ends += learned.num_rows
            for _, _, data, offsets in texts.chunks(learned.column("text")):
                if grams.add(ppm.grams(data, offsets, order)[0]):
                    yield out(GRAM, *grams.take())
                if words.add(texts.words(data, offsets)[0]):
                    yield out(WORD, *words.take())
            for _, _, data, offsets in texts.chunks(batch.filter(pc.invert(batch.column("learned"))).column("text")):
                if others.add(ppm.grams(data, offsets, order)[0]):
                    yield unlearned()
        yield out(GRAM, *grams.take())
        yield unlearned()
        yield out(WORD, *words.take())
        if ends:
            yield out(END, np.zeros(1, np.uint64), np.array([ends]))

    return run


class Model:
    """The commonest n-grams with their bits, the commonest words with their counts, and the totals of the baseline."""

    def __init__(self, order: int, grams: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int, ends: int):
        self.order, self.tokens, self.distinct, self.ends = order, tokens, distinct, ends
        self.grams, self.bits = ppm.Slots(grams[0]), np.r_[grams[1], 0.0]
        self.frequent, self.frequent_counts = ppm.Slots(words[0]), words[1]

    def term(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _near(contexts: DataFrame, k: int) -> DataFrame:
    """Contexts of at most one symbol are 257 rows at most."""
    return F.broadcast(contexts) if k <= 1 else contexts


def _last(symbols: int, key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit(int(ppm.mask(symbols))))


def _contexts(grams: DataFrame, order: int) -> list[DataFrame]:
    """For each length, every context: total and distinct, seen (the count of each symbol after it), rest and rest_distinct (what is left
    of the next shorter context without these symbols)."""
    levels = [grams]
    for k in range(order - 1, -1, -1):
        levels.insert(0, cut_lineage(levels[0].groupBy(_last(k + 1).alias("key")).agg(F.sum("n").alias("n"))))
    out = []
    for k, level in enumerate(levels):
        entry = F.struct(_last(1).cast("int").alias("symbol"), "n")
        own = level.groupBy(F.shiftright("key", 9).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.map_from_entries(F.collect_list(entry)).alias("seen"))
        rest = rest_distinct = F.lit(0).cast("long")
        if k:
            shorter = out[-1].select(F.col("context").alias("parent"), F.col("total").alias("whole"), F.col("distinct").alias("whole_distinct"), F.col("seen").alias("after"))
            own = own.withColumn("parent", _last(k - 1, "context")).join(_near(shorter, k - 1), "parent")
            rest = F.col("whole") - F.aggregate(F.map_keys("seen"), F.lit(0).cast("long"), lambda n, symbol: n + F.try_element_at("after", symbol))
            rest_distinct = F.col("whole_distinct") - F.col("distinct")
        out.append(cut_lineage(own.select("context", "total", "distinct", "seen", rest.alias("rest"), rest_distinct.alias("rest_distinct"))))
    return out


def _unseen_bits(unseen: DataFrame, contexts: list[DataFrame]) -> DataFrame:
    """key and bits of n-grams that no learned text has: the escapes down to a context that has their last symbol."""
    none = F.lit(None).cast("long")
    state = unseen.select("key", F.lit(0.0).alias("bits"), none.alias("t"), none.alias("d"), F.lit(True).alias("open"))
    for k in range(len(contexts) - 1, -1, -1):
        # A key that is done meets no context, and is dealt out by itself.
        context = F.when(F.col("open"), F.shiftright("key", 9).bitwiseAND(F.lit(int(ppm.mask(k))))).otherwise(-1 - F.col("key"))
        met = state.withColumn("context", context).join(_near(contexts[k], k), "context", "left").withColumn("n", F.try_element_at("seen", _last(1).cast("int")))
        t, d, missed = F.coalesce("t", "total"), F.coalesce("d", "distinct"), F.col("open") & F.col("n").isNull()
        cost = F.when(F.col("n").isNotNull(), F.log2((t + d) / F.col("n"))).when(d > 0, F.log2((t + d) / d)).otherwise(0.0)
        if not k:
            known = F.coalesce("distinct", F.lit(0))
            cost += F.when(missed, F.log2(F.greatest(ppm.SYMBOLS - known, F.lit(1)))).otherwise(0.0)
        state = met.select("key", (F.col("bits") + cost).alias("bits"), F.when(missed, F.col("rest")).alias("t"), F.when(missed, F.col("rest_distinct")).alias("d"), missed.alias("open"))
    return state.select("key", "bits")


def _least(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` counts reach."""
    powers = range(48)
    sizes = counts.agg(*(F.count_if(F.col("n") >= (1 << p)).alias(f"p{p}") for p in powers)).first()
    return next((1 << p for p in powers if sizes[f"p{p}"] <= most), 1 << powers[-1])


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The only two columns, in the order of the keys in the first."""
    rows = table.toPandas()
    keys, values = (rows[c].to_numpy() for c in table.columns)
    keys = keys.astype(np.int64, copy=False).view(np.uint64)
    at = np.argsort(keys)
    return keys[at], values[at]


def train(docs: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """The model and the table (kind, key, value) of the log10 probabilities of all other n-grams of the documents and of all other words."""
    rows = docs.select("text", F.coalesce(texts.fold("doc_id", FOLDS) != HELD_OUT, F.lit(False)).alias("learned"))
    counts = cut_lineage(rows.mapInArrow(_corpus_counts(order), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    grams, words = (counts.where(F.col("kind") == kind).select("key", "n") for kind in (GRAM, WORD))
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    ends = totals[END]["n"] if END in totals else 0
    tokens, distinct = (totals[WORD]["n"], totals[WORD]["distinct"]) if WORD in totals else (0, 0)
    contexts = _contexts(grams.where("n > 0"), order)
    seen = contexts[-1].select("context", "total", "distinct", F.explode("seen").alias("symbol", "n")).select(
        (F.shiftleft("context", 9) + F.col("symbol")).alias("key"), "n", F.log2((F.col("total") + F.col("distinct")) / F.col("n")).alias("bits"))
    common_gram, common_word = F.col("n") >= _least(grams, MAX_GRAMS), F.col("n") >= _least(words, FREQUENT)
    model = Model(order, _sorted(seen.where(common_gram).select("key", "bits")), _sorted(words.where(common_word)), tokens + ends, distinct + (ends > 0), ends)
    bits = seen.where(~common_gram).select("key", "bits").unionByName(_unseen_bits(grams.where("n = 0").select("key"), contexts))
    rest = bits.select(F.lit(GRAM).alias("kind"), "key", (F.col("bits") * -math.log10(2)).alias("value"))
    term = F.log10((F.col("n") + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    return model, rest.unionByName(words.where(~common_word).select(F.lit(WORD).alias("kind"), "key", term.alias("value")))


def _rare(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each owner, their owners and how often they occur."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.empty(0, np.int64)
    return keys[first], owner[first], np.diff(np.r_[first, len(keys)]).astype(np.int32)


def score(docs: DataFrame, model: Model, values: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every document;
    the model and the values are those that ``train`` made of the same documents."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    head = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                         T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()),
                           T.StructField("head", head)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names, columns = [f.name for f in head.fields], [f.name for f in schema.fields]
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                m = b - a
                grams, bounds = ppm.grams(data, offsets, model.order)
                at = model.grams.find(grams)
                bits = np.add.reduceat(model.bits[at], bounds[:-1])
                missed = np.flatnonzero(at < 0)
                rare = [(GRAM, *_rare(grams[missed], np.searchsorted(bounds, missed, side="right") - 1))]
                hashes, _, _, bounds = texts.words(data, offsets)
                at = model.frequent.find(hashes)
                owner = np.repeat(np.arange(m), np.diff(bounds))
                common = at >= 0
                known = np.bincount(owner[common], minlength=m) + (model.ends > 0)
                base = np.bincount(owner[common], model.term(model.frequent_counts[at[common]]), m) + model.term(model.ends)
                rare.append((WORD, *_rare(hashes[~common], owner[~common])))
                heads = pa.StructArray.from_arrays(
                    [batch.column("doc_id").slice(a, m), batch.column("held_out").slice(a, m), pa.array(np.diff(bounds) + 1), pa.array(known.astype(np.int64)),
                     pa.array(base), pa.array(-bits * math.log10(2))], names)
                # A head has no key; the row's number spreads the heads over the partitions of the join, and its kind never meets a value.
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(np.full(m, HEAD, np.int32)), pa.array(ids[a:b]), pa.nulls(m, pa.int32()), heads], columns)
                for kind, keys, owner, n in rare:
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[a:b][owner]), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.nulls(len(keys), heads.type)], columns)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(texts.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    met = rows.mapInArrow(run, schema).join(values, ["kind", "key"], "left")
    word, gram = F.col("kind") == WORD, F.col("kind") == GRAM
    summed = met.groupBy("row").agg(
        F.first("head", ignorenulls=True).alias("h"),
        F.sum(F.when(word & F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(word, F.col("n") * F.coalesce("value", F.lit(float(model.term(0))))).otherwise(0.0)).alias("base"),
        F.sum(F.when(gram, F.col("n") * F.col("value")).otherwise(0.0)).alias("score"),
    )
    return summed.select("h.doc_id", "h.held_out", "h.n_tokens", (F.col("h.known") + F.col("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                         (F.col("h.base") + F.col("base")).alias("base_score"), (F.col("h.score") + F.col("score")).alias("score"))


def score_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    return score(docs, *train(docs, order))


def score_adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Each text alone, learned while it is coded: doc_id and score. Nothing is gathered from the corpus."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [-ppm.adaptive_bits((t or "").encode(), order) * math.log10(2) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
