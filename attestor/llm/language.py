"""Language identification: one byte-context trie per language, the shortest exact code length wins.

Each language's statistics come from a sample of whole labelled texts of about ``budget_bytes`` (a documented bound, so the
tries can be sent to the executors), or without a budget from all of them; every document is scored whole under each frozen trie.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and no code length. Ties go to the language
that sorts first. Repeated rows get equal rows. Without any labelled text every document is ``und``. Other columns of the
table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import ppm, texts
from attestor.session import cut_lineage

UNDETERMINED = "und"
ORDER = 4
BUDGET_BYTES = 4 << 20
FOLDS, HELD_OUT = 5, 0
MOST_LANGUAGES = 200
SCORE_BYTES = 1 << 18
#: A text is in none of the languages if it costs this much more a byte than all but one in a hundred of the texts learned from.
REJECT_FACTOR, REJECT_QUANTILE = 1.5, 0.99


def sample(docs: DataFrame, budget_bytes: int | None = BUDGET_BYTES, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """Whole labelled texts outside the held-out fold, thinned by a hash of the id to about ``budget_bytes`` a language (None: all).

    Texts above a sixteenth of the budget are passed over, so none of them stands for a language; where the others do not
    fill the budget, the one of them with the least hash is taken too. Of the values of ``lang`` the ``most_languages`` with the most text
    are learned, so a column of dirty values ends nothing.
    """
    size = F.octet_length("text").cast("long")
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (texts.fold("doc_id", FOLDS) != HELD_OUT)
    )
    if budget_bytes is None:
        share = rows.groupBy("lang").agg(F.sum(size).alias("_bytes")).orderBy(F.desc("_bytes"), "lang").limit(most_languages)
        return rows.join(F.broadcast(share), "lang").select("lang", "text")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("_draw", draw).withColumn("_small", size * 16 <= budget_bytes)
    share = rows.groupBy("lang").agg(
        F.sum(size).alias("_bytes"), F.coalesce(F.sum(F.when(F.col("_small"), size)), F.lit(0)).alias("_fit"), F.min(F.when(~F.col("_small"), F.col("_draw"))).alias("_least"))
    share = share.orderBy(F.desc("_bytes"), "lang").limit(most_languages)
    taken = F.when(F.col("_small"), F.col("_draw") * F.col("_fit") < budget_bytes).otherwise((F.col("_fit") < budget_bytes) & (F.col("_draw") == F.col("_least")))
    return rows.join(F.broadcast(share), "lang").where(taken).select("lang", "text")


def _gram_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, texts.Tally] = {}

        def out(lang):
            keys, n = tallies[lang].take()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table["lang"].unique().to_pylist():
                own = table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks()
                for _, _, data, offsets in texts.chunks(own):
                    if tallies.setdefault(lang, texts.Tally()).add(ppm.grams(data, offsets, order, ends=False)[0]):
                        yield out(lang)
        for lang in tallies:
            yield out(lang)

    return run


class Model:
    """Tries of the languages, and the bits a byte above which a text is in none of them (learned where it is asked for)."""

    def __init__(self, languages: list[str], scorer: ppm.Scorer | None, most_bits: float | None = None):
        self.languages, self.scorer, self.most_bits = languages, scorer, most_bits


def train(docs: DataFrame, order: int = ORDER, budget_bytes: int = BUDGET_BYTES) -> Model:
    return _learned(sample(docs, budget_bytes), order)


def train_to_reject(docs: DataFrame, order: int = ORDER, budget_bytes: int | None = None) -> Model:
    """The model with a threshold learned from the texts it was learned from: all labelled ones outside the held-out fold."""
    own = sample(docs, budget_bytes)
    model = _learned(own, order)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer
        for batch in batches:
            for _, _, data, offsets in texts.chunks(batch.column("text"), SCORE_BYTES) if scorer else ():
                sizes = np.diff(offsets)
                rate = scorer.texts(data, offsets, ends=False).min(axis=1)[sizes > 0] / sizes[sizes > 0]
                yield pa.RecordBatch.from_arrays([pa.array(rate, pa.float64())], ["rate"])

    usual = own.select("text").mapInArrow(texts.tidied(run), "rate double").agg(F.percentile_approx("rate", REJECT_QUANTILE, 10_000)).first()[0]
    # `accepted` sends the model with the threshold; two copies would lie in the driver.
    sent.destroy()
    model.most_bits = None if usual is None else REJECT_FACTOR * usual
    return model


def _learned(own: DataFrame, order: int) -> Model:
    counts = cut_lineage(own.mapInArrow(texts.tidied(_gram_counts(order)), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    tries = []
    for lang in languages:  # one at a time, so the driver never holds more than one table of counts
        # As Arrow: rows as Python objects would take ten times the room of the table itself.
        own = counts.where(F.col("lang") == lang).select("key", "n").toArrow()
        tries.append(ppm.Trie.of(own["key"].to_numpy().astype(np.int64).view(np.uint64), own["n"].to_numpy().astype(np.int64), order))
    model = Model(languages, ppm.Scorer(tries) if tries else None)
    texts.give_back()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the language under equal priors), bits_per_byte of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            best, score, rate = np.full(n, len(names) - 1), np.zeros(n), np.full(n, np.nan)
            for a, b, data, offsets in texts.chunks(batch.column("text"), SCORE_BYTES) if model.scorer else ():
                bits = model.scorer.texts(data, offsets, ends=False)
                at = bits.argmin(axis=1)
                least = bits[np.arange(b - a), at]
                known = letters[a:b]
                best[a:b] = np.where(known, at, len(names) - 1)
                score[a:b] = np.where(known, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0)
                rate[a:b] = np.where(known, least / np.maximum(np.diff(offsets), 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rate, from_pandas=True)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select("doc_id", F.coalesce(texts.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, order: int = ORDER, budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    return predict(docs, train(docs, order, budget_bytes))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and costs no more a byte in its best language than the model allows.

    A row without a ``lang`` is handed on with the language found for it; a stated one stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(model.languages, object)
        for batch in batches:
            column = batch.column("text")
            keep = pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False) & (model.scorer is not None)
            best = np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in texts.chunks(column, SCORE_BYTES) if model.scorer else ():
                bits = model.scorer.texts(data, offsets, ends=False)
                best[a:b] = bits.argmin(axis=1)
                if model.most_bits is not None:
                    keep[a:b] &= bits.min(axis=1) <= model.most_bits * np.diff(offsets)
            if model.scorer is not None:
                told = pc.coalesce(batch.column("lang"), pa.array(names[best], pa.string()).cast(batch.column("lang").type))
                batch = batch.set_column(columns.index("lang"), batch.schema.field("lang"), told)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(texts.tidied(run), docs.schema)
