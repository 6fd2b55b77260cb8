"""Document fingerprints by winnowing, in DataFrame functions alone.

The words of a text (white-space runs, lower case) are hashed; a gram is ``K`` words in a row, its hash combines theirs. Of
every ``WINDOW`` grams in a row the least hash is kept, of equal ones the rightmost, with its place. Two texts that share
``K + WINDOW - 1`` words in a row therefore share a kept hash; fewer than ``K`` words in common go unnoticed. A text with fewer
than ``K`` words is one gram, with fewer than ``WINDOW`` grams one window; a text without words has an empty fingerprint.

Defined cases: a null text is read as the empty text. Rows of one id follow each other by the hash of their text. A row
with a null id has no place in the order and is its own next document. Repeated rows get a row each. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
SPACES = r"[ \t\n\x0B\f\r]+"
ROWS_PER_RANGE, MOST_RANGES, STEP = 64, 1 << 14, 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def gram_hashes(own: Column, k: int = K) -> Column:
    """The hashes of all grams of an array of words, 59 bits each, so that a place fits below them."""
    few = F.size(own) < k
    starts = F.sequence(F.lit(0), F.greatest(F.size(own) - k, F.lit(0)))
    each = bound(F.transform(own, lambda w: F.xxhash64(w)),
                 lambda h: F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(k))), 5)))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(own, " ")), 5))
    return F.when(F.size(own) == 0, F.array().cast("array<bigint>")).when(few, whole).otherwise(each)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """struct(hash array<bigint>, at array<int>): the kept hashes and the words their grams begin at."""

    def kept(g: Column) -> Column:
        # The rightmost of the least: its place from the window's end is the tie-break, in four bits below the hash.
        starts = F.sequence(F.lit(0), F.greatest(F.size(g) - window, F.lit(0)))
        least = lambda i: F.least(*(F.shiftleft(F.get(g, i + j), 4) + F.lit(window - 1 - j) for j in range(window)))
        places = F.transform(starts, lambda i: i + F.lit(window - 1) - least(i).bitwiseAND(F.lit(15)).cast("int"))
        distinct = bound(places, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
        return bound(distinct, lambda at: F.struct(F.transform(at, lambda i: F.get(g, i)).alias("hash"), at.alias("at")))

    none = F.struct(F.array().cast("array<bigint>").alias("hash"), F.array().cast("array<int>").alias("at"))
    return bound(bound(words(text), lambda own: gram_hashes(own, k)), lambda g: F.when(F.size(g) == 0, none).otherwise(kept(g)))


def written(print_: Column) -> Column:
    """A fingerprint as text: hash:place of each kept gram, in the order of the text."""
    return F.array_join(F.zip_with(print_["hash"], print_["at"], lambda h, i: F.concat(F.lower(F.hex(h)), F.lit(":"), i.cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all of both; 1 if neither has any."""
    common = F.size(F.array_intersect(a, b))
    return bound(common, lambda n: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(n / F.size(F.array_union(a, b))))


def with_next(docs: DataFrame, columns: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row with ``next``, a struct of the columns of the next document in descending doc_id (after the last: the first).

    The ids are cut into ranges at values that occur, so the first row of each range is known: it is sent to the range before
    as well, and the next row is then always in the same range. ``columns`` adds columns once the rows have been dealt.
    """
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, n // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges)], max(10_000, 10 * ranges)).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    coarse = cuts[STEP - 1 :: STEP]
    whole = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    below = bound(F.size(F.filter(whole(coarse), lambda c: c < F.col("doc_id"))),
                  lambda i: i * STEP + F.size(F.filter(F.slice(whole(cuts), i * STEP + 1, STEP), lambda c: c < F.col("doc_id"))))
    tie = F.xxhash64("text")
    placed = docs.select("doc_id", "text", tie.alias("tie"), F.coalesce(below, F.lit(-1)).alias("own"))
    first = F.col("doc_id").isNotNull() & (F.col("doc_id") == F.get(whole(cuts), F.greatest("own", F.lit(0))))
    before = F.when(F.col("own") == len(cuts) - 1, F.lit(0)).otherwise(F.col("own") + 1)
    # Rows without an id are spread by their text; they never look at a neighbour.
    own = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.col("tie"), F.lit(ranges))).otherwise(F.col("own").cast("long"))
    dealt = placed.select("doc_id", "text", "tie", F.explode(F.when(first, F.array(
        F.struct(own.alias("range"), F.lit(False).alias("guest")), F.struct(before.cast("long").alias("range"), F.lit(True).alias("guest"))
    )).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("guest"))))).alias("to")).select("doc_id", "text", "tie", "to.range", "to.guest")
    order = [F.col("guest").asc(), F.col("doc_id").desc(), F.col("tie").asc()]
    dealt = columns(dealt.repartition("range").sortWithinPartitions(F.col("range"), *order))
    extra = [c for c in dealt.columns if c not in ("tie", "range", "guest")]
    itself = F.struct(*extra)
    following = F.lead(itself).over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("next", F.when(F.col("doc_id").isNull(), itself).otherwise(F.coalesce(following, itself))).where(~F.col("guest")).drop("tie", "range", "guest")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the beginning of the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, lambda df: df.withColumn("print", fingerprint(F.col("text"))))
    length = F.length("text")
    third = F.floor(length / 3).cast("int")
    rows = rows.select("doc_id", "print", length.cast("long").alias("n_chars"), F.col("next.print.hash").alias("next_hash"),
                       F.concat(F.substring("text", F.lit(1), length - third), F.substring(F.col("next.text"), F.lit(1), third)).alias("edited"))
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    own, edited = F.col("print"), F.col("edited_print")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(own).alias("fingerprint"),
                       written(edited).alias("edited_fingerprint"), likeness(own["hash"], edited["hash"]).cast("double").alias("near_edited"),
                       likeness(own["hash"], F.col("next_hash")).cast("double").alias("near_next"), F.size(own["hash"]).cast("long").alias("n_kept"))
