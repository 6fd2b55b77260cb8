"""Filter interaction audit: what each of five filters removes, in every order in which they could be applied.

Every document has a failure mask, one bit a filter. Spark counts the masks of each part (all documents, those of good
quality, the toxic ones): at most 32 rows a part, whatever the number of documents. From them each part's task builds a
count-weighted decision diagram: a level a filter, a pass and a fail branch, equal subdiagrams held once, and at every node
the counts of the documents below it. The 120 orders are walked by swapping two neighbouring levels at a time; each swap
rebuilds only the nodes of these two levels. In each order the all-pass path gives the steps: its node's weight is what is
kept, the fail branch beside it what the step removes.

Filters, on whole texts (null: empty), words being maximal runs of characters other than blank and U+0009 to U+000D: A fails
under 50 words; B when 100 * distinct words < 65 * words; C when 100 * [A-Z] > 5 * code points; D when any of #$%&*| occurs; E
when a smaller doc_id has the same text, anywhere in the table, removed or not.

Copies are found by the SHA-256 of the text. Rows are counted by (digest, id, part, labels) before anything is compared per
digest, so a text that makes up a third of the table is a row a part and label where its least id is found.

Defined cases: an empty text has no words, so it fails A, and E after a smaller id's empty text. Rows with the same text and id
do not fail E by each other. A null id neither fails E nor makes another row fail. Repeated rows count each. A document is good
or toxic if any row of ``labels`` with its id says 1; null labels and ids say nothing. A null source is the part "". An empty
table gives no rows. Other columns are ignored, whatever their names. A text is held whole, with its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
COUNTS = ("documents", "good", "toxic")
FEWEST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
OUT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
                    *(T.StructField(c, T.LongType()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D fail on the text (not null)."""
    spaced = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")

    def of(n: Column, distinct: Column) -> Column:
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        failed = (n < FEWEST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike("[#$%&*|]"))
        return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    # The words are made once: a lambda over a one-element array binds them.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("m")))[0]
    return F.transform(F.array(counted), lambda c: of(c["n"], c["m"]))[0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic: the number of documents of each part that fail exactly the filters of the mask."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("_good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("_toxic"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    rows = rows.join(said, "_id", "left")
    same = ["digest", "part", "_good", "_toxic"]
    by_id = rows.groupBy("_id", *same).agg(F.count("*").alias("n"), F.first("mask").alias("mask"))
    by_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.first("mask").alias("mask"), F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("own"),
                                       F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("without"))
    least = by_text.groupBy(F.col("digest").alias("_digest")).agg(F.min("own._id").alias("least"))
    met = by_text.join(least, F.col("digest") == F.col("_digest"))
    firsts = F.col("without") + F.when(F.col("own._id") == F.col("least"), F.col("own.n")).otherwise(0)
    fate = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n"))))
    dealt = met.select("part", "_good", "_toxic", fate.alias("fate")).where("fate.n > 0")
    weight = F.col("fate.n")
    return dealt.groupBy("part", F.col("fate.mask").alias("mask")).agg(
        F.sum(weight).alias("documents"), F.sum(F.when(F.col("_good") == 1, weight).otherwise(0)).alias("good"), F.sum(F.when(F.col("_toxic") == 1, weight).otherwise(0)).alias("toxic"))


class Diagram:
    """A decision diagram over failure masks, ordered by ``order`` (filter numbers). A node is (pass, fail) or a tuple of counts."""

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.unique: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.weights: list[tuple[int, ...]] = []
        self.none = (0,) * len(COUNTS)
        self.root = self._build(counts, 0, 0)

    def _node(self, key: tuple, weight: tuple[int, ...]) -> int:
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append(key)
            self.weights.append(weight)
        return self.unique[key]

    def _branch(self, passes: int, fails: int) -> int:
        return self._node((passes, fails), tuple(a + b for a, b in zip(self.weights[passes], self.weights[fails], strict=True)))

    def _build(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == len(self.order):
            weight = counts.get(mask, self.none)
            return self._node(("leaf", *weight), weight)
        return self._branch(self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; subdiagrams under them stay as they are."""
        changed: dict[tuple[int, int], int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if (node, depth) not in changed:
                passes, fails = self.nodes[node]
                if depth < level:
                    changed[node, depth] = self._branch(rebuilt(passes, depth + 1), rebuilt(fails, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.nodes[passes], self.nodes[fails]
                    changed[node, depth] = self._branch(self._branch(pp, fp), self._branch(pf, ff))
            return changed[node, depth]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the all-pass path."""
        out, node = [], self.root
        for f in self.order:
            node, fails = self.nodes[node]
            out.append((f, self.weights[node], self.weights[fails]))
        return out


def swaps(n: int) -> Iterator[int]:
    """Levels to swap with their next, one after another, so that all orders of ``n`` are met, each once."""
    if n < 2:
        return
    down = True
    inner = swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        following = next(inner, None)
        if following is None:
            return
        # With the moving filter at the top, the others lie one level lower.
        yield following + 1 if down else following
        down = not down


def interactions(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    diagram = Diagram(counts, len(filters))
    met = [(list(diagram.order), diagram.steps())]
    for level in swaps(len(filters)):
        diagram.swap(level)
        met.append((list(diagram.order), diagram.steps()))
    failing, alone, total = [0] * len(filters), [0] * len(filters), [0] * len(filters)
    for order, steps in met:
        for i, (f, _, removed) in enumerate(steps):
            total[f] += removed[0]
            if i == 0:
                failing[f] = removed[0]
            if i == len(order) - 1:
                alone[f] = removed[0]
    return [("".join(filters[f] for f in order), i + 1, kept[0], removed[0], failing[f] - removed[0], alone[f], removed[1], removed[2], total[f])
            for order, steps in met for i, (f, kept, removed) in enumerate(steps)]


def steps(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist(), strict=True):
                rows = interactions({r["mask"]: (r["documents"], r["good"], r["toxic"]) for r in own})
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), pa.array(columns[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], OUT.names)

    by_part = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("own"))
    return by_part.mapInArrow(run, OUT)
