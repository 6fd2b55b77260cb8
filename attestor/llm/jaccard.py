"""Exact n-gram Jaccard join by a token-group matrix, and the classes of documents that its links connect.

A document's set is its distinct 5-word shingles as 64-bit hashes. Two documents link if 100 * common >= 75 * united. Equal sets are one class, and only one
document of a class (the smallest id) goes on.

1. Groups. Documents that agree in half of a few minhashes with the smallest document of the same minhash are compared with it, whole sets;
   those truly linked with it are its group of similar documents, every other document is a group of its own.
2. Matrix. In the order of the hashes the first third of a set is its head. A row of the matrix is a token and a group, for the
   union of the heads of the group's documents. Tokens of one group alone are left out.
3. Bound. A query document of the smaller of two groups is joined with the matrix, which counts the tokens its head shares with the group's union. Two
   sets of a and b tokens need o = ceil(75 (a + b) / 175) common ones, and all but max(a - head(a), b - head(b)) of them lie in both heads;
   only groups that reach this bound for some size they hold are opened, only documents that reach it are compared, whole sets.
   For a group of several documents the union of their whole sets is bounded first: a set that has fewer of its tokens there than it
   would need in common is not let in.
4. Tokens that occur in more than ``HOT`` groups are not joined: they count as shared, in favour of every group. Documents with so many
   of them that the bound could be met by such tokens alone are joined once more by prefixes of their sets, rarest tokens first: the larger
   of two sets probes with its first quarter, the smaller is found by its first seventh, and what stands after the two
   places must still be able to reach o.

So no component is split, and no step pairs all documents of a group or of a token. Links inside a group are stood for by the star
to its leader: other pairs of a group are not formed, so the join has the components but no number of links.

Defined cases: a null or empty text, or one of white space, has an empty set and links with nothing. Rows that share a doc_id are one
document, linked by whichever row links. A null doc_id has a null component. Repeated rows give a row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm import texts
from attestor.llm.graph import components
from attestor.session import cut_lineage

WORDS = 5
PERCENT = 75
MINHASHES, LEADERS, AGREEING = 6, 3, 3
HOT = 50
MOST_BITS = 27

_SEEDS = np.random.default_rng(19).integers(1, 2**63, MINHASHES + 2, dtype=np.uint64)


def head_size(n):
    """Tokens of a set of n in its head; for numbers, arrays and columns alike."""
    return (F.floor(n / 3) + 1).cast("int") if isinstance(n, Column) else n // 3 + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _keys(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, independent of its order."""
    if not len(own):
        return 0, 0
    a = texts.mixed(own ^ _SEEDS[-1]).sum(dtype=np.uint64)
    b = texts.mixed(own ^ _SEEDS[-2]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (what equal sets have in common), m (minhashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                sets = texts.shingle_sets(data, offsets, WORDS)
                keys = [_keys(s) for s in sets]
                least = [[int(texts.mixed(s ^ seed).min() >> np.uint64(33)) for seed in _SEEDS[:MINHASHES]] if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array(least, pa.list_(pa.int32()))], ["doc_id", "n", "k1", "k2", "m"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(texts.tidied(run), "doc_id bigint, n int, k1 bigint, k2 bigint, m array<int>")


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, k1 and head of every row with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in texts.chunks(batch.column("text")):
                sets = texts.shingle_sets(data, offsets, WORDS)
                full = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([a + i for i in full], pa.int64())), pa.array([_keys(sets[i])[0] for i in full], pa.int64()),
                     _lists([sets[i][: head_size(len(sets[i]))] for i in full])], ["doc_id", "k1", "head"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(texts.tidied(run), "doc_id bigint, k1 bigint, head array<bigint>")


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Which remainders modulo 2 ** bits occur among the values of the only column; a fixed number of words."""
    low = values.select(F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("low"))
    words = low.groupBy(F.shiftright("low", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(low & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    del words
    texts.give_back()
    return out


def in_bitmap(bitmap_: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64(len(bitmap_) * 64 - 1)
    return (bitmap_[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(12, (8 * n).bit_length()))


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingles of the documents with these ids. A bitmap of the ids keeps most other texts from being read
    into sets, the join takes the rest out."""
    ids = cut_lineage(ids.distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bits_for(ids.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column("doc_id").to_numpy())))
            for a, b, data, offsets in texts.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(texts.shingle_sets(data, offsets, WORDS))], ["doc_id", "shingles"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(texts.tidied(run), "doc_id bigint, shingles array<bigint>").join(ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    return met.where(F.col("common") * 100 >= (F.col("both") - F.col("common")) * PERCENT).select("a", "b").distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _needed(a: Column, b: Column) -> Column:
    """Common tokens in both heads that two sets of these sizes need at least."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT)) - F.greatest(a - head_size(a), b - head_size(b))


def _needed_by(n: Column, smallest: Column, largest: Column) -> Column:
    """The least that any size from smallest to largest needs: the bound falls towards both ends; one less for rounding."""
    low, high = F.greatest(smallest, F.ceil(n * PERCENT / 100)), F.least(largest, F.floor(n * 100 / PERCENT))
    return F.when(low > high, None).otherwise(F.greatest(F.least(_needed(n, low), _needed(n, high)) - 1, F.lit(1)))


def _united(a: Column, b: Column) -> Column:
    """Common tokens that two sets of these sizes must have."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _group(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The true links with leaders, and (doc, n, k1, grp) of every class."""
    keyed = classes.select(F.posexplode(F.slice("m", 1, LEADERS)).alias("j", "key"), "doc", "n", "m")
    leaders = keyed.groupBy("j", "key").agg(F.min(F.struct("doc", "n", "m")).alias("l"), F.count("*").alias("size")).where("size > 1")
    agreeing = sum((F.get("m", F.lit(i)) == F.get("l.m", F.lit(i))).cast("int") for i in range(MINHASHES))
    near = keyed.join(leaders, ["j", "key"]).where((F.col("doc") != F.col("l.doc")) & _sizes_fit("n", "l.n") & (agreeing >= AGREEING))
    pairs = cut_lineage(near.select(F.col("doc").alias("a"), F.col("l.doc").alias("b")).distinct())
    links = cut_lineage(verified(pairs, whole_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))))
    linked = links.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("grp"))
    return links, classes.select("doc", "n", "k1").join(linked, "doc", "left").select("doc", "n", "k1", F.coalesce("grp", "doc").alias("grp"))


def _matrix_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(token, doc, n, grp, members, hot) of every head token that more than one group has; hot: it stands in too many groups to be joined."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("members"))
    known = members.join(sizes, "grp").select(F.col("doc").alias("doc_id"), "k1", "n", "grp", "members")
    rows = cut_lineage(heads(docs).join(known, ["doc_id", "k1"]).select(F.col("doc_id").alias("doc"), "n", "grp", "members", "head"))
    spread = rows.select(F.explode("head").alias("token"), "grp").groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("times"))
    shared = cut_lineage(spread.where("low < high").select("token", "times"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(shared.select("token"), bits_for(shared.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head")
            tokens = head.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(head.offsets.to_numpy()))
            hit = np.flatnonzero(in_bitmap(sent.value, tokens))
            at = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit]), *(batch.column(c).take(at) for c in ("doc", "n", "grp", "members"))], ["token", "doc", "n", "grp", "members"])

    met = cut_lineage(rows.mapInArrow(texts.tidied(run), "token bigint, doc bigint, n int, grp bigint, members bigint").join(shared, "token"))
    sent.destroy()
    hot = met.where(F.col("times") > HOT).select("token", "grp").distinct().groupBy("token").count().where(F.col("count") > HOT).select("token", F.lit(True).alias("hot"))
    return cut_lineage(met.drop("times").join(hot, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))


def _united(a: Column, b: Column) -> Column:
    """Common tokens that two sets of these sizes must have."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _qualifying(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, n, to, most, smallest, largest, single): groups whose union the query's head meets often enough."""
    cold = rows.where(~F.col("hot"))
    matrix = cold.select("token", F.col("grp").alias("to"), F.col("members").alias("to_members")).distinct()
    ahead = (F.col("members") < F.col("to_members")) | ((F.col("members") == F.col("to_members")) & (F.col("grp") < F.col("to")))
    counts = cold.join(matrix, "token").where(ahead).groupBy("doc", "n", "to").agg(F.count("*").alias("common"))
    hot = rows.where("hot").groupBy("doc").agg(F.count("*").alias("hot"))
    spans = members.groupBy(F.col("grp").alias("to")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.count("*") == 1).alias("single"))
    bound = counts.join(hot, "doc", "left").withColumn("most", F.col("common") + F.coalesce("hot", F.lit(0))).join(spans, "to")
    return bound.where(F.col("most") >= _needed_by(F.col("n"), F.col("smallest"), F.col("largest"))).drop("common", "hot")


def _opened(open_: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents in the qualifying groups; of a group of several documents the union of the whole sets must
    hold enough of the query's tokens before it is opened."""
    many = open_.where(~F.col("single"))
    whole = sets.select("doc_id", F.explode("shingles").alias("token"))
    inside = members.select(F.col("grp").alias("to"), F.col("doc").alias("b"), F.col("n").alias("bn"))
    union = inside.join(many.select("to").distinct(), "to", "left_semi").join(whole.withColumnRenamed("doc_id", "b"), "b").select("to", "token").distinct()
    tokens = many.select("doc", "to").join(whole.withColumnRenamed("doc_id", "doc"), "doc").distinct()
    there = tokens.join(union, ["to", "token"]).groupBy("doc", "to").agg(F.count("*").alias("there"))
    least = _united(F.col("n"), F.greatest("smallest", F.ceil(F.col("n") * PERCENT / 100)))
    kept = many.join(there, ["doc", "to"]).where(F.col("there") >= least).unionByName(open_.where("single").withColumn("there", F.col("n").cast("long")))
    met = kept.join(inside, "to").where(_sizes_fit("n", "bn") & (F.col("most") >= _needed(F.col("n"), F.col("bn"))) & (F.col("there") >= _united(F.col("n"), F.col("bn"))))
    return met.select(F.col("doc").alias("a"), "b")


def _mostly_hot(rows: DataFrame) -> DataFrame:
    """Documents whose hot tokens alone could meet the bound."""
    hot = rows.where("hot").groupBy("doc", "n", "grp").agg(F.count("*").alias("hot"))
    return hot.where(F.col("hot") >= _needed_by(F.col("n"), F.lit(0), F.lit(1 << 30))).select("doc", "n", "grp")


def _hot_pairs(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of mostly hot documents in different groups that share a token of their prefixes, rarest tokens first."""
    whole = dense.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "n", "grp", F.explode("shingles").alias("token")).distinct()
    order = Window.partitionBy("doc").orderBy("times", "token")
    placed = whole.join(whole.groupBy("token").agg(F.count("*").alias("times")), "token").withColumn("place", F.row_number().over(order) - 1)
    probes = cut_lineage(placed.where(F.col("place") <= F.floor(F.col("n") * (100 - PERCENT) / 100)).select("token", "doc", "n", "grp", "place"))
    found = probes.where(F.col("n") - F.col("place") >= _united(F.col("n"), F.col("n"))).select(
        "token", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("grp").alias("bgrp"), F.col("place").alias("bplace"))
    reach = F.least(F.col("n") - F.col("place"), F.col("bn") - F.col("bplace")) >= _united(F.col("n"), F.col("bn"))
    ahead = (F.col("bn") < F.col("n")) | ((F.col("bn") == F.col("n")) & (F.col("b") < F.col("doc")))
    return probes.join(found, "token").where(ahead & (F.col("grp") != F.col("bgrp")) & _sizes_fit("n", "bn") & reach).select(F.col("doc").alias("a"), "b").distinct()


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    rows = cut_lineage(profiles(docs))
    classes = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc"), F.first("m").alias("m"))
    classes = cut_lineage(classes)
    links, members = _group(docs, classes)
    members = cut_lineage(members)
    matrix = _matrix_rows(docs, members)
    open_ = cut_lineage(_qualifying(matrix, members))
    dense = cut_lineage(_mostly_hot(matrix))
    united = members.join(open_.select(F.col("to").alias("grp")).distinct(), "grp", "left_semi")
    ids = open_.select(F.col("doc").alias("doc_id")).union(united.select("doc")).union(dense.select("doc"))
    sets = cut_lineage(whole_sets(docs, ids))
    pairs = _opened(open_, members, sets)
    if not dense.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(dense, sets))
    links = links.unionByName(verified(cut_lineage(pairs.distinct()), sets))

    # A doc_id with several different sets belongs to several classes; it connects them.
    held = rows.where(F.col("doc_id").isNotNull()).join(classes.select("k1", "k2", "n", "doc"), ["k1", "k2", "n"]).select("doc_id", "doc")
    first = cut_lineage(held.groupBy("doc_id").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    several = first.where("first < last")
    if not several.isEmpty():
        links = links.unionByName(held.join(several, "doc_id").select(F.col("doc").alias("a"), F.col("first").alias("b")))
    found = components(links).select(F.col("node").alias("first"), "component")
    named = first.join(found, "first", "left").select("doc_id", F.coalesce("component", "first").alias("component"))
    out = rows.select("doc_id", "n").join(named, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _parted(docs: DataFrame, name: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id in the column ``name`` is one of these distinct ids, and all others. A bitmap of the ids sends only
    their rows through the exact joins; all other rows are never moved."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bits_for(ids.count())))

    def rows(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(name).cast(pa.int64())
                hit = in_bitmap(sent.value, own.fill_null(0).to_numpy()) & own.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == wanted))

        return docs.mapInArrow(texts.tidied(run), docs.schema)

    met, listed = rows(True), _fresh("listed", docs)
    among = ids.select(F.col(ids.columns[0]).alias(listed))
    same = met[name].cast("long") == F.col(listed)
    return met.join(among, same, "left_semi"), rows(False).unionByName(met.join(among, same, "left_anti"))


def _fresh(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def representatives(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that stay of the classes of texts: of those that links connect the one with the smallest
    doc_id, rows without an id last. Rows that share a doc_id or have none are compared each by its own text, under a number
    made from a 63-bit hash of id and text; texts without a word link with nothing and all stay."""
    number = _fresh("number", docs)
    id_ = F.col("doc_id").cast("long")
    again = cut_lineage(docs.groupBy(id_.alias("doc_id")).count().where("doc_id IS NULL OR count > 1").select("doc_id"))
    if again.isEmpty():
        numbered = docs.withColumn(number, id_)
        gone = _classes_of(numbered, number).where("doc_id <> component_id").select("doc_id").distinct()
        return _parted(numbered, number, cut_lineage(gone))[1].drop(number)
    shared, own = _parted(docs, "doc_id", again.where("doc_id IS NOT NULL"))
    shared = cut_lineage(shared.unionByName(docs.where(id_.isNull())))
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = -1 - F.shiftrightunsigned(F.xxhash64(id_, "text"), 1)
    one = shared.where(~wordless).groupBy(hashed.alias(number)).agg(F.min(F.struct(*docs.columns)).alias("kept")).select("kept.*", number)
    numbered = cut_lineage(own.where(id_.isNotNull()).withColumn(number, id_).unionByName(one))
    classes = numbered.select(number, F.struct(id_.isNull(), id_, F.col(number).alias("number")).alias("rank")).join(
        _classes_of(numbered, number).select(F.col("doc_id").alias(number), F.col("component_id").alias("component")), number)
    classes = cut_lineage(classes.select(F.col(number).alias("doc_id"), "rank", "component"))
    first = classes.groupBy("component").agg(F.min("rank").alias("first"))
    gone = classes.join(first, "component").where(F.col("doc_id") != F.col("first.number")).select("doc_id").distinct()
    return _parted(numbered, number, cut_lineage(gone))[1].drop(number).unionByName(shared.where(wordless))


def _classes_of(numbered: DataFrame, number: str) -> DataFrame:
    return cut_lineage(classes_of(numbered.select(F.col(number).alias("doc_id"), "text")))
