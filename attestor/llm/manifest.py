"""Merkle manifest of a dataset: a leaf a document, a binary tree a language, a tree over the languages' roots.

A leaf's place in its tree is the rank of its doc_id, read off a bitmap index; leaves are never sorted.

1. Index. Each group's ids are a bitmap of 64-bit words, of which only words with a bit are kept (merged by OR before and
   after the shuffle). A popcount directory has the number of rows before each container of 1,024 words and, within its
   container, before each word. The containers' prefix sums run over ranges, so no group's directory is in one task.
2. Rank. A leaf joins the word of its id: the rows before the word plus the bits below its own. Ids that occur on several
   rows make a word with more rows than bits; the leaves of such words are numbered by (id, leaf).
3. Levels. Leaves go to slot arrays of 1,024 consecutive places, keyed by (group, place / 1024). A task reduces ten levels
   of an array at once and hands one node on; arrays of these are reduced in the same way until each group has one.
4. Proofs. Paths go down from the roots by a join a round. A leaf's proof is its siblings in its array and the path of its
   array. A tampered leaf is folded with the original siblings and compared with the root.

Defined cases: a null field is `-` in its leaf. Null ids come before all others. Rows with the same id and group are ordered by leaf,
so equal rows may change places without changing a hash. A null group is a group before all others, not the group of the empty text. An empty table gives no
rows. Other columns are ignored, whatever their names. A text is hashed in one piece. doc_id is read as a 64-bit integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.operators import order
from attestor.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = "lang"
TAMPERED_EVERY = 7
LEVELS = 10
SLOTS = 1 << LEVELS
CONTAINER_WORDS = 10
#: The word of null ids, before all words of 64-bit ids.
NO_WORD = -(1 << 58)
OUT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(columns: dict[str, Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length in bytes before it."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame, group: str = GROUP, tampered_every: int = TAMPERED_EVERY) -> DataFrame:
    """grp (text that keeps the order of the groups), doc_id, leaf, and the tampered leaf where it differs."""
    columns = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string")) % tampered_every == 0) & F.col("n_chars").isNotNull()
    # n_chars is text here, since the largest number has no next one of its type.
    changed = leaf_of(columns | {"n_chars": (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")})
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"), F.when(hit, changed).alias("tampered"))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """grp, w, bits, rows, before: the words of each group's bitmap with the rows before them."""
    words = rows.groupBy("grp", "w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"), F.count("*").alias("rows"))
    words = cut_lineage(words.withColumn("container", F.shiftright("w", CONTAINER_WORDS)))
    directory = order.running(words.groupBy("grp", "container").agg(F.sum("rows").alias("rows")), ["grp"], ["container"], "rows").drop("rows")
    within = Window.partitionBy("grp", "container").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    inside = words.withColumn("inside", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    return inside.join(directory, ["grp", "container"]).select("grp", "w", "bits", "rows", (F.col("before") + F.col("inside")).alias("before"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with their place in their group, and (grp, n): the number of leaves of each group."""
    keyed = rows.withColumn("w", F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_WORD))).withColumn("b", F.expr("cast(coalesce(doc_id & 63, 0) AS int)"))
    index = cut_lineage(bitmap_index(keyed))
    single = F.col("rows") == F.expr("bit_count(bits)")
    rank = F.col("before") + F.expr("bit_count(bits & ~shiftleft(-1L, b))")
    columns = ["grp", "doc_id", "leaf", "tampered"]
    found = keyed.join(index.where(single), ["grp", "w"]).select(*columns, rank.alias("place"))
    repeated = index.where(~single)
    if not repeated.isEmpty():
        shared = keyed.withColumn("row", F.monotonically_increasing_id()).join(repeated.select("grp", "w", F.col("before").alias("first")), ["grp", "w"])
        ties = order.running(shared, ["grp", "w"], ["b", "leaf", "row"]).select(*columns, (F.col("first") + F.col("before")).alias("place"))
        found = found.unionByName(ties)
    return found, index.groupBy("grp").agg(F.sum("rows").alias("n"))


def _parent(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def levels_of(nodes: list[str], count: int) -> list[list[str]]:
    """The nodes of an array and of every level above them; ``count`` nodes are in the whole group, at the array's level."""
    out = [nodes]
    for _ in range(LEVELS if count > SLOTS else (count - 1).bit_length()):
        below = out[-1]
        out.append([_parent(below[i], below[i + 1] if i + 1 < len(below) else "") for i in range(0, len(below), 2)])
    return out


def path_of(levels: list[list[str]], slot: int) -> list[str]:
    """Siblings from the bottom up: `L` or `R` and the node, or `-` where there is none."""
    out = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        out.append("-" if other >= len(nodes) else ("L" if other < slot else "R") + nodes[other])
        slot >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    for sibling in path:
        node = _parent(sibling[1:], node) if sibling[0] == "L" else _parent(node, sibling[1:])
    return node


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, id, n, node) with ids 0 to n-1: the root of each group (grp, node) and the path of each node (grp, id, path)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("grp", "node"), nodes.select("grp", "id", F.array().cast("array<string>").alias("path"))
    arrays = nodes.groupBy("grp", F.shiftright("id", LEVELS).alias("block"), "n").agg(F.collect_list(F.struct((F.col("id") % SLOTS).alias("slot"), "node")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, paths = [], []
            for n, own in zip(batch.column("n").to_pylist(), batch.column("own").to_pylist(), strict=True):
                levels = levels_of(_array(own, "node"), n)
                roots.append(levels[-1][0])
                paths.append([path_of(levels, i) for i in range(len(own))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "block", "n")), pa.array(roots, pa.string()), pa.array(paths, pa.list_(pa.list_(pa.string())))], ["grp", "block", "n", "node", "paths"])

    made = cut_lineage(arrays.mapInArrow(run, "grp string, block bigint, n bigint, node string, paths array<array<string>>"))
    roots, above = climb(made.select("grp", F.col("block").alias("id"), F.expr(f"(n + {SLOTS - 1}) div {SLOTS}").alias("n"), "node"))
    below = made.select("grp", "block", F.posexplode("paths").alias("slot", "lower"))
    met = below.join(above.select("grp", F.col("id").alias("block"), F.col("path").alias("upper")), ["grp", "block"])
    return roots, met.select("grp", (F.col("block") * SLOTS + F.col("slot")).alias("id"), F.concat("lower", "upper").alias("path"))


def _array(own: list[dict], field: str) -> list[str]:
    out = [""] * len(own)
    for row in own:
        out[row["slot"]] = row[field]
    return out


def trees(docs: DataFrame, group: str = GROUP, tampered_every: int = TAMPERED_EVERY) -> DataFrame:
    """Slot arrays of the leaves: grp, n, own (slot, doc_id, leaf, tampered), path of the array up to the root, subroot, root."""
    rows = cut_lineage(leaves(docs, group, tampered_every))
    found, sizes = placed(rows)
    arrays = found.groupBy("grp", F.shiftright("place", LEVELS).alias("block")).agg(
        F.collect_list(F.struct((F.col("place") % SLOTS).alias("slot"), "doc_id", "leaf", "tampered")).alias("own"))
    arrays = cut_lineage(arrays.join(sizes, "grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [levels_of(_array(own, "leaf"), n)[-1][0] for n, own in zip(batch.column("n").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("n"), pa.array(roots, pa.string())], ["grp", "id", "n", "node"])

    reduced = cut_lineage(arrays.select("grp", "block", "n", F.transform("own", lambda x: F.struct(x["slot"].alias("slot"), x["leaf"].alias("leaf"))).alias("own"))
                          .mapInArrow(run, "grp string, id bigint, n bigint, node string"))
    subroots, paths = climb(reduced.withColumn("n", F.expr(f"(n + {SLOTS - 1}) div {SLOTS}")))
    groups = order.running(subroots.withColumn("all", F.lit("")), ["all"], ["grp"])
    groups = cut_lineage(groups.select("grp", "node", F.col("before").alias("id")))
    top = groups.select(F.lit("").alias("grp"), "id", F.lit(groups.count()).cast("long").alias("n"), "node")
    root, above = climb(top)
    tops = groups.select("grp", "id", F.col("node").alias("subroot")).join(above.select("id", F.col("path").alias("upper")), "id").drop("id")
    whole = root.first()
    whole = F.lit(whole["node"] if whole else None).cast("string").alias("root")
    upper = paths.join(tops, "grp").select("grp", F.col("id").alias("block"), F.concat("path", "upper").alias("path"), "subroot", whole)
    return arrays.join(upper, ["grp", "block"])


def verify(docs: DataFrame, group: str = GROUP, tampered_every: int = TAMPERED_EVERY) -> DataFrame:
    """Each document's leaf, subroot, root, hash of its proof, the root folded from its (tampered) leaf, and whether it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("n", "own", "path", "subroot", "root")}
            for n, own, path, subroot, root in zip(*columns.values(), strict=True):
                levels = levels_of(_array(own, "leaf"), n)
                upper = "".join(p[1:] for p in path)
                rows = []
                for row in own:
                    lower = path_of(levels, row["slot"])
                    proof = hashlib.sha256(("".join([p[1:] for p in lower]) + upper).encode()).hexdigest()
                    folded = fold(row["tampered"] or row["leaf"], lower + path)
                    rows.append((row["doc_id"], row["leaf"], subroot, root, proof, folded, folded == root))
                parts = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), *(pa.array(p, pa.string()) for p in parts[1:6]), pa.array(parts[6], pa.bool_())],
                                                 ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return trees(docs, group, tampered_every).select("n", "own", "path", "subroot", "root").mapInArrow(run, OUT)
