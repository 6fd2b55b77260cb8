"""Near-duplicate embeddings by collision-counting projections.

Each vector is scaled to length 1 and projected on ``PROJECTIONS`` random directions. Two vectors of cosine t differ by
sqrt(2 - 2t), so a projection of their difference has a known spread; a pair collides in a projection if its values are within
``REACH`` such spreads at the threshold. The number of collisions that a pair must have is calibrated: the largest
for which a pair right at the threshold is still found with probability ``RECALL``; closer pairs are found more surely. Pairs that pass are verified by
their cosine in double precision, so no pair below the threshold is linked.

The first ``ANCHORS`` projections also cut each label's vectors into cells, as wide as a query's window. A vector lies in
one cell and is asked as a query in every cell that its window touches. Within a cell the values of each projection are sorted, a
query's window is a run of them, and its collisions are counted pair by pair. Large cells are cut into blocks of ``BLOCK`` vectors and
``BLOCK`` queries, so no task holds more than two blocks; a task returns counts of links and the edges of its
spanning stars, not the pairs.

Defined cases: a vector that is null, empty or zero, or holds a null or a non-finite component, and a row without
label or id, links with nothing. Vectors of different lengths are never compared. Rows that share a vec_id are one node: the
row with the smallest label and vector stands for it. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.graph import components
from attestor.session import cut_lineage

THRESHOLD = 0.98
PROJECTIONS, ANCHORS = 24, 3
REACH, RECALL = 3.0, 0.995
BLOCK = 2_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(dimensions: int, seed: int = 3) -> np.ndarray:
    """Random directions of length 1, orthogonal within each run of ``dimensions``."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0].T for _ in range(-(-PROJECTIONS // dimensions))]
    return np.concatenate(parts)[:PROJECTIONS]


def half_width(dimensions: int, threshold: float) -> float:
    return REACH * math.sqrt(max(0.0, 2 - 2 * threshold) / dimensions) + 1e-9


def least_collisions() -> int:
    """The calibrated count: the largest that a pair at the threshold reaches with probability ``RECALL``."""
    p = math.erf(REACH / math.sqrt(2))
    tail = 0.0
    for n in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, n) * p**n * (1 - p) ** (PROJECTIONS - n)
        if tail >= RECALL:
            return n
    return 0


def collisions(members: np.ndarray, queries: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs with at least ``least`` collisions, by sorting each projection and counting windows."""
    out_q, out_m = [], []
    orders = [np.argsort(members[:, j], kind="stable") for j in range(PROJECTIONS)]
    step = max(1, 2_000_000 // max(1, len(members)))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        counts = np.zeros(len(part) * len(members), np.uint8)
        for j, order in enumerate(orders):
            line = members[order, j]
            low, high = np.searchsorted(line, part[:, j] - width, "left"), np.searchsorted(line, part[:, j] + width, "right")
            n = high - low
            asked = np.repeat(np.arange(len(part)), n)
            place = np.arange(len(asked)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            counts[asked * len(members) + order[place]] += 1
        hit = np.flatnonzero(counts >= least)
        out_q.append(a + hit // len(members))
        out_m.append(hit % len(members))
    return np.concatenate(out_q) if out_q else np.empty(0, np.int64), np.concatenate(out_m) if out_m else np.empty(0, np.int64)


def _dealt(threshold: float):
    """Each vector in its own cell as a member, and in every cell its windows touch as a query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dimensions, own in part.groupby(part["embedding"].map(len)):
                x = np.stack(own["embedding"].to_numpy()).astype(np.float64)
                x = unit(x)
                width = half_width(dimensions, threshold)
                lines = x @ directions(dimensions)[:ANCHORS].T
                home = np.floor(lines / (2 * width)).astype(np.int64)
                low, high = np.floor((lines - width) / (2 * width)).astype(np.int64), np.floor((lines + width) / (2 * width)).astype(np.int64)
                name = lambda cells: [f"{dimensions}:" + ":".join(map(str, c)) for c in cells.tolist()]
                yield pd.DataFrame({"vec_id": own["vec_id"], "label": own["label"], "embedding": own["embedding"], "cell": name(home), "member": True})
                for corner in range(1 << ANCHORS):
                    upper = np.array([corner >> j & 1 for j in range(ANCHORS)], bool)
                    cells = np.where(upper, high, low)
                    # A window within one cell in some direction is told once there.
                    keep = ~((upper & (low == high)).any(axis=1))
                    yield pd.DataFrame({"vec_id": own["vec_id"][keep], "label": own["label"][keep], "embedding": own["embedding"][keep], "cell": name(cells[keep]), "member": False})

    return run


def _linked(threshold: float):
    """Links within one block of members and queries: how many each vector has, and stars that span what they connect."""
    least = least_collisions()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        members, queries = group[group["member"]], group[~group["member"]]
        if members.empty or queries.empty:
            return empty
        m, q = (unit(np.stack(df["embedding"].to_numpy()).astype(np.float64)) for df in (members, queries))
        across = directions(m.shape[1]).T
        a, b = collisions(m @ across, q @ across, half_width(m.shape[1], threshold), least)
        ids_m, ids_q = members["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        ahead = ids_q[a] < ids_m[b]
        a, b = a[ahead], b[ahead]
        good = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 100_000]], m[b[i : i + 100_000]]) >= threshold for i in range(0, len(a), 100_000)]) if len(a) else np.empty(0, bool)
        a, b = ids_q[a[good]], ids_m[b[good]]
        if not len(a):
            return empty
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[left], root[right])
            following = root.copy()
            np.minimum.at(following, root[left], low)
            np.minimum.at(following, root[right], low)
            following = following[following]
            if (following == root).all():
                break
            root = following
        return pd.DataFrame({"vec_id": nodes, "other": nodes[root], "links": np.bincount(ends, minlength=len(nodes))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    dealt = cut_lineage(usable.mapInPandas(_dealt(threshold), "vec_id bigint, label string, embedding array<double>, cell string, member boolean"))
    sizes = dealt.groupBy("label", "cell").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("queries")).where("members > 0 and queries > 0")
    sizes = sizes.select("label", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("m"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("q"))
    met = dealt.join(sizes, ["label", "cell"])
    # Block i of the members meets block j of the queries: a member is sent to every j, a query to every i.
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("member"), F.col("m")).otherwise(F.col("q"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("q")).otherwise(F.col("m")) - 1))
    blocks = met.withColumn("own", own).withColumn("other", others).select(
        "vec_id", "label", "embedding", "cell", "member", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("member"), F.col("other")).otherwise(F.col("own")).alias("j"))
    found = cut_lineage(blocks.groupBy("label", "cell", "i", "j").applyInPandas(_linked(threshold), "vec_id bigint, other bigint, links bigint"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "vec_id")
    out = vectors.select("vec_id").join(links, "vec_id", "left").join(classes, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (component == F.col("vec_id")).alias("kept"))
