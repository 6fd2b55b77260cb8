"""Connected components by alternating large and small stars; state is two columns, each round is cut off its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import cut_lineage


EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges ``a``, ``b``; the component is its smallest node.

    A round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour, until the edges are stars;
    edges that are stars are told by a count of their nodes, without another round.
    Each neighbourhood is only ever reduced to its minimum, so a node with very many edges is never held in one place.
    """
    stars = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size, tangled = _shape(stars)
    while tangled:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        # As few files as the edges fill; a round over a small rest costs little then.
        stars = cut_lineage(small.where("a <> b").distinct().coalesce(max(1, size // EDGES_PER_TASK)))
        size, tangled = _shape(stars)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _shape(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes hang on several others, or on one while others hang on them; ``a`` is the larger end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    row = nodes.agg(F.sum("hangs"), F.count_if(F.col("hangs") + F.col("holds") > 1)).first()
    return row[0] or 0, row[1]
