"""Running sums and numbers within keys, over ranges that Spark cuts at sampled quantiles of the order itself.

No window holds a whole key: a key with a third of all rows lies in as many ranges as its rows fill, each range is summed by
itself, and a range is offset by the sums of the earlier ranges of the same key. Only a key that crosses a border between
ranges has an offset at all, so the offsets are at most one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import cut_lineage


def _same(left: str, right: str, keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows dealt to ranges by (keys, order), with their range number; written down, since the cuts are sampled."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], value: str | None = None, into: str = "before") -> DataFrame:
    """The rows with the sum of ``value`` (or, without it, the number) of the rows before them in their key.

    Rows equal in keys and order lie in one range and are taken in any order, so ``order`` should end in columns that tell
    rows apart. Nulls come first; a null value counts as 0. Null keys are a key of their own.
    """
    weight = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(1).cast("long")
    dealt = ranges(df.withColumn("_weight", weight), keys, order)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_weight").alias("_sum"))
    offsets = sums.withColumn("_offset", F.sum("_sum").over(earlier)).where("_offset IS NOT NULL").select(*keys, "_range", "_offset")
    summed = dealt.withColumn("_inside", F.sum("_weight").over(inside))
    met = summed.alias("a").join(offsets.alias("b"), _same("a", "b", [*keys, "_range"]), "left")
    return met.select(*[F.col(f"a.{c}") for c in df.columns], (F.coalesce("a._inside", F.lit(0)) + F.coalesce("b._offset", F.lit(0))).alias(into))


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str = "ordinal") -> DataFrame:
    """The rows numbered from 1 within their key, in order."""
    return running(df, keys, order, None, into).withColumn(into, F.col(into) + 1)


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """The rows with the last ``value`` that is not null at or before them in their key; null before the first.

    Within a range by a window; over range borders by each range's last value, one row a range and key.
    """
    dealt = ranges(df, keys, order)
    up_to_here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).where("_carry IS NOT NULL").select(*keys, "_range", "_carry")
    filled = dealt.withColumn("_here", F.last(value, ignorenulls=True).over(up_to_here))
    met = filled.alias("a").join(before.alias("b"), _same("a", "b", [*keys, "_range"]), "left")
    return met.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce("a._here", "b._carry").alias(into))
