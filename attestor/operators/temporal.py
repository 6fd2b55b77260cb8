"""What was held when: interval predicates, as-of joins, period sequences and latest-row choices.

Operators take all dates at once (a period frame), never one date. Choices of a latest row are aggregates
over structs, so a key with a third of all rows is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import scalars as S


def held_at(on: Column) -> Column:
    """FLT-01: acquired by the date and not yet realised at it."""
    return (F.col("acquired_date") <= on) & (F.col("realized_date").isNull() | (F.col("realized_date") > on))


def held_during_year(on: Column) -> Column:
    """FLT-02: held at any time in the year ending at the date."""
    return (F.col("acquired_date") <= on) & (F.col("realized_date").isNull() | (F.col("realized_date") > S.months_back(on, 12)))


def realised_between(after: Column, on: Column) -> Column:
    """FLT-08: realised in (previous packet date, date]; with no previous date any earlier realisation counts."""
    return F.col("realized_date").isNotNull() & (F.col("realized_date") <= on) & (after.isNull() | (F.col("realized_date") > after))


def acquired_by(lo: Column, hi: Column, on: Column) -> Column:
    """FLT-03: yes, no, or null when the day range spans the date or is unknown."""
    return F.when(hi <= on, True).when(lo > on, False)


def window_covers(on: Column) -> Column:
    """FLT-05: a reliance window closed at both ends; an absent end is open."""
    return (F.col("applicable_from") <= on) & (F.col("applicable_to").isNull() | (F.col("applicable_to") >= on))


def packet_sequence(periods: DataFrame) -> DataFrame:
    """WIN-05: packet periods of each fund with the packet date before."""
    by_date = Window.partitionBy("fund_id").orderBy("period_date")
    return (
        periods.filter("audit_scope = 'packet'")
        .withColumn("previous_date", F.lag("period_date").over(by_date))
        .select("fund_id", "period_id", "period_date", "previous_date", "label")
    )


def dated_lots(lots: DataFrame, conversions: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """JN-01/JN-03: lots meet every period of their fund by which they were acquired, class and shares as of it.

    The conversion (at most one per lot) joins before the dates multiply the rows; the period side is a
    dimension that Spark broadcasts only when its measured size allows.
    """
    return at_dates(placed_lots(lots, conversions, holdings), periods)


def placed_lots(lots: DataFrame, conversions: DataFrame, holdings: DataFrame) -> DataFrame:
    """Lots with fund, kind of position and conversion, a row each."""
    one = conversions.select("lot_id", "effective_date", "to_security_class", "to_shares")
    base = lots.select("lot_id", "holding_id", "security_class", "shares", "entry_pps", "cost_amount", "acquired_date", "realized_date")
    return base.join(holdings.select("holding_id", "fund_id", "position_type"), "holding_id").join(one, "lot_id", "left")


def at_dates(placed: DataFrame, periods: DataFrame) -> DataFrame:
    """`placed_lots` at every period of their fund by which they were acquired."""
    met = placed.join(periods, "fund_id").filter(F.col("acquired_date") <= F.col("period_date"))
    converted = F.coalesce(F.col("effective_date") <= F.col("period_date"), F.lit(False))
    return (
        met.withColumn("held_class", F.when(converted, F.col("to_security_class")).otherwise(F.col("security_class")))
        .withColumn("held_shares", F.when(converted, F.col("to_shares")).otherwise(F.col("shares")))
        .withColumn("held", held_at(F.col("period_date")))
        .drop("effective_date", "to_security_class", "to_shares")
    )


def class_at_realisation(lots: DataFrame, conversions: DataFrame) -> DataFrame:
    """Class and shares of a realised lot on the day it was realised."""
    one = conversions.select("lot_id", "effective_date", "to_security_class", "to_shares")
    converted = F.coalesce(F.col("effective_date") <= F.col("realized_date"), F.lit(False))
    return (
        lots.filter("realized_date IS NOT NULL").join(one, "lot_id", "left")
        .withColumn("exit_class", F.when(converted, F.col("to_security_class")).otherwise(F.col("security_class")))
        .withColumn("exit_shares", F.when(converted, F.col("to_shares")).otherwise(F.col("shares")))
    )


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """WIN-01/02/09: the row of each key that is last by the given columns, by one partially combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordered).alias("row")).select(*keys, "row.*")


def previous_mark(marks: DataFrame) -> DataFrame:
    """WIN-03/04: each latest mark beside the observation before it, lineage periods included.

    One holding has one latest mark per period, so a window here is bounded by the number of periods.
    """
    current = latest(marks, ["holding_id", "period_id"], "revision")
    by_date = Window.partitionBy("holding_id").orderBy("period_date")
    return (
        current.withColumn("previous_date", F.lag("period_date").over(by_date))
        .withColumn("previous_amount", F.lag("reported_amount").over(by_date))
    )


def change_view(marks: DataFrame) -> DataFrame:
    """WIN-04: one row per observation with the change since the one before."""
    return previous_mark(marks).select(
        "holding_id", "period_id", "period_date", "audit_scope", F.col("reported_amount").alias("amount"), "previous_amount",
        (F.col("reported_amount") - F.col("previous_amount")).cast("decimal(24,4)").alias("delta"),
        (F.col("reported_amount") != F.col("previous_amount")).alias("changed"),
    )


def latest_support(support: DataFrame, dates: DataFrame) -> DataFrame:
    """WIN-08: latest support on or before each date per component; null when there is none."""
    days = support.select("holding_id", "component", "supported_on").distinct()
    met = dates.join(days, "holding_id").filter(F.col("supported_on") <= F.col("period_date"))
    return met.groupBy("holding_id", "period_id", "component").agg(F.max("supported_on").alias("latest_support"))


def latest_candidates(lots: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-06/07: which lots could be the most recent, and which definitely follow another.

    The pairwise test becomes two extremes per position: no lot follows one whose last possible day reaches the
    latest first day; a lot follows some other when its first day is after the earliest last day.
    """
    extremes = lots.groupBy(*keys).agg(F.max("lo").alias("latest_lo"), F.min("hi").alias("earliest_hi"))
    keyed = lots
    for k in keys:
        keyed = keyed.withColumnRenamed(k, f"_{k}")
        extremes = extremes.withColumnRenamed(k, f"__{k}")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(f"__{k}"))
    joined = keyed.join(extremes, same)
    for k in keys:
        joined = joined.withColumnRenamed(f"_{k}", k).drop(f"__{k}")
    return (
        joined.withColumn("candidate", F.col("lo").isNull() | F.col("latest_lo").isNull() | (F.col("hi") >= F.col("latest_lo")))
        .withColumn("follows", F.coalesce(F.col("lo") > F.col("earliest_hi"), F.lit(False)))
        .drop("latest_lo", "earliest_hi")
    )


def as_of_latest(left: DataFrame, right: DataFrame, key: str, on: str, day: str, tie: str, carry: list[str]) -> DataFrame:
    """JN-16: the last right row on or before each left date (ties by id), nulls when there is none."""
    probe = left.select(key, on).distinct()
    found = (
        probe.join(right.select(key, day, tie, *[c for c in carry if c not in (day, tie)]), key).filter(F.col(day) <= F.col(on))
        .groupBy(key, on).agg(F.max_by(F.struct(*carry), F.struct(day, tie)).alias("row")).select(key, on, "row.*")
    )
    return left.join(found, [key, on], "left")


def first_on_or_after(rows: DataFrame, key: str, day: str, dates: DataFrame, on: str, into: str) -> DataFrame:
    """The rows with the first date of their key (``dates``: key, ``on``) that is not before their day; null when there is none.

    Days are taken once per key, so a window holds the distinct days of a key and never its rows.
    """
    days = rows.select(key, F.col(day).alias("_day")).filter("_day IS NOT NULL").distinct()
    both = days.withColumn("_date", F.lit(None).cast("date")).unionByName(dates.select(key, F.col(on).alias("_day"), F.col(on).alias("_date")).distinct())
    from_here = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn(into, F.min("_date").over(from_here)).filter("_date IS NULL").select(F.col(key).alias("_key"), F.col("_day"), into)
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col(day) == F.col("_day")), "left").drop("_key", "_day")


def sums_at(events: DataFrame, keys: list[str], day: str, values: list[str], asked: DataFrame, on: str) -> DataFrame:
    """Running sums of events by key, read at the dates ``asked`` (keys, ``on``): events of the day itself count.

    Events are added up by key and day before anything is put in order, so a key costs its distinct days and its dates, and no
    event meets a date.
    """
    daily = events.groupBy(*keys, F.col(day).alias("_day")).agg(*[F.sum(v).alias(v) for v in values])
    wanted = asked.select(*keys, F.col(on).alias("_day")).distinct()
    both = daily.withColumn("_asked", F.lit(False)).unionByName(wanted.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    # False is before true.
    up_to = Window.partitionBy(*keys).orderBy("_day", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.select(*keys, F.col("_day").alias(on), "_asked", *[F.coalesce(F.sum(v).over(up_to), F.lit(0)).alias(v) for v in values])
    return summed.filter("_asked").drop("_asked")
