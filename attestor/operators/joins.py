"""Joins between workbooks and ledger, and the refusals that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import temporal
from attestor.sources import workbook
from attestor.sources.ledger import Ledger

MONEY = "decimal(36,6)"


def tranches(fr) -> DataFrame:
    """Tranche rows of every sheet with their fund, flags and day range; stored once beside the ledger."""
    return fr.kept("tranches", lambda: workbook.tranches(fr.kept("sheet_funds", lambda: workbook.sheet_funds(fr["f_sheet"])), fr["f_breakdown"]))


def packet_dates(fr) -> DataFrame:
    """fund (as the workbooks name it) and period_end of every packet."""
    labels = fr["f_fund"].select("fund_id", S.fund_key(F.col("fund_label")).alias("fund"))
    return fr["f_period"].filter("audit_scope = 'packet'").join(labels, "fund_id").select("fund", F.col("period_date").alias("period_end")).distinct()


#: Running figures of a position: rows that surely are there, rows of which it is not known, shares of the sure ones.
RUNNING = ("bought", "sold", "buy_unknown", "exit_unknown", "uncounted", "bought_shares", "sold_shares")


def interval_events(rows: DataFrame) -> DataFrame:
    """Each dated row as two events: from its first possible day it may be there, from its last it is.

    Between the two days nobody can tell. A row without a first day may be there from the beginning, one without a last day
    never surely is.
    """
    out = F.col("is_exit")
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    none, zero = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,6)")
    shares = F.coalesce(F.col("share_count"), zero).cast("decimal(38,6)")
    figures = {
        "bought": (none, flag(~out)), "sold": (none, flag(out)), "buy_unknown": (flag(~out), -flag(~out)), "exit_unknown": (flag(out), -flag(out)),
        "uncounted": (none, flag(F.col("share_count").isNull())), "bought_shares": (zero, F.when(~out, shares).otherwise(zero)), "sold_shares": (zero, F.when(out, shares).otherwise(zero))}
    first = F.when(F.col("lo").isNotNull(), F.least("lo", "hi")).otherwise(F.lit("0001-01-01").cast("date"))
    events = F.array(*[F.struct(day.alias("day"), *[figures[name][n].alias(name) for name in RUNNING]) for n, day in enumerate((first, F.col("hi")))])
    return rows.withColumn("_event", F.explode(events)).filter("_event.day IS NOT NULL").select(*rows.columns, "_event.*")


def running_at(rows: DataFrame, keys: list[str], dates: DataFrame, on: str) -> DataFrame:
    """The running figures of every key at the dates that ``dates`` (keys or some of them, ``on``) asks of it."""
    shared = [k for k in keys if k in dates.columns]
    asked = rows.select(*keys).distinct().join(dates.select(*shared, on).distinct(), shared)
    return temporal.sums_at(interval_events(rows), keys, "day", list(RUNNING), asked, on)


def position_held(figures: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-04: was a position held, yes, no or cannot tell, from its running figures at a date."""
    unknown = F.lit(None).cast("boolean")
    return figures.select(*keys, F.when(F.col("exit_unknown") > 0, unknown)
                          .when(F.col("bought") == 0, F.when(F.col("buy_unknown") > 0, unknown).otherwise(False))
                          .when(F.col("sold") == 0, True).when(F.col("uncounted") > 0, unknown)
                          .otherwise(F.col("sold_shares") < F.col("bought_shares")).alias("held"))


def known_by(rows: DataFrame, dates: DataFrame, on: str) -> DataFrame:
    """FLT-03: at each date, of how many rows it is sure that they were there, that they were not, and not known."""
    figures = running_at(rows, ["fund"], dates, on)
    every = rows.groupBy("fund").agg(F.count("*").alias("rows"))
    yes, unknown = F.col("bought") + F.col("sold"), F.col("buy_unknown") + F.col("exit_unknown")
    return figures.join(every, "fund").groupBy(on).agg(F.sum(yes).alias("yes"), F.sum(F.col("rows") - yes - unknown).alias("no"), F.sum(unknown).alias("unknown"))


def held_during_reported_period(ledger: Ledger) -> DataFrame:
    """FLT-09: held at some time in the interval opening at the previous packet date; no lots at all reads as held."""
    packet = ledger.packet_period.select(F.col("fund_id").alias("packet_fund"), F.col("period_date").alias("packet_date"))
    opens = (
        ledger.period.join(packet, (F.col("packet_fund") == F.col("fund_id")) & (F.col("packet_date") < F.col("period_date")), "left")
        .groupBy("fund_id", "period_id", "period_date").agg(F.max("packet_date").alias("opens")))
    dates = ledger.holding.select("holding_id", "fund_id").join(opens, "fund_id")
    lots = ledger.lot.select("holding_id", "acquired_date", "realized_date")
    touched = (F.col("acquired_date") <= F.col("period_date")) & (
        F.col("realized_date").isNull() | F.col("opens").isNull() | (F.col("realized_date") > F.col("opens")))
    # One interval per holding and period is enough, so lots collapse to their first purchase per exit state and day.
    seen = lots.groupBy("holding_id", "realized_date").agg(F.min("acquired_date").alias("acquired_date"))
    met = dates.join(seen, "holding_id").groupBy("holding_id", "period_id").agg(F.bool_or(touched).alias("touched"))
    return dates.join(met, ["holding_id", "period_id"], "left").withColumn("held_during", F.coalesce("touched", F.lit(True)))


def tracker_costs(fr) -> DataFrame:
    grid = workbook.company_rows(fr["f_grid"]).withColumn("stated", S.number_from_cell(F.col("cost_cell"))).filter("stated IS NOT NULL")
    return grid.groupBy(S.fund_key(F.col("sheet")).alias("fund"), S.company_key(F.col("company")).alias("company")).agg(F.sum("stated").cast(MONEY).alias("stated"))


def breakdown_costs(fr) -> DataFrame:
    """AGG-02: investment per (fund, company), purchases only."""
    return tranches(fr).filter("is_investment").groupBy("fund", "company").agg(F.sum("investment").cast(MONEY).alias("computed"))


def cost_bases(fr) -> DataFrame:
    """JN-04: both workbooks on (fund, company key), neither side dropped."""
    return tracker_costs(fr).join(breakdown_costs(fr), ["fund", "company"], "full")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str) -> DataFrame:
    """JN-05/SET-04: keys found on one side only, with the side."""
    l, r = left.select(*keys), right.select(*keys)
    return l.join(r, keys, "left_anti").withColumn("side", F.lit(left_name)).unionByName(
        r.join(l, keys, "left_anti").withColumn("side", F.lit(right_name)))


def ambiguous_keys(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """JN-06: keys that more than one source row reduces to; these are refused before any join."""
    return rows.groupBy(*keys).agg(F.countDistinct(source).alias("sources")).filter("sources > 1")


def claim_documents(ledger: Ledger) -> DataFrame:
    """JN-12: claim to document version to file, text left out unless asked for."""
    return ledger.claim.join(ledger.document.select("document_no", "document_id", "filename", "extractor"), "document_no")


def latest_decisions(ledger: Ledger, kind: str = "valuation") -> DataFrame:
    decisions = ledger.decision.filter(F.col("decision_type") == kind).select("mark_id", "decision_id", "decided_at", "status", "actor_id")
    return temporal.latest(decisions, ["mark_id"], "decided_at", "decision_id")


def marks_with_decisions(ledger: Ledger) -> DataFrame:
    """JN-14: latest packet marks, their holding, and the latest valuation decision if there is one."""
    marks = temporal.latest(
        ledger.mark.filter("audit_scope = 'packet'").select("holding_id", "period_id", "revision", "mark_id", "reported_amount", "reported_currency"),
        ["holding_id", "period_id"], "revision")
    return marks.join(ledger.holding.select("holding_id", "fund_id", "company_name"), "holding_id").join(latest_decisions(ledger), "mark_id", "left")


def comparable_rounds(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-15: two statements of a round compare only when all five parts of the key agree."""
    parts = ["claim_id", "company", "round_name", "effective_date", "currency", "scope"]
    hit = right.select(*parts).withColumn("same", F.lit(True))
    return left.join(hit, parts, "left").withColumn("state", F.when(F.col("same"), "comparable").otherwise("not_comparable"))


def claims_with_facts(claims: DataFrame, facts: DataFrame, order: str) -> DataFrame:
    """JN-17: each claim with its facts; a claim states at most one value per declared field, so the list is short."""
    folded = facts.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(order, "field_name", "value_text", "value_numeric", "state"))).alias("facts"))
    empty = F.array().cast(folded.schema["facts"].dataType)
    return claims.join(folded, "claim_id", "left").withColumn("facts", F.coalesce("facts", empty))
