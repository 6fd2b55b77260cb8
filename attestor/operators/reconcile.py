"""Reconciliation of two workbooks: every check yields findings of one shape.

Findings carry counts where a sheet could name any number of contributors; the contributors are rows of their own
frame, so no cell grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import joins, temporal
from attestor.sources import workbook

MONEY = "decimal(34,6)"
POSITION = ["fund", "company"]
FINDING = ["kind", "subject", "scope", "stated", "computed", "detail"]


def figure(value: Column) -> Column:
    return F.format_number(value, 2)


def finding(df: DataFrame, kind: str | Column, subject: Column, detail: Column, stated: Column | None = None,
            computed: Column | None = None, scope: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), subject.alias("subject"),
        (none.cast("string") if scope is None else scope).alias("scope"),
        (none if stated is None else stated).cast(MONEY).alias("stated"),
        (none if computed is None else computed).cast(MONEY).alias("computed"), detail.alias("detail"))


@dataclass(frozen=True)
class Workbooks:
    """The valuation grid and the master breakdown, typed, with the facts the checks share."""

    grid: DataFrame
    tranche: DataFrame
    packet_periods: dict[str, tuple[str, ...]]

    @cached_property
    def cells(self) -> DataFrame:
        long = workbook.unpivot_grid(workbook.company_rows(self.grid))
        return long.withColumn("fund", S.fund_key(F.col("sheet"))).withColumn("key", S.company_key(F.col("company")))

    @cached_property
    def stated(self) -> DataFrame:
        return workbook.unpivot_grid(workbook.total_rows(self.grid)).filter("amount IS NOT NULL").select("sheet", "label", F.col("amount").alias("stated"))

    @cached_property
    def labels(self) -> DataFrame:
        """The period columns every sheet has, as a frame; their number is the width of the grid."""
        names = [c[2:] for c in self.grid.columns if c.startswith("p_")]
        sheets = self.grid.select("sheet").distinct()
        return sheets.withColumn("label", F.explode(F.array(*[F.lit(n) for n in names])))

    @cached_property
    def recognised(self) -> DataFrame:
        """REC-17: rows of a recognised kind; exits stay, because a position may only have been sold."""
        return self.tranche.filter("is_exit OR is_investment").withColumn("priced", F.col("share_price").isNotNull() & F.col("share_count").isNotNull())

    @cached_property
    def comparable(self) -> DataFrame:
        """REC-17: positions with at least two priced purchases."""
        counted = self.recognised.groupBy(*POSITION).agg(F.count_if(F.col("is_investment") & F.col("priced")).alias("priced_purchases"))
        return counted.filter("priced_purchases >= 2").select(*POSITION)

    @cached_property
    def dated_marks(self) -> DataFrame:
        """REC-15: marks whose label reads as a date, with the cost the tracker states for the same row."""
        return self.cells.withColumn("measured", S.period_end(F.col("label"))).filter("amount IS NOT NULL AND measured IS NOT NULL").select(
            "fund", F.col("key").alias("company"), F.col("company").alias("row_label"), "label", "measured", "amount",
            S.number_from_cell(F.col("cost_cell")).alias("tracker_cost"))

    @cached_property
    def dated_rows(self) -> DataFrame:
        """Recognised rows against the marks of their position, with the three-valued held flag."""
        marks = self.dated_marks.select(*POSITION, "row_label", "label", "measured", "amount", "tracker_cost")
        met = self.recognised.join(marks, POSITION)
        return met.withColumn("by_then", temporal.acquired_by(F.col("lo"), F.col("hi"), F.col("measured")))

    @cached_property
    def position_facts(self) -> DataFrame:
        """REC-13, first pass: one row per position and mark from conditional aggregates."""
        by, priced = F.col("by_then"), F.col("priced")
        held = F.col("is_investment") & F.coalesce(by, F.lit(False))
        gone = F.col("is_exit") & F.coalesce(by, F.lit(True))
        zero = F.lit(0).cast(MONEY)
        total = lambda cond, column: F.coalesce(F.sum(F.when(cond, F.col(column))), zero).cast(MONEY)
        facts = self.dated_rows.groupBy(*POSITION, "row_label", "label", "measured", "amount", "tracker_cost").agg(
            F.bool_or(held).alias("any_held"), F.bool_or(F.col("is_investment") & by.isNull()).alias("undecidable"),
            F.bool_or(gone).alias("any_exit"), F.bool_or(F.col("is_exit") & by.isNull()).alias("exit_unknown"),
            F.bool_or(held & ~priced).alias("any_unpriced"),
            total(held, "investment").alias("held_cost"), total(F.col("is_investment"), "investment").alias("lifetime_cost"),
            total(held & priced, "share_count").alias("priced_shares"), total(held & ~priced, "investment").alias("unpriced_cost"),
            total(held & ~priced, "share_count").alias("dropped_shares"), total(gone, "share_count").alias("sold_shares"),
            F.min(F.when(held & priced, F.col("share_price"))).alias("low_price"), F.max(F.when(held & priced, F.col("share_price"))).alias("high_price"),
            F.max(F.when(held & priced, F.col("lo"))).alias("latest_lo"), F.min(F.when(held & priced, F.col("hi"))).alias("earliest_hi"))
        one_price = F.col("any_held") & ~F.col("undecidable") & ~F.col("any_unpriced") & (F.col("low_price") == F.col("high_price"))
        facts = facts.withColumn("invariant", F.coalesce(one_price, F.lit(False)))
        remaining = (F.col("priced_shares") - F.col("sold_shares")).cast("decimal(18,6)")
        shortcut = F.col("any_exit") & F.col("invariant") & (remaining > 0)
        facts = facts.withColumn("shortcut", shortcut).withColumn("remaining", remaining)
        left = (F.col("remaining") * F.col("low_price").cast("decimal(18,6)")).cast(MONEY)
        return (
            facts.withColumn("realised", F.col("any_exit") & ~F.col("shortcut"))
            .withColumn("cost", F.when(F.col("shortcut"), left).otherwise(F.col("held_cost")))
            .withColumn("shares", F.when(F.col("shortcut"), F.col("remaining").cast(MONEY)).otherwise(F.col("priced_shares")))
            .withColumn("unpriced_cost", F.when(F.col("shortcut"), zero).otherwise(F.col("unpriced_cost")))
            .withColumn("dropped_shares", F.when(F.col("shortcut"), zero).otherwise(F.col("dropped_shares")))
            .withColumn("repriced", ~F.col("shortcut") & F.coalesce(F.col("low_price") != F.col("high_price"), F.lit(False)))
            .withColumn("usable", F.col("any_held") & ~F.col("undecidable") & ~F.col("realised"))
        )

    @cached_property
    def implied(self) -> DataFrame:
        """REC-13, second pass: the value each possibly latest purchase implies, reduced to what the checks ask."""
        key = [*POSITION, "row_label", "label"]
        extremes = self.position_facts.filter("usable").select(*key, "shares", "unpriced_cost", "latest_lo", "earliest_hi")
        held = self.dated_rows.filter("is_investment AND by_then AND priced").select(*key, "amount", "row_no", "lo", "hi", "share_price", "acquired_text")
        lots = held.join(extremes, key).filter(F.col("hi") >= F.col("latest_lo"))
        value = (F.col("shares").cast("decimal(18,6)") * F.col("share_price").cast("decimal(18,6)")).cast("decimal(33,6)") + F.col("unpriced_cost").cast("decimal(33,6)")
        lots = lots.withColumn("value", value.cast(MONEY)).withColumn("gap", (F.col("value").cast("decimal(33,6)") - F.col("amount").cast("decimal(33,6)")).cast(MONEY))
        widest = F.struct(F.abs("gap"), -F.col("row_no"))
        return lots.groupBy(*key).agg(
            F.count("*").alias("candidates"), F.bool_and(S.is_material(F.col("gap"), F.col("value"))).alias("all_material"),
            F.bool_or(F.col("gap") == 0).alias("reproduced"),
            F.max_by(F.struct("value", "share_price", "acquired_text", (F.col("lo") > F.col("earliest_hi")).alias("follows")), widest).alias("pick"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.position_facts.join(self.implied, [*POSITION, "row_label", "label"], "left")

    def scope(self) -> Column:
        return S.period_scope(F.col("fund"), F.col("label"), self.packet_periods)

    def subject(self) -> Column:
        return F.concat_ws(" · ", "company", "label")


def from_frames(fr, packet_periods: dict[str, tuple[str, ...]]) -> Workbooks:
    return Workbooks(fr["f_grid"], joins.tranches(fr), packet_periods)


def composition() -> Column:
    """REC-14: how a value is composed, with every assumption it makes."""
    when = F.when(F.col("pick.follows"), "later ").otherwise("")
    first = F.concat(F.lit("all "), figure(F.col("shares")), F.lit(" shares of the day, each at the "), when, "pick.acquired_text", F.lit(" price paid, "), F.col("pick.share_price").cast("string"))
    plus = F.when(F.col("unpriced_cost") != 0, F.concat(F.lit("plus "), figure(F.col("unpriced_cost")), F.lit(" of purchases without a price, left at what they cost")))
    caveats = F.concat_ws("; and ", F.when(F.col("repriced"), "one price stands for lots that cost differently, of whatever class"),
                          F.when(F.col("candidates") > 1, F.concat(F.col("candidates").cast("string"), F.lit(" purchases could each be the last, and this is one"))),
                          F.when(F.col("dropped_shares") != 0, F.concat(figure(F.col("dropped_shares")), F.lit(" shares without a price stay out"))))
    return F.concat(F.concat_ws(", ", first, plus), F.lit(" is "), figure(F.col("pick.value")),
                    F.when(caveats != "", F.concat(F.lit(" - a reading and no row, since "), caveats)).otherwise(""))


def stated_totals(w: Workbooks) -> DataFrame:
    """REC-01: column sums against stated totals; a column without a stated total is a finding of its own."""
    sums = w.cells.groupBy("sheet", "fund", "label").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("computed"), F.count("amount").alias("contributors"))
    both = w.labels.join(w.stated, ["sheet", "label"], "left").join(sums, ["sheet", "label"], "left").withColumn("fund", S.fund_key(F.col("sheet")))
    wrong = both.filter(F.col("stated").isNotNull() & (F.col("computed") != F.col("stated")))
    subject = F.concat_ws(" · ", "sheet", "label")
    return finding(wrong, "stated_total_disagrees_with_cells", subject, F.concat(
        F.lit("its cells add up to "), figure(F.col("computed")), F.lit(" across "), F.col("contributors").cast("string"),
        F.lit(" positions, yet the sheet says "), figure(F.col("stated"))), F.col("stated"), F.col("computed"), w.scope()
    ).unionByName(finding(both.filter("stated IS NULL"), "no_stated_total_to_check", subject,
                          F.lit("positions are there, a stated total is not; nothing could be checked")))


def contributors(w: Workbooks) -> DataFrame:
    """The positions behind each column total, one row each."""
    return w.cells.filter("amount IS NOT NULL").select("sheet", "label", "company", "amount")


def stated_cost_total(w: Workbooks) -> DataFrame:
    """REC-02: the cost column against its stated total."""
    cost = S.number_from_cell(F.col("cost_cell"))
    computed = workbook.company_rows(w.grid).groupBy("sheet").agg(F.sum(cost).cast(MONEY).alias("computed"))
    stated = workbook.total_rows(w.grid).select("sheet", cost.alias("stated")).filter("stated IS NOT NULL")
    wrong = stated.join(computed, "sheet", "left").withColumn("computed", F.coalesce("computed", F.lit(0).cast(MONEY))).filter("computed <> stated")
    return finding(wrong, "cost_total_disagrees_with_cells", F.concat("sheet", F.lit(" · cost basis")), F.concat(
        F.lit("its cells add up to "), figure(F.col("computed")), F.lit(", yet the sheet says "), figure(F.col("stated"))), F.col("stated"), F.col("computed"))


def tranche_arithmetic(w: Workbooks) -> DataFrame:
    """REC-03: price times count against the stated investment, purchases only."""
    exact = S.implied_cost(F.col("share_price"), F.col("share_count"))
    wrong = w.tranche.filter("is_investment").withColumn("implied", exact.cast(MONEY)).filter(exact != F.col("investment").cast("decimal(37,12)"))
    return finding(wrong, "tranche_arithmetic_disagrees", F.concat_ws(" · ", "company", "acquired_text"), F.concat(
        figure(F.col("share_count")), F.lit(" shares at "), F.col("share_price").cast("string"), F.lit(" is "), figure(F.col("implied")),
        F.lit(", yet the sheet says an investment of "), figure(F.col("investment"))), F.col("investment"), F.col("implied"))


def recognised_kinds(w: Workbooks) -> DataFrame:
    """REC-04: rows that are neither an investment nor an exit and so are in no total."""
    odd = w.tranche.filter("NOT is_exit AND NOT is_investment")
    return finding(odd, "unrecognised_tranche_kind", F.concat_ws(" · ", "company", "acquired_text"), F.concat(
        F.lit("row type "), "kind", F.lit(" is no purchase and no exit; its "), figure(F.col("investment")), F.lit(" counts in no total")))


def cost_bases(w: Workbooks) -> DataFrame:
    """REC-05: cost per company across the two workbooks; a company on one side only was never compared."""
    cost = S.number_from_cell(F.col("cost_cell"))
    rows = workbook.company_rows(w.grid).withColumn("stated", cost).filter("stated IS NOT NULL").withColumn(
        "fund", S.fund_key(F.col("sheet"))).withColumn("key", S.company_key(F.col("company")))
    computed = w.tranche.filter("is_investment").groupBy("fund", F.col("company").alias("key")).agg(F.sum("investment").cast(MONEY).alias("computed"))
    both = rows.select("fund", "key", "company", "stated").join(computed, ["fund", "key"], "full")
    never = both.filter("computed IS NULL OR stated IS NULL")
    subject = F.when(F.col("stated").isNotNull(), F.col("company")).otherwise(F.concat_ws(" · ", "fund", "key"))
    detail = F.when(F.col("stated").isNotNull(), F.concat(F.lit("the tracker has "), figure(F.col("stated")), F.lit(", and the breakdown has no sheet under this name"))).otherwise(
        F.concat(F.lit("the breakdown has "), figure(F.col("computed")), F.lit(", and the tracker has no cost for this name")))
    differ = both.filter("computed <> stated")
    return finding(never, "cost_basis_never_compared", subject, detail, F.col("stated"), F.col("computed")).unionByName(
        finding(differ, "cost_basis_disagrees_across_workbooks", F.col("company"), F.concat(
            F.lit("the tracker has "), figure(F.col("stated")), F.lit("; its breakdown tranches add up to "), figure(F.col("computed"))), F.col("stated"), F.col("computed")))


def latest_purchase(w: Workbooks) -> DataFrame:
    """REC-06: can the most recent priced purchase be told, and do the possible ones agree on a price."""
    priced = w.recognised.filter("is_investment AND priced").join(w.comparable, POSITION, "left_semi")
    undated = priced.groupBy(*POSITION).agg(F.count_if(F.col("lo").isNull()).alias("undated")).filter("undated > 0")
    could = temporal.latest_candidates(priced, POSITION).filter("candidate").groupBy(*POSITION).agg(
        F.count("*").alias("candidates"), F.countDistinct("share_price").alias("prices")).filter("candidates >= 2 AND prices >= 2")
    return finding(undated, "purchase_date_unreadable", F.col("company"), F.concat(
        F.col("undated").cast("string"), F.lit(" priced purchase(s) have an unreadable date; their marks were not checked"))).unionByName(
        finding(could, "latest_purchase_is_ambiguous", F.col("company"), F.concat(
            F.lit("which of "), F.col("candidates").cast("string"), F.lit(" purchases came last stays open, and their prices are "), F.col("prices").cast("string"), F.lit(" prices"))))


def holding_dates(w: Workbooks) -> DataFrame:
    """REC-07: measurement dates that fall inside a purchase date range."""
    blocked = w.position_facts.filter("undecidable").groupBy(*POSITION).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return finding(blocked, "holding_at_date_undecidable", F.col("company"), F.concat(
        F.lit("at "), F.concat_ws(", ", "labels"), F.lit(" one purchase date could fall on either side of the measured day, so it stays open if that lot counts")))


def unreached_marks(w: Workbooks) -> DataFrame:
    """REC-08: dated marks no position of the breakdown answers, with the reason why."""
    reachable = w.recognised.select(*POSITION).distinct()
    odd = w.tranche.filter("NOT is_exit AND NOT is_investment").select(*POSITION).distinct().withColumn("odd", F.lit(True))
    lost = w.dated_marks.join(reachable, POSITION, "left_anti").join(odd, POSITION, "left")
    why = F.when(F.col("odd"), "the breakdown rows under this name are neither purchases nor exits").otherwise("the breakdown has nothing under this name in the fund")
    return finding(lost, "mark_never_compared", F.concat_ws(" · ", "row_label", "label"),
                   F.concat(F.lit("the tracker has a figure, but "), why), scope=w.scope())


def realisations(w: Workbooks) -> DataFrame:
    """REC-09: realisations that the workbooks do not allot to lots, unless every held lot has one price."""
    open_exits = w.position_facts.filter(F.col("any_exit") & ~(~F.col("exit_unknown") & F.col("invariant")))
    when = F.when(F.col("exit_unknown"), "may lie before or after the measured day").otherwise("lies before the measured day")
    return finding(open_exits, "realisation_not_allocated_to_lots", w.subject(), F.concat(
        F.lit("an exit of "), figure(F.col("sold_shares")), F.lit(" shares "), when, F.lit(", with no word in either workbook on the lots it used up")), scope=w.scope())


def period_labels(w: Workbooks) -> DataFrame:
    """REC-10: labels with figures under them that do not read as a date."""
    positions = w.recognised.select(*POSITION).distinct()
    odd = w.cells.filter(F.col("amount").isNotNull() & S.period_end(F.col("label")).isNull()).select("fund", F.col("key").alias("company"), "label")
    named = odd.join(positions, POSITION, "left_semi").groupBy(*POSITION).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return finding(named, "unrecognised_period_label", F.col("company"), F.concat(F.lit("period label(s) "), F.concat_ws(", ", "labels"), F.lit(" cannot be read as a date")))


def held_at_cost(w: Workbooks) -> DataFrame:
    """REC-11: carried at cost while every possibly latest purchase implies a materially different value."""
    rows = w.facts.join(w.comparable, POSITION, "left_semi").filter(
        F.col("usable") & ~S.is_material(F.col("amount") - F.col("cost"), F.col("cost")) & F.col("all_material"))
    return finding(rows, "mark_at_cost_disagrees_with_purchase_prices", w.subject(), F.concat(
        F.lit("carried at "), figure(F.col("amount")), F.lit(", just the cost of the lots still held, whereas "), composition()), F.col("amount"), F.col("pick.value"), w.scope())


def mark_basis(w: Workbooks) -> DataFrame:
    """REC-12: a mark that neither cost nor purchase prices explain, or only under a treatment nobody states."""
    rows = w.facts.filter(F.col("usable") & S.is_material(F.col("amount") - F.col("cost"), F.col("cost")))
    none = F.col("candidates").isNull()
    single = (F.col("candidates") == 1) & F.col("repriced")
    rows = rows.filter(none | single | F.col("all_material"))
    on_tracker = F.col("tracker_cost").isNotNull() & (F.col("cost") == F.col("lifetime_cost")) & ~S.is_material(F.col("amount") - F.col("tracker_cost"), F.col("tracker_cost"))
    kind = F.when(~none & F.col("reproduced"), "mark_basis_assumes_an_unstated_treatment").otherwise("mark_basis_not_in_workbooks")
    computed = F.when(none, F.col("cost")).when(F.col("candidates") == 1, F.col("pick.value"))
    detail = F.when(none, F.concat(F.lit("carried at "), figure(F.col("amount")), F.lit(" against "), figure(F.col("cost")), F.lit(" of cost, and not one lot gives price and count together"))).otherwise(
        F.concat(F.lit("carried at "), figure(F.col("amount")), F.lit(", which the "), figure(F.col("cost")), F.lit(" not accounted for by the cost of lots still held. "),
                 F.when(F.coalesce(on_tracker, F.lit(False)), "The cost on the tracker is the same figure. ").otherwise(""),
                 F.when(F.col("reproduced"), "The figure comes out of ").otherwise("Prices paid give another figure: "), composition()))
    return finding(rows, kind, w.subject(), detail, F.col("amount"), computed, w.scope())


CHECKS = (stated_totals, stated_cost_total, recognised_kinds, tranche_arithmetic, cost_bases, unreached_marks, latest_purchase,
          realisations, holding_dates, period_labels, held_at_cost, mark_basis)


def all_findings(w: Workbooks) -> DataFrame:
    """SET-05: every check, one union; REC-16 adds computed minus stated."""
    out = CHECKS[0](w)
    for check in CHECKS[1:]:
        out = out.unionByName(check(w))
    return with_delta(out)


def with_delta(findings: DataFrame) -> DataFrame:
    """REC-16: null when either side is absent."""
    return findings.withColumn("delta", (F.col("computed") - F.col("stated")).cast("decimal(35,6)"))


def buckets(findings: DataFrame, scopes: tuple[str, ...] = ("packet", "lineage_only")) -> DataFrame:
    """AGG-17: findings per scope and kind; a scope without any keeps its line."""
    spark = findings.sparkSession
    listed = spark.createDataFrame([(s,) for s in (*scopes, "unscoped")], "scope string")
    counted = findings.groupBy(F.coalesce("scope", F.lit("unscoped")).alias("scope"), "kind").agg(F.count("*").alias("findings"))
    return counted.join(F.broadcast(listed), "scope", "right").withColumn("findings", F.coalesce("findings", F.lit(0)))
