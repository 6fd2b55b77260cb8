"""Workbook rows to ledger rows: sheets, tranches, notes, position types, classes, lots and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import order, temporal


def typed_note_cells(rows: DataFrame) -> DataFrame:
    """FN-38: cells of a note row read as figure, whole number and day."""
    figure = F.regexp_replace(F.trim("c4"), "[,$]", "").try_cast(S.NUMBER)
    return (
        rows.withColumn("figure", figure)
        .withColumn("whole", F.when(F.col("figure") == F.floor("figure"), F.col("figure").cast("bigint")))
        .withColumn("day", S.exact_day(F.col("c5")))
    )


# --- fixed values -----------------------------------------------------------------------------
POSITION_SIGNALS = (
    ("indirect_feeder", r"(?i)indirect (?:fund|exposure)|feeder"),
    ("public_listed", r"(?i)de-spac|public listing|quoted closing price"),
    ("fx_denominated_interest", r"\b(?!USD\b)[A-Z]{3}-denominated\b"),
)
SERIES = r"\bSeries\s+([A-Z](?:-\d+)?)\b"
INSTRUMENT_KINDS = (("conv_note", r"(?i)conv\.?\s*note|convertible note"), ("lp_interest", r"(?i)indirect fund"))
INSTRUMENT_NOTES = (("fund_interest", r"(?i)\b[A-Z]{3}-denominated fund interest"), ("lp_interest", r"(?i)capital account statement|feeder"))
LISTED_CLASS = "common"
UNSTATED = "unstated"
CHROME = r"(?i)^(supporting documentation|case study material)"
RECAP_KIND = r"(?i)post-recap|recapitali[sz]ation|conversion"
ASSUMED_CURRENCY = "USD"
# --- end of fixed values ----------------------------------------------------------------------
SHEET = ["sheet_no"]


def position_types(notes: DataFrame, tranches: DataFrame, sheets: DataFrame) -> DataFrame:
    """MAP-01: one position type per sheet from every line on it; two different signals refuse the sheet."""
    lines = notes.select("sheet_no", F.lit(0).alias("part"), F.col("ordinal").alias("row_no"), F.col("text").alias("line")).unionByName(
        tranches.select("sheet_no", F.lit(1).alias("part"), "row_no", F.col("kind").alias("line")))
    signals = [F.min_by("line", F.when(F.col("line").rlike(pattern), F.struct("part", "row_no"))).alias(name) for name, pattern in POSITION_SIGNALS]
    seen = lines.groupBy("sheet_no").agg(*signals)
    names = [n for n, _ in POSITION_SIGNALS]
    hits = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    out = sheets.select("sheet_no", "title", "fund").join(seen, "sheet_no", "left").withColumn("hits", hits)
    return out.select(
        "sheet_no", "title", "fund", F.when(F.size("hits") > 1, F.lit(None)).when(F.size("hits") == 1, F.col("hits")[0]).otherwise("direct_equity").alias("position_type"),
        F.when(F.size("hits") == 1, F.coalesce(*names)).when(F.size("hits") == 0, "no line names a feeder, a listing or a foreign denomination").alias("source_text"),
        F.when(F.size("hits") > 1, F.concat(F.lit("more than one position type: "), F.concat_ws(", ", "hits"))).alias("refusal"))


def named_classes(notes: DataFrame) -> DataFrame:
    """Classes that documentation lines of a sheet name, by the month or year the line is dated."""
    series = F.regexp_extract("text", SERIES, 1)
    kept = notes.filter(~F.col("text").rlike(CHROME)).withColumn("series", series).filter("series <> ''").withColumn("d", S.dated(F.col("text")))
    return kept.select("sheet_no", "d.year", "d.month", S.class_slug(F.col("series")).alias("slug"))


def class_on(frame: DataFrame, classes: DataFrame, day: str) -> DataFrame:
    """The class named for a day: lines of its month first, of its year next; two lines in a pool decide nothing."""
    exact = classes.filter("month IS NOT NULL").groupBy("sheet_no", "year", "month").agg(F.count("*").alias("in_month"), F.min("slug").alias("month_slug"))
    yearly = classes.groupBy("sheet_no", "year").agg(F.count("*").alias("in_year"), F.min("slug").alias("year_slug"))
    keyed = frame.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    joined = keyed.join(exact, ["sheet_no", "year", "month"], "left").join(yearly, ["sheet_no", "year"], "left")
    named = F.when(F.col("in_month") == 1, F.col("month_slug")).when(F.col("in_month").isNull() & (F.col("in_year") == 1), F.col("year_slug"))
    return joined.withColumn("dated_class", named).drop("year", "month", "in_month", "in_year", "month_slug", "year_slug")


def security_classes(tranches: DataFrame, notes: DataFrame, types: DataFrame, overrides: DataFrame) -> DataFrame:
    """MAP-02: class of each purchase by declared priority, with the rule that decided.

    ``overrides`` (company, document_class) comes from executed documents and is a reviewed, short list.
    """
    candidates = notes.filter(~F.col("text").rlike(CHROME))
    marks = candidates.groupBy("sheet_no").agg(*[F.bool_or(F.col("text").rlike(p)).alias(f"note_{n}") for n, p in INSTRUMENT_NOTES])
    purchases = tranches.filter("is_investment")
    rows = class_on(purchases, named_classes(notes), "lo").join(marks, "sheet_no", "left").join(types.select("sheet_no", "position_type"), "sheet_no", "left").join(overrides, "company", "left")
    steps = [(F.col("kind").rlike(p), F.lit(n), "instrument_kind") for n, p in INSTRUMENT_KINDS]
    steps.append((F.col("document_class").isNotNull(), F.col("document_class"), "executed_document"))
    steps.append((F.col("dated_class").isNotNull(), F.col("dated_class"), "dated_line"))
    steps += [(F.coalesce(F.col(f"note_{n}"), F.lit(False)), F.lit(n), "instrument_note") for n, _ in INSTRUMENT_NOTES]
    steps.append((F.coalesce(F.col("position_type") == "public_listed", F.lit(False)), F.lit(LISTED_CLASS), "listed_default"))
    value, rule = F.lit(UNSTATED), F.lit("unstated")
    for condition, result, name in reversed(steps):
        value, rule = F.when(condition, result).otherwise(value), F.when(condition, F.lit(name)).otherwise(rule)
    return rows.withColumn("security_class", value).withColumn("class_rule", rule).drop("document_class", "dated_class", *[f"note_{n}" for n, _ in INSTRUMENT_NOTES])


def recapitalisations(notes: DataFrame) -> DataFrame:
    """MAP-03: the first recapitalisation row of a sheet, typed; an incomplete one is refused with what it lacks."""
    rows = notes.filter(F.col("text").rlike(RECAP_KIND)).groupBy("sheet_no").agg(F.min_by(F.struct("text", "cells"), "ordinal").alias("r"))
    figure = lambda n: F.regexp_replace(F.trim(F.col("r.cells")[n]), "[,$]", "").try_cast(S.NUMBER)
    typed = rows.select("sheet_no", F.col("r.text").alias("text"), figure(4).alias("raw_shares"), figure(3).alias("price_per_share"), S.exact_day(F.col("r.cells")[5]).alias("effective_date"))
    typed = typed.withColumn("shares", F.when(F.col("raw_shares") == F.floor("raw_shares"), F.col("raw_shares").cast("decimal(18,0)"))).drop("raw_shares")
    placed = class_on(typed, named_classes(notes), "effective_date")
    lacking = F.concat_ws(",", F.when(F.col("shares").isNull(), "shares"), F.when(F.col("price_per_share").isNull(), "price"), F.when(F.col("effective_date").isNull(), "date"))
    refusal = F.when(lacking != "", F.concat(F.lit("lacks "), lacking)).when(F.col("dated_class").isNull(), "no line names the class converted into")
    return placed.withColumn("refusal", refusal).withColumnRenamed("dated_class", "to_security_class")


def periods(labels: DataFrame, packet_periods: dict[str, tuple[str, ...]]) -> DataFrame:
    """MAP-04: period columns with their date and scope; a label that does not read as a date is refused."""
    fund = S.fund_key(F.col("sheet"))
    return labels.withColumn("period_date", S.period_end(F.col("label"))).withColumn("fund", fund).withColumn(
        "audit_scope", S.period_scope(F.col("fund"), F.col("label"), packet_periods)).withColumn(
        "refusal", F.when(F.col("period_date").isNull(), "label cannot be dated"))


def holdings(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MAP-05: holding rows, and beside them every value that was assumed rather than read."""
    rows = types.filter("refusal IS NULL").select(
        "sheet_no", "fund", S.company_key(F.col("title")).alias("company"), "position_type", F.lit(ASSUMED_CURRENCY).alias("currency"), "source_text")
    assumed = rows.select("fund", "company", F.lit("currency").alias("field"), F.col("currency").alias("value")).unionByName(
        rows.filter(F.col("source_text").startswith("no line names")).select("fund", "company", F.lit("position_type").alias("field"), F.col("position_type").alias("value")))
    return rows, assumed


def mark_rows(cells: DataFrame, held: DataFrame) -> DataFrame:
    """MAP-06: marks with the three-valued held flag at their date; text cells are refused and keep their text."""
    dated = cells.withColumn("measured", S.period_end(F.col("label"))).filter(F.col("measured").isNotNull() & F.col("cell").isNotNull())
    joined = dated.join(held.withColumnRenamed("company", "key"), ["fund", "key", "measured"], "left")
    return joined.withColumn("refusal", F.when(F.col("amount").isNull(), F.concat(F.lit("not a figure: "), "cell")))


def realised_dates(tranches: DataFrame) -> DataFrame:
    """MAP-08: a realised date only when one exit sells everything; otherwise which lot was sold is not ours to choose."""
    zero = F.lit(0).cast(S.NUMBER)
    out = tranches.groupBy("fund", "company").agg(
        F.count_if("is_exit").alias("exits"), F.coalesce(F.sum(F.when(F.col("is_exit"), F.col("share_count"))), zero).alias("sold"),
        F.coalesce(F.sum(F.when(F.col("is_investment"), F.col("share_count"))), zero).alias("bought"),
        F.max(F.when(F.col("is_exit"), F.col("acquired"))).alias("exit_day")).filter("exits > 0")
    forced = (F.col("exits") == 1) & (F.col("sold") >= F.col("bought")) & (F.col("bought") > 0) & F.col("exit_day").isNotNull()
    return out.select("fund", "company", F.when(forced, F.col("exit_day")).alias("realized_date"), F.when(~forced, "no allocation method is stated").alias("refusal"))


def acquisition_days(tranches: DataFrame, dates: DataFrame) -> DataFrame:
    """MAP-10: an imprecise date takes its first day unless a measurement date (``dates``: fund, period_end) falls inside the range."""
    dated = temporal.first_on_or_after(tranches, "fund", "lo", dates, "period_end", "_next")
    refusal = F.when(F.col("lo").isNull(), "the date cell names no date").when(F.col("acquired").isNull() & (F.col("_next") < F.col("hi")), "a measurement date falls inside the range")
    return dated.withColumn("date_refusal", refusal).withColumn("acquired_date", F.when(F.col("date_refusal").isNull(), F.coalesce("acquired", "lo"))).drop("_next")


def lots(tranches: DataFrame, classes: DataFrame, dates: DataFrame) -> DataFrame:
    """MAP-07: a lot per purchase with a usable date, numbered in sheet order within its position."""
    purchases = acquisition_days(tranches.filter("is_investment"), dates)
    numbered = order.numbered(purchases, ["fund", "company"], ["row_no", "sheet_no"])
    classed = numbered.join(classes.select("sheet_no", "row_no", "security_class"), ["sheet_no", "row_no"], "left")
    sold = realised_dates(tranches).select("fund", "company", "realized_date")
    return classed.join(sold, ["fund", "company"], "left").filter("acquired_date IS NOT NULL").select(
        "sheet_no", "fund", "company", "row_no", F.col("ordinal").alias("lot_no"), "security_class", F.col("share_count").alias("shares"),
        F.col("share_price").alias("entry_pps"), F.col("investment").alias("cost_amount"), "acquired_date", "realized_date")


def conversions(lot_rows: DataFrame, recaps: DataFrame) -> DataFrame:
    """MAP-09: a recorded recapitalisation converts the one share-bearing lot; with several lots none may be chosen."""
    bearing = lot_rows.filter("shares IS NOT NULL AND shares <> 0").groupBy("sheet_no").agg(F.count("*").alias("holders"), F.min("lot_no").alias("lot_no"), F.min("shares").alias("prior_shares"))
    joined = recaps.filter("refusal IS NULL").drop("refusal").join(bearing, "sheet_no", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    one = F.col("holders") == 1
    return joined.select(
        "sheet_no", F.when(one, F.col("lot_no")).alias("lot_no"), "effective_date", "to_security_class", F.col("shares").alias("to_shares"),
        F.when(one, F.col("shares").cast("decimal(18,0)") / F.col("prior_shares").cast("decimal(18,6)")).cast("decimal(18,8)").alias("exchange_ratio"),
        F.when(~one, F.concat(F.col("holders").cast("string"), F.lit(" share-bearing lots, no allocation stated"))).alias("refusal"))


def packet_lines(marks: DataFrame, holding_rows: DataFrame, period_rows: DataFrame) -> DataFrame:
    """MAP-11: marks of packet-scope periods that reach a holding; a mark that reaches none is refused, not dropped."""
    scoped = period_rows.filter("audit_scope = 'packet' AND refusal IS NULL").select("sheet", "label", "period_date")
    lines = marks.filter("refusal IS NULL").drop("refusal").join(scoped, ["sheet", "label"])
    known = holding_rows.select("fund", F.col("company").alias("key"), "position_type")
    joined = lines.join(known, ["fund", "key"], "left")
    return joined.withColumn("refusal", F.when(F.col("position_type").isNull(), "no holding was read for this company"))
