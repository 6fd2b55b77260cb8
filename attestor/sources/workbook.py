"""Position workbooks as frames: grids unpivoted, sheets given their fund, rows told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import order

# First words of rows that are no holding (fixed values); the name of the house that keeps the sheet comes on top.
NOT_A_HOLDING = ("Internal", "TOTAL", "Marks", "Case study", "Fund I positions")


def company_rows(grid: DataFrame, house: tuple[str, ...] = ()) -> DataFrame:
    """Rows that name a company; headings and totals are told by their first words."""
    heading = F.lit(False)
    for word in (*house, *NOT_A_HOLDING):
        heading = heading | F.col("company").startswith(word)
    return grid.filter(~heading)


def total_rows(grid: DataFrame) -> DataFrame:
    """SRC-03: the stated TOTAL row, kept apart and never used as truth."""
    return grid.filter(F.col("company").startswith("TOTAL"))


def unpivot_grid(grid: DataFrame) -> DataFrame:
    """SRC-02: one row per company and period column; the label belongs to its own column, text cells stay as notes."""
    periods = [c for c in grid.columns if c.startswith("p_")]
    long = grid.unpivot(["sheet", "company", "cost_cell"], periods, "label", "cell")
    amount = S.number_from_cell(F.col("cell"))
    return (
        long.withColumn("label", F.expr("substring(label, 3)")).withColumn("amount", amount)
        .withColumn("note", F.when(F.col("amount").isNull() & (F.col("cell") != ""), F.col("cell")))
    )


def sheet_funds(sheets: DataFrame, workbook: str | None = None) -> DataFrame:
    """SRC-04: a divider title ends with >> and gives its fund to every sheet up to the next divider of its workbook.

    Sheets and dividers are one sequence, in which the last divider is carried on; without a ``workbook`` column all sheets
    are of one workbook.
    """
    key = workbook or "_workbook"
    told = sheets.select(*([workbook] if workbook else [F.lit(0).alias(key)]), "sheet_no", "title")
    is_divider = F.rtrim("title").endswith(">>")
    marked = told.withColumn("_divider", F.when(is_divider, F.trim(F.regexp_replace(F.rtrim("title"), ">>$", ""))))
    carried = order.carried(marked, [key], ["sheet_no"], "_divider", "fund").filter("_divider IS NULL")
    return carried.select(*([workbook] if workbook else []), "sheet_no", "title", "fund")


def tranches(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """SRC-05: rows whose kind is text and whose investment is a figure, typed."""
    return (
        rows.filter(F.col("c0").isNotNull()).withColumn("investment", S.number_from_cell(F.col("c1"))).filter("investment IS NOT NULL")
        .join(sheets.select("sheet_no", F.col("fund").alias("fund_text")), "sheet_no")
        .select(
            "sheet_no", "title", "row_no", S.fund_key(F.col("fund_text")).alias("fund"), S.company_key(F.col("title")).alias("company"),
            F.col("c0").alias("kind"), "investment", F.col("c2").alias("entry_valuation"),
            S.number_from_cell(F.col("c3")).alias("share_price"), S.number_from_cell(F.col("c4")).alias("share_count"),
            S.exact_day(F.col("c5")).alias("acquired"), F.col("c5").alias("acquired_text"), S.day_range(F.col("c5")).alias("range"),
            S.is_exit(F.col("c0")).alias("is_exit"), S.is_investment(F.col("c0")).alias("is_investment"))
        .select("*", "range.lo", "range.hi").drop("range")
    )


def notes(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """SRC-06: the complement: rows with text and no investment figure, cells kept as they are."""
    prose = rows.filter(F.col("c0").isNotNull() & (F.trim("c0") != "") & S.number_from_cell(F.col("c1")).isNull())
    return prose.join(sheets.select("sheet_no", F.col("fund").alias("fund_text")), "sheet_no").select(
        "sheet_no", S.company_key(F.col("title")).alias("company"), S.fund_key(F.col("fund_text")).alias("fund"),
        F.trim("c0").alias("text"), F.col("title").alias("source_sheet"), F.col("row_no").alias("ordinal"),
        F.array("c0", "c1", "c2", "c3", "c4", "c5").alias("cells"))
