import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestor.functions import scalars as S


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize("text, number", [
    ("1,234.50", "1234.50"), ("$1,234", "1234"), ("(5)", "-5"), ("-7", "-7"), ("12%", "12"), (" ( $ 5 ) ", "-5"), ("0", "0"),
    ("007", None), ("1,23", None), ("1.234,5", None), ("1e5", None), ("12 34", None), ("", None), (" 5", None), ("1,234,567", "1234567")])
def test_the_numeral_a_text_states(spark, text, number):
    got = one(spark, text, S.cited_numeral)
    assert got == (None if number is None else Decimal(number))


@pytest.mark.parametrize("quote, value, hits", [
    ("paid 120 at close", "120", 1), ("of 1200 shares", "120", 0), ("120 and 120", "120", 2), ("-120 net", "120", 0), ("120.5", "120", 0),
    ("120e5", "120", 0), ("120 each", "120", 1), ("1,120", "120", 0), ("", "120", 0), ("a\\E 120", "120", 1), ("x", "", 0)])
def test_a_value_counts_only_as_a_whole_figure(spark, quote, value, hits):
    row = spark.createDataFrame([(quote, value)], "q string, v string").select(S.value_token_occurrences(F.col("q"), F.col("v")).alias("n")).head()
    assert row["n"] == hits


@pytest.mark.parametrize("cell, lo, hi", [
    ("10/10/2024", "2024-10-10", "2024-10-10"), ("7/2020", "2020-07-01", "2020-07-31"), ("2020 / 2021 / 2023", "2020-01-01", "2023-12-31"),
    ("2/30/2021", "2021-01-01", "2021-12-31"), ("soon", None, None)])
def test_a_date_cell_is_a_range_of_days(spark, cell, lo, hi):
    got = one(spark, cell, S.day_range)
    day = lambda t: None if t is None else datetime.date.fromisoformat(t)
    assert (got["lo"], got["hi"]) == (day(lo), day(hi))


@pytest.mark.parametrize("label, end", [("FY2024", "2024-12-31"), ("25Q4", "2025-12-31"), ("24q1", "2024-03-31"), ("25Q5", None), ("Q4 25", None)])
def test_period_labels(spark, label, end):
    got = one(spark, label, S.period_end)
    assert got == (None if end is None else datetime.date.fromisoformat(end))


@pytest.mark.parametrize("label, fund", [
    ("fund ii", "Fund II"), ("Fund I / Fund II Combined", "Fund I / Fund II Combined"), ("Fund I's side", "Fund I's side"), (" Fund 3 ", "Fund 3"), ("", None)])
def test_two_funds_in_one_label_stay_as_written(spark, label, fund):
    assert one(spark, label, S.fund_key) == fund


@pytest.mark.parametrize("gap, reference, material", [("0", "5", False), ("1000", "5000000", True), ("999.99", "5000000", False), ("0.5", "500", True), ("0.4999", "500", False), ("1", "0", True)])
def test_materiality_is_the_smaller_of_share_and_amount(spark, gap, reference, material):
    df = spark.createDataFrame([(Decimal(gap), Decimal(reference))], "g decimal(24,4), r decimal(24,4)")
    assert df.select(S.is_material(F.col("g"), F.col("r")).alias("m")).head()["m"] is material


def test_a_finer_amount_is_refused_not_rounded(spark):
    df = spark.createDataFrame([(Decimal("1.020000"),), (Decimal("1.100000"),)], "x decimal(18,6)")
    assert [r["ok"] for r in df.select(S.fits_scale(F.col("x"), 1).alias("ok")).collect()] == [False, True]


@pytest.mark.parametrize("value, stated, unit, ok", [("250", "200", "100", True), ("350", "400", "100", True), ("250", "300", "100", False), ("1", "1", "0", False)])
def test_rounding_is_half_even_to_a_stated_unit(spark, value, stated, unit, ok):
    df = spark.createDataFrame([(Decimal(value), Decimal(stated), Decimal(unit))], "v decimal(18,2), s decimal(18,2), u decimal(10,2)")
    assert df.select(S.rounds_to(F.col("v"), F.col("s"), F.col("u")).alias("y")).head()["y"] is ok


@pytest.mark.parametrize("text, number", [
    ("0.1234567", None), ("0.1234560", "0.123456"), ("(0.1234567)", None), ("1e3", "1000"), ("1e-7", None), ("1,234.5", "1234.5"), ("12345678901234567890123456789012", None)])
def test_a_figure_finer_than_can_be_kept_is_refused(spark, text, number):
    got = one(spark, text, S.number_from_cell)
    assert got == (None if number is None else Decimal(number))
    if "e" not in text:
        assert one(spark, text, S.cited_numeral) == got


def test_a_fractional_count_keeps_its_fraction(spark):
    got = spark.createDataFrame([(Decimal("2.00"), Decimal("100.5"))], "p decimal(18,6), n decimal(18,6)").select(S.implied_cost(F.col("p"), F.col("n")).alias("y")).head()["y"]
    assert got == Decimal("201")
