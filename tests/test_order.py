"""Running sums, numbers, carried values and interval events against plain loops."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from attestor.operators import citing, joins, mapping, order, temporal
from attestor.sources import workbook

DAY = datetime.date


def plain_running(rows):
    out, sums = {}, {}
    for key, day, name, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        out[name] = sums.get(key, 0)
        sums[key] = out[name] + (value or 0)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums_of_hot_null_and_equal_keys(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, 1, 2, 2, 2, 3]), f"r{n:05d}", rng.choice([None, 0, 1, 5])) for n in range(3_000)]
    df = spark.createDataFrame(rows, "k string, d int, name string, v int").repartition(partitions)
    got = {r["name"]: r["before"] for r in order.running(df, ["k"], ["d", "name"], "v").collect()}
    assert got == plain_running(rows)
    numbers = {r["name"]: r["ordinal"] for r in order.numbered(df, ["k"], ["d", "name"]).collect()}
    assert numbers == {k: v + 1 for k, v in plain_running([(k, d, n, 1) for k, d, n, _ in rows]).items()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, d int")
    assert order.numbered(df, ["k"], ["d"]).collect() == []
    assert order.carried(df.withColumn("v", F.lit("x")), ["k"], ["d"], "v", "c").collect() == []


def test_a_hot_key_of_equal_days_lies_in_many_ranges(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise("hot").alias("k"), F.lit(DAY(2000, 1, 1)).alias("d"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in order.ranges(df, ["k"], ["d", "id"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 16 and max(sizes) < 2 * statistics.median(sizes)


def test_the_last_divider_is_carried_over_range_borders_and_not_into_another_workbook(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for book in ("a", "b"):
        fund = None
        for n in range(1_500):
            if rng.random() < 0.01 and n > 5:
                fund = f"Fund {n}"
                rows.append((book, n, f" {fund} >> "))
            else:
                rows.append((book, n, f"Company {n}"))
                want[book, n] = fund
    df = spark.createDataFrame(rows, "workbook string, sheet_no int, title string").repartition(5)
    assert {(r["workbook"], r["sheet_no"]): r["fund"] for r in workbook.sheet_funds(df, "workbook").collect()} == want
    one = {r["sheet_no"]: r["fund"] for r in workbook.sheet_funds(df.filter("workbook = 'a'").drop("workbook")).collect()}
    assert one == {n: f for (book, n), f in want.items() if book == "a"}


def days(rng):
    lo = DAY(1999, 1, 1) + datetime.timedelta(rng.randrange(900))
    return rng.choice([(lo, lo), (lo, lo + datetime.timedelta(rng.randrange(200))), (None, None)])


def plain_held(rows, on):
    by = [(None if lo is None else True if hi <= on else False if lo > on else None, out, shares) for lo, hi, out, shares in rows]
    if any(b is None for b, out, _ in by if out):
        return None
    if not any(b for b, out, _ in by if not out):
        return None if any(b is None for b, out, _ in by if not out) else False
    if not any(b for b, out, _ in by if out):
        return True
    if any(b and shares is None for b, _, shares in by):
        return None
    return sum(s for b, out, s in by if b and out) < sum(s for b, out, s in by if b and not out)


def test_held_at_dates_by_running_sums(spark):
    rng = random.Random(3)
    positions = {f"p{n}": [(*days(rng), rng.random() < 0.3, rng.choice([None, 10, 20, 20])) for _ in range(rng.randrange(1, 7))] for n in range(120)}
    rows = [("f", p, out, None if s is None else s, lo, hi) for p, own in positions.items() for lo, hi, out, s in own]
    df = spark.createDataFrame(rows, "fund string, company string, is_exit boolean, share_count int, lo date, hi date").withColumn("share_count", F.col("share_count").cast("decimal(18,6)"))
    asked = [DAY(1999, 6, 30), DAY(1999, 12, 31), DAY(2000, 12, 31), DAY(2002, 1, 1), DAY(1990, 1, 1)]
    dates = spark.createDataFrame([("f", d) for d in asked] + [("other", asked[0])], "fund string, on date")
    figures = joins.running_at(df, ["fund", "company"], dates, "on")
    assert "CartesianProduct" not in figures._jdf.queryExecution().toString() and "NestedLoop" not in figures._jdf.queryExecution().toString()
    got = {(r["company"], r["on"]): r["held"] for r in joins.position_held(figures, ["company", "on"]).collect()}
    assert got == {(p, on): plain_held(own, on) for p, own in positions.items() for on in asked}
    counts = {r["on"]: (r["yes"], r["no"], r["unknown"]) for r in joins.known_by(df, dates.filter("fund = 'f'"), "on").collect()}
    for on in asked:
        by = [None if lo is None else True if hi <= on else False if lo > on else None for _, _, _, _, lo, hi in rows]
        assert counts[on] == (by.count(True), by.count(False), by.count(None))


def test_the_first_measurement_date_of_a_range(spark):
    rows = spark.createDataFrame([("f", DAY(2000, 3, 1), 1), ("f", DAY(2000, 12, 31), 2), ("f", DAY(2002, 1, 1), 3), ("g", DAY(2000, 3, 1), 4), ("f", None, 5)], "fund string, lo date, n int")
    dates = spark.createDataFrame([("f", DAY(2000, 12, 31)), ("f", DAY(2001, 12, 31)), ("g", DAY(2001, 6, 30))], "fund string, d date")
    got = {r["n"]: r["next"] for r in temporal.first_on_or_after(rows, "fund", "lo", dates, "d", "next").collect()}
    assert got == {1: DAY(2000, 12, 31), 2: DAY(2000, 12, 31), 3: None, 4: DAY(2001, 6, 30), 5: None}


def test_a_measurement_date_inside_a_range_refuses_its_day(spark):
    rows = spark.createDataFrame([(1, "f", DAY(2000, 3, 1), DAY(2000, 3, 31), None), (2, "f", DAY(2000, 1, 1), DAY(2001, 1, 1), None), (3, "f", DAY(2000, 12, 31), DAY(2000, 12, 31), DAY(2000, 12, 31)), (4, "f", None, None, None)],
                                 "n int, fund string, lo date, hi date, acquired date")
    dates = spark.createDataFrame([("f", DAY(2000, 12, 31))], "fund string, period_end date")
    got = {r["n"]: (r["acquired_date"], r["date_refusal"]) for r in mapping.acquisition_days(rows, dates).collect()}
    assert got == {1: (DAY(2000, 3, 1), None), 2: (None, "a measurement date falls inside the range"), 3: (DAY(2000, 12, 31), None), 4: (None, "the date cell names no date")}


EDGE, LEAF = "figure_id string, child_id string", "figure_id string, leaf_id string, state string"


def test_lineage_of_a_thousand_levels_takes_ten_rounds(spark, monkeypatch):
    rounds = []
    real = citing.cut_lineage
    monkeypatch.setattr(citing, "cut_lineage", lambda df: rounds.append(1) or real(df))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(1_000)], EDGE)
    got = citing.lineage(edges, spark.createDataFrame([("n1000", "leaf", "approved"), ("n999", "other", "approved")], LEAF))
    assert got.groupBy("leaf_id").count().orderBy("leaf_id").collect() == [("leaf", 1_001), ("other", 1_000)]
    # A cut for the edges, and two a round.
    assert len(rounds) <= 1 + 2 * 10


def test_lineage_against_a_walk(spark):
    rng = random.Random(4)
    edges = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b}
    leaves = [(f"n{rng.randrange(60)}", f"l{n}", "candidate") for n in range(40)]
    children = {}
    for a, b in edges:
        children.setdefault(a, set()).add(b)

    def below(node):
        return {node}.union(*(below(c) for c in children.get(node, ())))

    want = {(f"n{n}", leaf) for n in range(60) for node, leaf, _ in leaves if node in below(f"n{n}")}
    got = {(r["figure_id"], r["leaf_id"]) for r in citing.lineage(spark.createDataFrame(sorted(edges), EDGE), spark.createDataFrame(leaves, LEAF)).collect()}
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_a_cycle_of_any_length_is_refused(spark, size):
    edges = [("top", "n0")] + [(f"n{i}", f"n{(i + 1) % size}") for i in range(size)]
    with pytest.raises(ValueError, match="acyclic"):
        citing.lineage(spark.createDataFrame(edges, EDGE), spark.createDataFrame([("n0", "leaf", "approved")], LEAF))
