import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestor.operators import audits, citing, guard, order, packets, rules, temporal, totals
from attestor.sources import publish
from attestor.streaming import streams

DAY = datetime.date


def test_numbering_a_hot_key_equals_a_plain_row_number(spark):
    random.seed(3)
    rows = [("hot" if n % 3 else f"k{n % 7}", DAY(2000, 1, 1) + datetime.timedelta(days=random.randrange(900)), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, d date, id int")
    got = {(r["k"], r["id"]): r["ordinal"] for r in order.numbered(df, ["k"], ["d", "id"]).collect()}
    want, seen = {}, {}
    for k, _, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[(k, n)] = seen[k]
    assert got == want


def test_latest_candidates_equal_the_pairwise_rule(spark):
    random.seed(5)
    rows = []
    for n in range(400):
        lo = None if n % 17 == 0 else DAY(2000, 1, 1) + datetime.timedelta(days=random.randrange(2000))
        rows.append((f"p{n % 9 if n % 2 else 0}", n, lo, None if lo is None else lo + datetime.timedelta(days=random.choice([0, 30, 700]))))
    got = {(r["n"]): (r["candidate"], r["follows"]) for r in temporal.latest_candidates(spark.createDataFrame(rows, "p string, n int, lo date, hi date"), ["p"]).collect()}
    for p, n, lo, hi in rows:
        others = [r for r in rows if r[0] == p and r[1] != n]
        candidate = not any(o[2] is not None and hi is not None and o[2] > hi for o in others)
        follows = lo is not None and any(o[3] is not None and o[3] < lo for o in others)
        assert got[n] == (candidate, follows)


def test_an_unlisted_tuple_stops_a_strict_run_and_is_listed_by_the_audit(spark):
    claims = spark.createDataFrame([("R2", "rumor", "not_applicable", "direct_equity", None)], "requirement string, source_class string, execution_status string, position_type string, price_per_share decimal(18,6)")
    assert rules.unlisted_tuples(claims).count() == 1
    with pytest.raises(Exception, match="unlisted policy tuple"):
        rules.matrix_cells(claims, strict=True).collect()


def row(**verdicts):
    base = {"held": True, "r1": "not_applicable", "r2": "not_applicable", "r3": "not_applicable", "r4": "not_applicable", "r5": "not_applicable"}
    return {**base, **verdicts}


@pytest.mark.parametrize("given, verdict, reasons", [
    (row(r1="sufficient", r2="sufficient"), "sufficient", {}),
    (row(r1="sufficient", r2="conflicting"), "conflicting", {"R2": "conflicting"}),
    (row(r1="sufficient", r2="partial", r3="missing"), "missing", {"R2": "partial", "R3": "missing"}),
    (row(), "not_applicable", {"R1": "not_applicable", "R2": "not_applicable"}),
    (row(held=False), "not_applicable", {"R4": "not assessed"}),
    (row(held=False, r4="partial"), "partial", {"R4": "partial"}),
    (row(held=False, r1="sufficient", r4="sufficient"), "sufficient", {}),
])
def test_row_verdict_and_support(spark, given, verdict, reasons):
    got = rules.support(rules.row_verdict(spark.createDataFrame([given]))).head()
    assert got["row_verdict"] == verdict
    assert got["unsupported_reasons"] == reasons
    assert got["supported"] is (not reasons)


def test_a_total_over_two_currencies_is_no_total(spark):
    rows = [("f", True, Decimal("10"), "USD", True), ("f", True, Decimal("5"), "EUR", False), ("g", True, Decimal("7"), "USD", False), ("g", False, None, None, False)]
    df = spark.createDataFrame(rows, "fund string, held boolean, reported_amount decimal(24,4), reported_currency string, supported boolean")
    got = {r["fund"]: r for r in totals.held_totals(df, ["fund"]).collect()}
    assert got["f"]["amount"] is None and got["f"]["currencies"] == 2
    assert got["g"]["amount"] == Decimal("7") and got["g"]["unsupported_amount"] == Decimal("7")
    assert (got["g"]["unsupported_positions"], got["g"]["packet_gap_positions"], got["g"]["unheld_gap_positions"]) == (1, 2, 1)


@pytest.mark.parametrize("text, refusal", [
    (" ", "returned_nothing"), ("The finding is partial on 5 million.", "magnitude_not_in_record"), ("The finding is partial for 99.", "figure_not_in_record"),
    ("The finding is partial and a letter was sent.", "outstanding_step_told_as_done"), ("The finding is partial; nothing has been received.", None),
    ("A finding.", "verdict_not_named"), ("The finding is partial, not missing.", "another_verdict_named"), ("The finding is partial in 1999.", None)])
def test_restatements(spark, text, refusal):
    pair = spark.createDataFrame([(text, "verdict partial year 1999 count 5", "partial", True)], "restatement string, payload string, verdict string, outstanding boolean")
    assert guard.judge(pair).head()["refusal"] == refusal


def test_append_only_reports_changes_and_removals_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, v string")
    assert {(r["rule"], r["subject"]) for r in audits.rewritten(old, new, "id").collect()} == {("changed", "2"), ("removed", "3")}


def test_a_failed_run_leaves_the_old_version_readable(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    checks = {"no_row_twice": lambda t: audits.duplicates(t["t"], ["id"], "twice")}
    target = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no_row_twice"):
        publish.publish(spark, {"t": df}, checks, target)
    with pytest.raises(ValueError, match="nothing is published"):
        publish.published(spark, target)
    assert publish.publish(spark, {"t": df.distinct()}, checks, target) == 1
    with pytest.raises(ValueError, match="no_row_twice"):
        publish.publish(spark, {"t": df}, checks, target)
    assert publish.read_published(spark, target, "t", df.schema).count() == 1
    assert publish.publish(spark, {"t": df.distinct().union(spark.createDataFrame([(2,)], "id int"))}, checks, target) == 2
    assert publish.read_published(spark, target, "t", df.schema).count() == 2
    assert publish.read_published(spark, target, "t", df.schema, version=1).count() == 1
    # A second writer of version 2 with a greater token loses, whenever its record arrives.
    spark.createDataFrame([(2, "versions/other", ["t"], "g")], "version int, folder string, tables array<string>, token string").write.mode("append").parquet(f"{target}/commits")
    assert publish.read_published(spark, target, "t", df.schema).count() == 2


def test_digest_does_not_depend_on_order_or_partitions(spark):
    rows = [("k", n, f"v{n}") for n in range(200)]
    one = publish.table_digest(spark.createDataFrame(rows, "k string, n int, v string").coalesce(1), ["k"]).head()["digest"]
    two = publish.table_digest(spark.createDataFrame(rows[::-1], "k string, n int, v string").repartition(7), ["k"]).head()["digest"]
    other = publish.table_digest(spark.createDataFrame(rows[:-1] + [("k", 199, "changed")], "k string, n int, v string"), ["k"]).head()["digest"]
    assert one == two != other


def test_reading_order_puts_disagreements_first(spark):
    df = spark.createDataFrame([("pass",), ("fail",), ("unconfirmable",)], "o string")
    assert [r["o"] for r in df.orderBy(packets.reading_order(F.col("o"))).collect()] == ["fail", "unconfirmable", "pass"]


def test_the_digest_tells_apart_cells_that_read_alike_when_joined(spark):
    digest = lambda *row: publish.table_digest(spark.createDataFrame([("k", *row)], "k string, a string, b string"), ["k"]).head()["digest"]
    assert len({digest("a|b", "c"), digest("a", "b|c"), digest("~", "c"), digest(None, "c"), digest("", "c")}) == 5


def test_every_position_has_a_folder_of_its_own(spark):
    names = ["A", "A", "A (h2)", "a", "A (h2)", "..", "A/", "A (h9)", "A (UK)", "A (H3)", "x" * 300]
    rows = spark.createDataFrame([("f", f"h{n}", name) for n, name in enumerate(names, 1)], "f string, h string, name string")
    got = {r["h"]: r["directory"] for r in publish.path_plan(rows, ["f"], "name", "h").collect()}
    assert len({d.lower() for d in got.values()}) == len(names)
    assert got["h1"] == "companies/A" and got["h2"] == "companies/A (h2)" and got["h9"] == "companies/A (UK)"


def test_lineage_of_any_depth_and_a_cycle(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    leaves = spark.createDataFrame([("n40", "leaf", "approved")], "figure_id string, leaf_id string, state string")
    reached = citing.lineage(spark.createDataFrame(edges, "figure_id string, child_id string"), leaves)
    assert {r["figure_id"] for r in reached.collect()} == {f"n{i:02d}" for i in range(41)}
    with pytest.raises(ValueError, match="acyclic"):
        citing.lineage(spark.createDataFrame([*edges[:5], ("n05", "n02")], "figure_id string, child_id string"), leaves)


def test_a_quote_gives_one_claim_for_each_observation_it_states(spark):
    docs = spark.createDataFrame([("c", "quote", DAY(2005, 3, 1), None, None)], "claim_id string, family string, issued_date date, applicable_to date, price_per_share decimal(18,6)")
    seen = spark.createDataFrame([("c", DAY(2005, 12, 31), Decimal("2")), ("c", DAY(2014, 12, 31), Decimal("3"))], "claim_id string, observed_on date, price_per_share decimal(18,6)")
    none = spark.createDataFrame([], "claim_id string, field_name string, outcome string")
    assert sorted((r["closes"], r["price_per_share"]) for r in citing.claims_of_document(none, docs, seen).collect()) == [(DAY(2005, 12, 31), Decimal("2")), (DAY(2014, 12, 31), Decimal("3"))]


@pytest.mark.parametrize("text, label, problem", [
    ("\n\t  ", None, "returned_nothing"), ("It is out of date.", "out of date", None), ("It is out of date.", "", "verdict_not_named"), ("OUT OF DATE, not partial.", "out of date", "another_verdict_named")])
def test_a_verdict_is_named_by_its_label_too(spark, text, label, problem):
    pair = spark.createDataFrame([(text, "", "missing", False, label)], "restatement string, payload string, verdict string, outstanding boolean, verdict_label string")
    assert guard.judge(pair, label="verdict_label").head()["refusal"] == problem
