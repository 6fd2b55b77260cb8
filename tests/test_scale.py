"""Steps whose work must grow no faster than their rows: what meets what, and what is written, told from plans and stored frames."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from attestor.operators import citing, coverage, packets, retrieval, rules, temporal
from attestor.sources import derived, publish
from attestor.streaming import streams
from catalogue import movement
from tests.test_texts import sentences

DAY = datetime.date
CLAIM = ("claim_id string, fund_id string, holding_id string, supersedes_claim_id string, applicable_from date, applicable_to date, issued_date date, received_date date, requirements array<string>, "
         "source_class string, execution_status string, position_type string, price_per_share decimal(18,6), priced_class string, document_no bigint")
PERIODS = [("f_1", "f", DAY(2000, 12, 31), "packet", "a"), ("f_2", "f", DAY(2001, 12, 31), "packet", "b"), ("f_3", "f", DAY(2002, 12, 31), "packet", "c")]


def claim(key, names=None, lo=DAY(2000, 1, 1), hi=None, requirements=("R2",), holding="h"):
    return (key, "f", holding, names, lo, hi, lo, None, list(requirements), "administrator_statement", "not_applicable", "indirect_feeder", None, None, 1)


class Held:
    """As much of a ledger as these steps read."""

    def __init__(self, **frames):
        self.__dict__.update(frames)

    @property
    def packet_period(self):
        return self.period.filter("audit_scope = 'packet'")


def ledger(spark, claims, **more):
    period = spark.createDataFrame(PERIODS, "period_id string, fund_id string, period_date date, audit_scope string, label string")
    return Held(claim=spark.createDataFrame(claims, CLAIM), period=period, **more)


CLAIMS = [claim("a"), claim("b", "a", DAY(2001, 6, 1), DAY(2002, 6, 1)), claim("c", "a", DAY(2001, 7, 1), DAY(2001, 12, 31)), claim("d", "b", DAY(2002, 1, 1)), claim("e", "none"),
          claim("a"), claim(None), claim("g", "e", DAY(2000, 1, 1), requirements=("R1",)), claim("h", None, DAY(2000, 1, 1), requirements=("R1", "R2"))]


def test_superseded_claims_are_struck_out_before_dates_multiply_them(spark):
    run = rules.Assessment(ledger(spark, CLAIMS))
    mine = run.ledger.claim.filter("array_contains(requirements, 'R2')").withColumn("requirement", F.lit("R2"))
    want = rules.supersede(run._dated(mine, "R2")).select("claim_id", "period_id").collect()
    got = run.relied_for("R2").select("claim_id", "period_id").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) < run._dated(mine, "R2").count()


def test_claims_are_stored_with_the_columns_that_requests_read(spark):
    stored = {}
    wide = ledger(spark, CLAIMS)
    wide.claim = wide.claim.withColumn("scan", F.lit("x" * 100)).withColumn("order_key", F.lit(7))
    run = rules.Assessment(wide, store=lambda df, name: stored.setdefault(name, df))
    keys = ["requirement", "claim_id", "period_id", "verdict"]
    assert sorted(map(repr, run.relied.select(keys).collect())) == sorted(map(repr, rules.Assessment(ledger(spark, CLAIMS)).relied.select(keys).collect()))
    assert set(stored["claims_R2"].columns) == {*rules.CLAIM, "struck"}


def test_differing_prices_and_settled_ones_are_told_in_one_pass(spark):
    """a settled clash is still a difference, so no second assessment is needed to find it."""
    lots = [("l", "h", "a", 1, 1, 1, DAY(1999, 1, 1), None, "f", "direct_equity", None, None, None)]
    classes = [("h", p, c, 2, 3, 0, 0, low, high, None, None, False) for p, c, low, high in
               [("f_1", "a", 1, 2), ("f_2", "a", 1, 2), ("f_2", "b", 1, 2), ("f_3", "a", 1, 1), ("f_3", None, 1, 2)]]
    settled = spark.createDataFrame([("h", "a"), ("h", "a")], "holding_id string, priced_class string")
    run = rules.Assessment(ledger(spark, CLAIMS), resolutions=settled)
    run._kept["lots"] = spark.createDataFrame(lots, "lot_id string, holding_id string, security_class string, shares int, entry_pps int, cost_amount int, acquired_date date, "
                                              "realized_date date, fund_id string, position_type string, effective_date date, to_security_class string, to_shares int")
    run._kept["classes_R2"] = spark.createDataFrame(classes, "holding_id string, period_id string, priced_class string, claims int, best int, reasons bigint, actions bigint, "
                                                    "low_price int, high_price int, last_pro_forma date, last_executed date, subsequent boolean")
    got = {r.period_id: (r.differing, r.contradicted) for r in run.r2_evidence.collect()}
    assert got == {"f_1": (True, False), "f_2": (True, True), "f_3": (False, False)}


LOT = ("lot_id string, holding_id string, security_class string, shares int, entry_pps int, cost_amount int, acquired_date date, realized_date date, fund_id string, position_type string, "
       "effective_date date, to_security_class string, to_shares int")
CLASSES = ("holding_id string, period_id string, priced_class string, claims int, best int, reasons bigint, actions bigint, low_price int, high_price int, last_pro_forma date, last_executed date, "
           "subsequent boolean")


def test_held_and_priced_classes_are_moved_once_and_nulls_never_meet(spark):
    """F12 to F15: both sides go to their holding-date in one exchange each, instead of once to their class and once more to the date."""
    run = rules.Assessment(ledger(spark, CLAIMS))
    run._kept["lots"] = spark.createDataFrame([(f"l{n}", h, c, 1, 1, 1, day, None, "f", "direct_equity", None, None, None) for n, (h, c, day) in enumerate(
        [("h", "a", DAY(1999, 1, 1)), ("h", "a", DAY(1999, 1, 1)), ("h", None, DAY(2001, 6, 1)), ("i", None, DAY(2002, 6, 1)), (None, "a", DAY(2002, 6, 1))])], LOT)
    run._kept["classes_R2"] = spark.createDataFrame([(h, p, c, 2, best, 1 << best, 0, 1, 1, None, None, False) for h, p, c, best in
                                                     [("h", "f_1", "a", 1), ("h", "f_1", "b", 3), ("h", "f_2", None, 2), ("i", "f_3", None, 1), ("j", "f_3", "a", 1), (None, "f_3", "a", 1)]], CLASSES)
    out = run.r2_evidence
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    names = ["relied", "best_all", "best_on", "any_off", "any_bare", "any_class", "class_free"]
    got = {(r.holding_id, r.period_id): tuple(r[n] for n in names) for r in out.collect()}
    assert got == {
        ("h", "f_1"): (4, 3, 1, True, False, True, False), ("h", "f_2"): (2, 2, 2, False, True, False, True), ("h", "f_3"): (0, None, None, False, True, False, False),
        ("i", "f_3"): (2, 1, 1, False, True, False, True), (None, "f_3"): (2, 1, None, True, True, True, False)}


def test_figures_of_both_requests_are_told_in_one_pass_over_the_facts(spark):
    """F12 to F15: R1 and R4 read one stored frame, a row a claim; a positive figure only counts for R1."""
    stored = {}

    def store(df, name):
        stored[name] = df.count()
        return df

    facts = spark.createDataFrame([("g", "fund_shares", 0), ("g", "fund_price_per_share", 2), ("k", "gross_consideration", 0), ("k", "fund_shares", 5), ("a", "fund_shares", 1)],
                                  "claim_id string, field_name string, value_numeric int")
    run = rules.Assessment(ledger(spark, [*CLAIMS, claim("k", requirements=("R4",)), claim("k", requirements=("R1", "R4"))], fact=facts), store=store, strict=False)
    one, four = (run.by_class(code).filter("period_id = 'f_1'").first() for code in ("R1", "R4"))
    assert (one.claims, one.has_NO_SHARE_COUNT_STATED, one.has_NO_ACQUISITION_PRICE_STATED) == (3, True, True) and not one.has_SETTLEMENT_OF_FUNDS_NOT_EVIDENCED
    assert (four.claims, four.has_NO_PROCEEDS_STATED, four.has_NO_REALIZED_SHARE_COUNT_STATED) == (2, True, False)
    assert stored["claims_figures"] == 4 and [n for n in stored if n.startswith("claims")] == ["claims_figures"]


def test_frames_that_rename_columns_are_not_written_again(spark, tmp_path):
    """F12 to F15: texts are read where they lie."""
    spark.range(3).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    documents = derived.DerivedFrames(spark, str(tmp_path))["f_document"]
    assert documents.count() == 3 and all("documents.parquet" in f for f in documents.inputFiles())


def test_claims_are_stored_a_row_each_and_never_a_row_a_date(spark):
    stored = {}

    def store(df, name):
        stored[name] = df.count()
        return df

    run = rules.Assessment(ledger(spark, CLAIMS), store=store)
    assert run.relied.count() > len(CLAIMS)
    assert all(rows <= len(CLAIMS) for rows in stored.values())


def test_a_tuple_without_a_rule_stops_readers_that_do_not_ask_for_the_verdict(spark):
    odd = ledger(spark, [(*claim("x")[:9], "rumor", *claim("x")[10:])])
    with pytest.raises(Exception, match="unlisted policy tuple"):
        rules.Assessment(odd).relied.select("claim_id").collect()


def test_lots_are_stored_a_row_each(spark):
    stored = {}

    def store(df, name):
        stored[name] = df.count()
        return df

    lots = spark.createDataFrame([("l1", "h", "a", DAY(1999, 1, 1)), ("l2", "h", "a", DAY(2001, 1, 1))], "lot_id string, holding_id string, security_class string, acquired_date date").selectExpr(
        "*", "CAST(1 AS DECIMAL(18,0)) AS shares", "CAST(1 AS DECIMAL(18,6)) AS entry_pps", "CAST(1 AS DECIMAL(24,4)) AS cost_amount", "CAST(NULL AS DATE) AS realized_date")
    conversions = spark.createDataFrame([("l1", DAY(2001, 6, 1), "z", None)], "lot_id string, effective_date date, to_security_class string, to_shares decimal(18,0)")
    holdings = spark.createDataFrame([("h", "f", "direct_equity")], "holding_id string, fund_id string, position_type string")
    run = rules.Assessment(ledger(spark, [], lot=lots, conversion=conversions, holding=holdings), store=store)
    want = temporal.dated_lots(lots, conversions, holdings, run.periods)
    assert run.lots.exceptAll(want).isEmpty() and run.lots.count() == want.count() == 5 and stored == {"lots": 2}


def test_cases_meet_only_claims_whose_documents_were_found(spark):
    """With nothing broadcast, the rows dealt by document are claims: the requests of the documents found come to them, not the cases."""
    claims = [claim(f"c{n}", None, DAY(1999 + n % 4, 1, 1), DAY(2001, 12, 31) if n % 3 else None, ("R1", "R2"), f"h{n % 2}")[:-1] + (n % 5,) for n in range(12)]
    found = spark.createDataFrame([(d, f"d{d}", r, d * 0.5) for d in range(4) for r in ("R1", "R2")], "document_no bigint, document_id string, requirement string, rank double").selectExpr(
        "document_no", "document_id", "requirement", "CAST(rank AS DECIMAL(18,6)) AS text_rank")
    held = ledger(spark, claims)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for window in (True, False):
            top = retrieval.ranked(held, found, apply_window=window, k=3)
            assert not re.search(r"hashpartitioning\(document_no#\d+L?, requirement", top._jdf.queryExecution().executedPlan().toString())
            got = {(r["holding_id"], r["requirement"], r["period_id"], r["place"]): r["claim_id"] for r in top.collect()}
            want = {}
            for h in ("h0", "h1"):
                for r in ("R1", "R2"):
                    for p, _, day, _, _ in PERIODS:
                        covered = [c for c in claims if c[2] == h and c[4] <= day and (c[5] is None or c[5] >= day)]
                        if covered:
                            mine = [c for c in (covered if window else [c for c in claims if c[2] == h]) if c[-1] < 4]
                            mine.sort(key=lambda c: (abs((day - c[6]).days), -c[-1] * 0.5, f"d{c[-1]}", c[0]))
                            want |= {(h, r, p, n + 1): c[0] for n, c in enumerate(mine[:3])}
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_fragment_of_whole_words_is_indexed_by_words(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(citing, "cut_lineage", lambda df: kept.append(df) or df)
    text = "One two three four five six seven eight nine ten eleven twelve."
    fragments = spark.createDataFrame([(1, "wo three four five si"), (2, "two  three four five six")], "fragment_id int, fragment string")
    rows = {r["fragment_id"]: r["sentence"] for r in citing.sentence_for_fragment(fragments, sentences(spark, [text, text])).collect()}
    assert rows == {1: text, 2: None} and [df.count() for df in kept] == [1]


@pytest.mark.parametrize("twice", [False, True])
def test_facts_of_claims_equal_their_statement(spark, twice):
    """Claims that stand once need no join with themselves; where an id stands twice the stated join holds."""
    frames = derived.DerivedFrames(spark, "/root/testdata/sf0.001")
    some = frames["f_claim"].filter("order_key % 7 = 0")
    some = some.unionByName(some.filter("order_key % 2 = 0")) if twice else some
    mine = derived.DerivedFrames(spark, "/root/testdata/sf0.001")
    mine._built["f_claim"] = some
    got = mine._derive("f_fact")
    stated = derived.DerivedFrames(spark, "/root/testdata/sf0.001", stage=False)
    stated._built["f_claim"] = some
    want = stated["f_fact"]
    assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and got.count() == want.count() > 0
    assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == twice


def test_facts_meet_packets_after_all_joins(spark):
    claims = [claim("a", holding="h1"), claim("b", holding="h1", requirements=()), claim("c", holding="h2")]
    facts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "claim_id string, field_name string").selectExpr(
        "*", "'1' AS value_text", "CAST(1 AS DECIMAL(26,6)) AS value_numeric", "'approved' AS state", "0 AS span_start", "1 AS span_end", "'q' AS quote")
    documents = spark.createDataFrame([(1, "d1", "f1")], "document_no bigint, document_id string, filename string")

    class Run(rules.Assessment):
        members = property(lambda self: spark.createDataFrame([("h1", "f_1", "f"), ("h1", "f_2", "f"), ("h2", "f_2", "f")], "holding_id string, period_id string, fund_id string"))
        lots = property(lambda self: spark.createDataFrame([("h1", "f_1", "f", DAY(2000, 12, 31), "a", True, DAY(1999, 1, 1), None, None)], (
            "holding_id string, period_id string, fund_id string, period_date date, held_class string, held boolean, acquired_date date, realized_date date, previous_date date")))

    run = Run(ledger(spark, claims, fact=facts, document=documents))
    index = packets.evidence_index(run)
    got = sorted((r["period_id"], r["claim_id"], r["field_name"], r["relied_on"], r["filename"], r["fund_id"]) for r in index.collect())
    assert got == sorted((p, c, f, "R2" if (c, p) == ("a", "f_1") else "not relied on", "f1", "f")
                         for c, f, ps in (("a", "x", ("f_1", "f_2")), ("a", "y", ("f_1", "f_2")), ("b", "x", ("f_1", "f_2")), ("c", "x", ("f_2",))) for p in ps)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_packets") < plan.index("Join ")


def test_limbs_are_told_apart_by_words_that_are_said(spark):
    heads = spark.createDataFrame([("a", "s", None, 1), ("b", "s", None, 1), ("c", "t", None, 1)], "limb string, scope string, branch string, dimensions int")
    values = spark.createDataFrame([("a", "class", "x"), ("a", "class", "unsaid"), ("b", "class", "x"), ("c", "class", "x")], "limb string, dimension string, value string")
    said = spark.createDataFrame([("class", "x"), ("class", "x")], "dimension string, value string")
    assert coverage.indistinguishable(heads, values).collect() == []
    assert [(r["scope"], r["limbs"]) for r in coverage.indistinguishable(heads, values, said).collect()] == [("s", ["a", "b"])]


def test_a_batch_of_changes_writes_the_frames_its_prints_share(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(streams, "of_holdings", lambda now, holdings: now)
    monkeypatch.setattr(packets, "approval_fingerprints", lambda run, policy: seen.append(run.store) or spark.createDataFrame([], "holding_id string, period_id string, fingerprint string"))
    approvals = spark.createDataFrame([(1, "h", "f_1", "x")], "decision_id bigint, holding_id string, period_id string, recorded string")
    streams.reprint(None, approvals, spark.createDataFrame([("h", None)], "holding_id string, period_id string"), "p").collect()
    assert seen == [publish.staged_copy]


def test_folders_are_put_in_place_by_their_tasks(spark):
    members = spark.createDataFrame([("h1", "a"), ("h2", "b")], "holding_id string, folder string")
    path = publish.evidence_folders(members, spark.createDataFrame([("h1", "d1")], "holding_id string, document_id string"), "placed", slices=1)
    got = spark.read.schema("holding_id string, document_id string, note string, folder string").parquet(path)
    assert {(r["folder"], r["document_id"], r["note"] is None) for r in got.collect()} == {("a", "d1", True), ("b", None, False)}


def test_words_of_a_sentence_are_told_once_and_not_once_a_run(spark, monkeypatch):
    """a run is hashed from a column of words; splitting the sentence inside the loop over its runs is quadratic in its length."""
    kept = []
    monkeypatch.setattr(citing, "cut_lineage", lambda df: kept.append(df) or df)
    fragments = spark.createDataFrame([(1, "b c d e f")], "fragment_id int, fragment string")
    citing.sentence_for_fragment(fragments, sentences(spark, ["A b c d e f."]))
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    loops = [line[at:] for line in plan.splitlines() for at in [line.find("lambdafunction(")] if at >= 0]
    assert loops and not any("split(" in loop for loop in loops)


def test_fragments_that_many_ids_share_are_looked_for_once(spark):
    """ids of one fragment share its sentences; an id of several fragments has the sentences of all of them."""
    rows = [(1, "b c d e f"), (2, "b c d e f"), (2, "b c d e f"), (3, "b c d e f"), (3, "q r s t u"), (4, "zz"), (None, "b c d e f"), (5, None)]
    frame = citing.sentence_for_fragment(spark.createDataFrame(rows, "fragment_id int, fragment string"), sentences(spark, ["A b c d e f.", "P q r s t u v.", "A b c d e f."]))
    one = ("A b c d e f.", 1)
    assert sorted(((r["fragment_id"] or 0, r["sentence"], r["sentences"]) for r in frame.collect()), key=repr) == sorted(
        [(1, *one), (2, *one), (2, *one), (3, None, 2), (3, None, 2), (4, None, 0), (0, None, 0), (5, None, 0)], key=repr)


def test_folders_of_a_mounted_store_are_read_from_the_files_that_tasks_list(spark):
    """names as Spark's partition folders spell them, a folder of several positions, one of many batches, and rows without a folder."""
    odd = 'fund_1/a b:c%="[x]^\x07é'
    many = [(f"d{n}", None) for n in range(25_000)]
    members = spark.createDataFrame([("h1", odd), ("h2", odd), ("h3", "plain"), ("h4", None), ("h5", ""), ("h6", "last")], "holding_id string, folder string")
    documents = spark.createDataFrame([("h1", "d1"), ("h3", "d2"), ("h3", None), *[("h6", d) for d, _ in many]], "holding_id string, document_id string")
    path = publish.evidence_folders(members, documents, "listed", slices=3)
    schema = "holding_id string, document_id string, note string, folder string"
    listed, found = publish.read_folders(spark, path, schema), spark.read.schema(schema).parquet(path)
    files = spark.read.parquet(f"{path}/_files")
    assert files.select("file").distinct().count() == files.count() <= 3 * 5 and files.filter("folder = 'last'").count() > 1
    assert listed.exceptAll(found).isEmpty() and listed.count() == found.count() == 25_006
    assert {(r["holding_id"], r["folder"], r["note"] is None) for r in listed.filter("holding_id <> 'h6'").collect()} == {
        ("h1", odd, True), ("h2", odd, False), ("h3", "plain", True), ("h3", "plain", False), ("h4", None, False), ("h5", None, False)}


def test_claims_are_hashed_once_and_not_once_a_date(spark):
    """what a claim states is hashed before dates multiply it; the claims at each date are those that are relied on."""
    run = rules.Assessment(ledger(spark, CLAIMS))
    before = []

    def reduced(claims):
        before.append(claims.count())
        return claims.withColumn("_row", publish.row_hash(["claim_id", "requirement", "verdict"]))

    got = run.at_dates_relied(reduced).select("holding_id", "period_id", "_row")
    want = run.relied.select("holding_id", "period_id", publish.row_hash(["claim_id", "requirement", "verdict"]).alias("_row"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > sum(before) == 10
    lanes = [F.conv(F.substring("_row", 1 + 16 * n, 16), 16, 10).cast("decimal(20,0)") for n in range(4)]
    stated = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.sum(lane).cast("decimal(38,0)").cast("string") for lane in lanes]), 256)
    same = want.groupBy("period_id").agg(stated.alias("a"), publish.hash_sum("_row").alias("b")).collect()
    assert len(same) == 3 and all(r["a"] == r["b"] for r in same)


def test_a_tuple_without_a_rule_stops_only_where_it_is_relied_on(spark):
    late = (*claim("x", lo=DAY(2010, 1, 1))[:9], "rumor", *claim("x")[10:])
    assert rules.Assessment(ledger(spark, [late, claim("a")])).at_dates_relied(lambda claims: claims).count() == 3
    with pytest.raises(Exception, match="unlisted policy tuple: R2 rumor"):
        rules.Assessment(ledger(spark, [(*claim("x")[:9], "rumor", *claim("x")[10:])])).at_dates_relied(lambda claims: claims).collect()


def test_what_claims_state_meets_them_before_dates_do(spark):
    """F2, F3, F16: the exchange by claim holds a row a claim."""
    told = spark.createDataFrame([("a", 5), ("c", 7)], "claim_id string, stated int")
    run = rules.Assessment(ledger(spark, CLAIMS))
    got = run.relied_for("R2", told).select("claim_id", "period_id", "stated")
    want = run.relied_for("R2").join(told, "claim_id", "left").select("claim_id", "period_id", "stated")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_an_assessment_of_other_claims_keeps_the_lots_and_members(spark):
    """lots and members are not placed a second time."""
    class Run(rules.Assessment):
        lots = property(lambda self: self.keep("lots", lambda: spark.range(1)))
        members = property(lambda self: self.keep("members", lambda: spark.range(2)))

    import dataclasses
    held = dataclasses.make_dataclass("Few", ["claim"], frozen=True)(spark.range(3))
    run = Run(held)
    other = run.with_claims(spark.range(4), None)
    assert other.members is run.members and other.lots is run.lots and other.ledger.claim.count() == 4 and set(other._kept) == {"lots", "members"}


def test_tables_of_a_ledger_are_packed_closely(spark, tmp_path):
    """F16, F18, F21: what is stored of a ledger and of a run counts to the disk of every query on it."""
    spark.range(3).selectExpr("id AS r_regionkey", "'a' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    frames = derived.DerivedFrames(spark, str(tmp_path))
    stored = [frames["f_fund"], frames.store(spark.range(2), "two"), frames.kept("three", lambda: spark.range(3))]
    assert [df.count() for df in stored] == [3, 2, 3] and all(".zstd.parquet" in f for df in stored for f in df.inputFiles())


def test_lines_are_moved_once_to_meet_their_order(spark):
    """F16, F18, F21: with nothing broadcast, lines go to their order once, and not to their line number before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = derived.DerivedFrames(spark, "/root/testdata/sf0.001", stage=False)
        got, plan = frames["f_claim"], frames["f_claim"]._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*l_orderkey", plan)) == 1 and "l_linenumber#" not in " ".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", plan))
        stated = spark.sql(derived.FRAMES["f_claim"], **{n: frames[n] for n in ("lineitem", "orders", "f_holding", "documents")})
        assert got.exceptAll(stated).isEmpty() and got.count() == stated.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_evidence_of_a_date_is_added_up_without_sorting(spark):
    """F16, F23: an extreme of a text would sort the rows of all dates."""
    run = rules.Assessment(ledger(spark, CLAIMS))
    run._kept["lots"] = spark.createDataFrame([("l", "h", "a", 1, 1, 1, DAY(1999, 1, 1), None, "f", "direct_equity", None, None, None)], LOT)
    run._kept["classes_R2"] = spark.createDataFrame([("h", "f_1", "a", 1, 1, 0, 0, 1, 1, None, None, False)], CLASSES)
    assert "SortAggregate" not in run.r2_evidence._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", [["holding_id", "requirement", "period_id"], ["requirement", "period_date"]])
def test_relevant_documents_are_moved_once_to_the_ones_found(spark, case):
    """cases and their documents are told apart where they meet the ranking, not moved there and on."""
    claims = [(*claim(f"c{n}", None, DAY(1999 + n % 3, 1, 1), None, ("R1", "R2"), f"h{n % 2}")[:-1], n % 4) for n in range(12)]
    held = ledger(spark, claims)
    top = retrieval.gold_cases(held).filter("document_no < 2").withColumn("place", F.lit(1)).select(*case, "document_no", "place").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = retrieval.recall_per_case(held, top, case)
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*document_no#", plan)) <= 1 + len(re.findall(r"Exchange hashpartitioning\([^)]*document_no#", top._jdf.queryExecution().executedPlan().toString())) + 1
        got = {(r["holding_id"], r["requirement"], r["period_id"]): (r["found"], r["relevant"]) for r in told.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    relevant = {(r["holding_id"], r["requirement"], r["period_id"], r["document_no"]) for r in retrieval.gold_cases(held).collect()}
    assert got == {k: (sum(d < 2 for *c, d in relevant if tuple(c) == k), sum(tuple(c) == k for *c, _ in relevant)) for k in {x[:3] for x in relevant}}


def test_facts_are_those_of_the_claims_at_hand(spark):
    """Stored facts of the whole ledger are not taken for those of other claims that a reader holds."""
    whole = derived.DerivedFrames(spark, "/root/testdata/sf0.001")
    assert whole["f_fact_raw"].count() > 0
    mine = derived.DerivedFrames(spark, "/root/testdata/sf0.001")
    few = whole["f_claim"].filter("order_key % 50 = 0")
    mine._built["f_claim"] = few.unionByName(few)
    assert mine._derive("f_fact").join(few, "claim_id", "left_anti").isEmpty()


def test_a_stored_ledger_is_packed_closely(spark):
    """the second copy of a ledger counts to the disk of the query that reads it back."""
    held = movement.stored_ledger(derived.DerivedFrames(spark, "/root/testdata/sf0.001"))
    assert all(df.inputFiles() and all(".zstd.parquet" in f for f in df.inputFiles()) for df in (held.lot, held.fact, held.document))
