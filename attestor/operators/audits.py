"""Integrity rules as queries that return the violating rows; an empty result is a pass.

Each audit gives (rule, subject). Rules on one row are one pass over the frame, rules between frames are anti joins
or aggregates on the key, never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import temporal


def broken(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """AUD-01/18: rules of one row; an unknown condition passes, as a CHECK does."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()]))
    return df.select(F.explode(failed).alias("rule"), F.col(subject).cast("string").alias("subject"))


def lot_rules() -> dict[str, Column]:
    shares, pps, cost = F.col("shares"), F.col("entry_pps"), F.col("cost_amount")
    return {
        "lot_shares_and_price_together": shares.isNull() == pps.isNull(),
        "lot_realised_after_acquired": F.col("realized_date") >= F.col("acquired_date"),
        "lot_shares_non_negative": shares >= 0,
        "lot_shares_whole": shares == F.floor(shares),
        "lot_price_scale": S.fits_scale(pps, 6),
        "lot_cost_scale": S.fits_scale(cost, 4),
    }


def conversion_rules() -> dict[str, Column]:
    return {
        "conversion_shares_positive": F.col("to_shares") > 0,
        "conversion_shares_whole": F.col("to_shares") == F.floor("to_shares"),
        "conversion_ratio_scale": S.fits_scale(F.col("exchange_ratio"), 8),
    }


def claim_rules() -> dict[str, Column]:
    return {
        "claim_window_ordered": F.col("applicable_to") >= F.col("applicable_from"),
        "claim_price_scale": S.fits_scale(F.col("price_per_share"), 6),
        "claim_known_source_class": F.col("source_class").isin(*model.SOURCE_CLASSES),
        "claim_known_execution_status": F.col("execution_status").isin(*model.EXECUTION_STATUSES),
    }


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """AUD-02."""
    many = df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    return many.select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("subject"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str, subject: str) -> DataFrame:
    """AUD-03: a reference to a row that does not exist; a null refers to nothing."""
    named = child.filter(F.col(column).isNotNull()).select(F.col(subject).cast("string").alias("subject"), F.col(column).alias("_ref"))
    return named.join(parent.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti").select(F.lit(rule).alias("rule"), "subject")


def rewritten(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """AUD-04: rows of the old snapshot that the new one lacks or states differently; additions are lawful."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    before = old.select(key, digest(old).alias("was"))
    after = new.select(key, digest(new).alias("now"))
    joined = before.join(after, key, "left").filter("now IS NULL OR now <> was")
    return joined.select(F.when(F.col("now").isNull(), "removed").otherwise("changed").alias("rule"), F.col(key).cast("string").alias("subject"))


def approvals_without_evidence(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """AUD-05."""
    approvals = decisions.filter("decision_type IN ('valuation', 'management_assessment') AND status = 'approved'")
    return approvals.join(evidence.select("decision_id").distinct(), "decision_id", "left_anti").select(
        F.lit("approval_names_no_evidence").alias("rule"), F.col("decision_id").cast("string").alias("subject"))


def unsealed_evidence(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """AUD-06: evidence recorded in another batch than its decision."""
    joined = evidence.join(decisions.select("decision_id", F.col("batch").alias("decision_batch")), "decision_id")
    return joined.filter("batch <> decision_batch").select(F.lit("evidence_added_after_its_decision").alias("rule"), F.col("assessment_id").alias("subject"), "decision_id")


def not_applicable_while_held(assessments: DataFrame, members: DataFrame) -> DataFrame:
    """AUD-07."""
    wrong = assessments.filter("requirement IN ('R1', 'R2') AND verdict = 'not_applicable'")
    held = members.filter("held").select("holding_id", "period_id")
    return wrong.join(held, ["holding_id", "period_id"], "left_semi").select(F.lit("always_applicable_marked_na").alias("rule"), F.col("assessment_id").alias("subject"))


def link_violations(links: DataFrame, claims: DataFrame) -> DataFrame:
    """AUD-08: a link outside its claim's window, or whose subsequent flag is not what the dates say."""
    joined = links.join(claims.select("claim_id", "applicable_from", "applicable_to", "issued_date", "received_date"), "claim_id")
    later = S.effective_date(F.col("issued_date"), F.col("received_date")) > F.col("period_date")
    rules = {"link_outside_reliance_window": temporal.window_covers(F.col("period_date")), "subsequent_flag_disagrees": F.col("is_subsequent") == later}
    return broken(joined.withColumn("link", F.concat_ws("|", "assessment_id", "claim_id")), "link", rules)


def incomplete_approvals(decisions: DataFrame, evidence: DataFrame, assessments: DataFrame, links: DataFrame, realised: DataFrame, policy_version: str) -> DataFrame:
    """AUD-09: approvals whose assessment set is incomplete; the first failing rule of each is kept.

    ``realised`` lists (holding_id, period_id) with a lot realised in the window.
    """
    approvals = decisions.filter("decision_type = 'valuation' AND status = 'approved'").select("decision_id", "mark_id", "holding_id", "period_id")
    asked = assessments.groupBy("holding_id", "period_id").agg(
        F.bool_or(F.col("requirement") == "R1").alias("asks_r1"), F.bool_or(F.col("requirement") == "R2").alias("asks_r2"),
        F.bool_or((F.col("requirement") == "R4") & F.col("applicable")).alias("asks_r4"))
    linked = links.select("assessment_id").distinct().withColumn("linked", F.lit(True))
    cited = evidence.select("decision_id", "assessment_id").withColumn("cited", F.lit(True))
    due = approvals.join(assessments.filter("applicable").select("holding_id", "period_id", "assessment_id", F.col("mark_id").alias("assessed_mark"), "requirement", "verdict", "policy_version"), ["holding_id", "period_id"])
    due = due.join(cited, ["decision_id", "assessment_id"], "left").join(linked, "assessment_id", "left")
    good = F.col("cited").isNotNull() & (F.col("verdict") == "sufficient") & (F.col("assessed_mark") == F.col("mark_id")) & (F.col("policy_version") == policy_version)
    bare = F.col("cited").isNotNull() & F.col("requirement").isin("R1", "R2") & (F.col("verdict") == "sufficient") & F.col("linked").isNull()
    found = due.groupBy("decision_id").agg(F.min(F.when(~good, F.col("requirement"))).alias("short"), F.min(F.when(bare, F.col("requirement"))).alias("unlinked"))
    rows = approvals.join(asked, ["holding_id", "period_id"], "left").join(realised.select("holding_id", "period_id").distinct().withColumn("realised", F.lit(True)), ["holding_id", "period_id"], "left").join(found, "decision_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rule = (
        F.when(no("asks_r1"), "no_R1_row").when(no("asks_r2"), "no_R2_row")
        .when(F.col("realised") & no("asks_r4"), "realised_without_R4_row")
        .when(F.col("short").isNotNull(), F.concat(F.lit("no_sufficient_"), "short"))
        .when(F.col("unlinked").isNotNull(), F.concat(F.lit("unlinked_"), "unlinked")))
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", F.col("decision_id").cast("string").alias("subject"))


def packet_violations(packets: DataFrame, manifest: DataFrame, marks: DataFrame, decisions: DataFrame, policy_version: str) -> DataFrame:
    """AUD-10: approved packets against policy version, manifest and the approvals of their latest marks."""
    entries = manifest.groupBy("packet_id").agg(F.count("*").alias("entries"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    approved = decisions.filter("decision_type = 'valuation' AND status = 'approved'").select("mark_id").distinct()
    latest = temporal.latest(marks.select("holding_id", "period_id", "revision", "mark_id"), ["holding_id", "period_id"], "revision")
    missing = latest.join(approved, "mark_id", "left_anti").groupBy("period_id").agg(F.min("holding_id").alias("unapproved"))
    marked = marks.groupBy("period_id").agg(F.count("*").alias("marks"))
    rows = packets.filter("approved_on IS NOT NULL").join(entries, "packet_id", "left").join(marked, "period_id", "left").join(missing, "period_id", "left")
    rule = (
        F.when(F.col("policy_version") != policy_version, "policy_version_differs").when(F.col("entries").isNull(), "empty_manifest")
        .when((F.col("low") != 1) | (F.col("high") != F.col("entries")), "manifest_not_contiguous").when(F.col("marks").isNull(), "no_mark_at_all")
        .when(F.col("unapproved").isNotNull(), "unapproved_mark"))
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", F.col("packet_id").alias("subject"))


def entries_after_approval(packets: DataFrame, manifest: DataFrame) -> DataFrame:
    """AUD-11."""
    joined = manifest.join(packets.select("packet_id", "approved_on"), "packet_id")
    return joined.filter("recorded_on > approved_on").select(F.lit("entry_after_approval").alias("rule"), F.col("path").alias("subject"))


def other_funds(rows: DataFrame, holdings: DataFrame, periods: DataFrame, subject: str) -> DataFrame:
    """AUD-12: holding and period of one row belong to different funds."""
    joined = rows.join(holdings.select("holding_id", F.col("fund_id").alias("holding_fund")), "holding_id").join(periods.select("period_id", F.col("fund_id").alias("period_fund")), "period_id")
    return joined.filter("holding_fund <> period_fund").select(F.lit("holding_and_period_of_two_funds").alias("rule"), F.col(subject).alias("subject"))


def cross_class_violations(decisions: DataFrame, evidence: DataFrame, links: DataFrame, claims: DataFrame, held: DataFrame, policy_decisions: DataFrame) -> DataFrame:
    """AUD-14: approvals priced across classes without a decision in that direction; unstated classes are refused.

    Classes per approval are reduced to sets first; what is compared afterwards is class against class.
    """
    approvals = decisions.filter("decision_type = 'valuation' AND status = 'approved'").select("decision_id", "holding_id", "period_id")
    r2 = evidence.filter("requirement = 'R2'").select("decision_id", "assessment_id").join(links.select("assessment_id", "claim_id"), "assessment_id")
    priced = r2.join(claims.filter("price_per_share IS NOT NULL").select("claim_id", "priced_class"), "claim_id").groupBy("decision_id").agg(
        F.bool_or(F.col("priced_class").isNull()).alias("unstated"), F.collect_set("priced_class").alias("priced"))
    decided = policy_decisions.groupBy("holding_id", "period_id").agg(F.collect_set(F.struct("from_class", "to_class")).alias("decided"))
    rows = approvals.join(priced, "decision_id").join(held.select("holding_id", "period_id", "held_classes"), ["holding_id", "period_id"], "left").join(decided, ["holding_id", "period_id"], "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("held_classes", F.coalesce("held_classes", empty))
    from_off = lambda x: ~F.coalesce(F.exists("decided", lambda d: (d.from_class == x) & F.array_contains("held_classes", d.to_class)), F.lit(False))
    to_bare = lambda x: ~F.coalesce(F.exists("decided", lambda d: (d.to_class == x) & F.array_contains("priced", d.from_class)), F.lit(False))
    off = F.exists(F.array_except("priced", "held_classes"), from_off)
    bare = (F.size("priced") > 0) & F.exists(F.array_except("held_classes", "priced"), to_bare)
    rule = F.when(F.col("unstated"), "priced_without_a_class").when(off, "priced_from_an_unheld_class").when(bare, "held_class_without_a_price")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", F.col("decision_id").cast("string").alias("subject"))


def support_violations(support: DataFrame, claims: DataFrame, lots: DataFrame) -> DataFrame:
    """AUD-15: a support names one artefact, carries that artefact's own date and its holding."""
    c = claims.select("claim_id", F.col("holding_id").alias("claim_holding"), "issued_date", "received_date", "applicable_from")
    l = lots.select("lot_id", F.col("holding_id").alias("lot_holding"), "acquired_date")
    joined = support.join(c, "claim_id", "left").join(l, "lot_id", "left")
    by_claim = F.col("claim_id").isNotNull()
    own = F.when(by_claim, (F.col("supported_on") == F.col("issued_date")) | (F.col("supported_on") == F.col("applicable_from")) | (
        F.col("supported_on") == F.coalesce("received_date", "issued_date"))).otherwise(F.col("supported_on") == F.col("acquired_date"))
    rules = {
        "support_names_one_artefact": F.col("claim_id").isNull() != F.col("lot_id").isNull(),
        "support_date_is_the_artefacts_own": own,
        "support_of_the_same_holding": F.coalesce("claim_holding", "lot_holding") == F.col("holding_id"),
    }
    subject = F.concat_ws("|", "component", F.coalesce("lot_id", F.lit("")), F.coalesce("claim_id", F.lit("")))
    return broken(joined.withColumn("s", subject), "s", rules)


def assessment_kind_violations(decisions: DataFrame, considerations: DataFrame) -> DataFrame:
    """AUD-17."""
    kinds = broken(decisions, "decision_id", {"kind_iff_management_assessment": (F.col("decision_type") == "management_assessment") == F.col("assessment_kind").isNotNull()})
    joined = considerations.join(decisions.select("decision_id", "assessment_kind"), "decision_id", "left")
    notes = broken(joined, "decision_id", {
        "consideration_on_representativeness_only": F.coalesce(F.col("assessment_kind") == "representativeness", F.lit(False)),
        "consideration_note_not_blank": F.col("note").rlike(S.VISIBLE)})
    return kinds.unionByName(notes)


def request_violations(requests: DataFrame) -> DataFrame:
    """AUD-20: a decision request names its subject, a rejection says why, mark-bound kinds name a mark."""
    bound = F.col("decision_type").isin("valuation", "management_assessment")
    return broken(requests, "decision_id", {
        "status_is_recordable": F.col("status").isin("approved", "rejected"),
        "subject_is_named": F.col("subject_id").rlike(S.VISIBLE),
        "mark_bound_subject_is_a_number": ~bound | F.col("subject_id").rlike("^[0-9]+$"),
        "rejection_states_its_reason": (F.col("status") != "rejected") | F.coalesce("reason", F.lit("")).rlike(S.VISIBLE),
    })


def evidence_is_the_whole_set(decisions: DataFrame, evidence: DataFrame, assessments: DataFrame, policy_version: str) -> DataFrame:
    """AUD-21: what an approval cites equals the assessments of its mark at the policy version, both ways."""
    approvals = decisions.filter("decision_type = 'valuation' AND status = 'approved'").select("decision_id", "mark_id")
    due = approvals.join(assessments.filter(F.col("policy_version") == policy_version).select("mark_id", "assessment_id"), "mark_id").select("decision_id", "assessment_id").withColumn("due", F.lit(True))
    cited = evidence.join(approvals.select("decision_id"), "decision_id", "left_semi").select("decision_id", "assessment_id").withColumn("cited", F.lit(True))
    both = due.join(cited, ["decision_id", "assessment_id"], "full").filter("due IS NULL OR cited IS NULL")
    return both.select(F.when(F.col("cited").isNull(), "assessment_not_cited").otherwise("cited_but_not_of_the_set").alias("rule"),
                       F.concat_ws("|", F.col("decision_id").cast("string"), "assessment_id").alias("subject"))
