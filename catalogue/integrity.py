"""AUD: every integrity rule as a query that returns the rows breaking it."""

from pyspark.sql import functions as F

from attestor import model
from attestor.operators import audits, joins, rules
from attestor.sources import documents
from attestor.sources.ledger import from_derived
from catalogue import LIBRARY, query
from catalogue.rules import assessment


@query("aud_01", """SELECT 'lot_shares_and_price_together' AS rule, lot_id AS subject FROM {f_lot} WHERE (shares IS NULL) <> (entry_pps IS NULL)
 UNION ALL SELECT 'lot_realised_after_acquired', lot_id FROM {f_lot} WHERE realized_date < acquired_date UNION ALL SELECT 'lot_shares_non_negative', lot_id FROM {f_lot} WHERE shares < 0
 UNION ALL SELECT 'conversion_shares_positive', lot_id FROM {f_conversion} WHERE to_shares <= 0 UNION ALL SELECT 'claim_window_ordered', claim_id FROM {f_claim} WHERE applicable_to < applicable_from
 UNION ALL SELECT 'claim_known_source_class', claim_id FROM {o_spoilt_claim} WHERE source_class = 'blog'""")
def aud_01(fr):
    claims = fr["f_claim"].withColumn("source_class", F.when(F.col("order_key") % 500 == 0, "blog").otherwise(F.col("source_class")))
    return audits.broken(fr["f_lot"], "lot_id", audits.lot_rules()).unionByName(
        audits.broken(fr["f_conversion"], "lot_id", audits.conversion_rules())).unionByName(audits.broken(claims, "claim_id", audits.claim_rules()))


LIBRARY["o_spoilt_claim"] = "SELECT claim_id, CASE WHEN order_key % 500 = 0 THEN 'blog' ELSE source_class END AS source_class FROM {f_claim}"


@query("aud_02", """SELECT 'line_key' AS rule, l_orderkey || '/' || l_linenumber AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'mark_revision', holding_id || '/' || period_id || '/' || revision FROM {f_mark} GROUP BY holding_id, period_id, revision HAVING count(*) > 1""")
def aud_02(fr):
    lines = fr["lineitem"].select(F.col("l_orderkey").cast("string").alias("o"), F.col("l_linenumber").cast("string").alias("n"))
    marks = fr["f_mark"].select("holding_id", "period_id", F.col("revision").cast("string").alias("revision"))
    return audits.duplicates(lines, ["o", "n"], "line_key").unionByName(audits.duplicates(marks, ["holding_id", "period_id", "revision"], "mark_revision"))


@query("aud_03", """SELECT 'superseded_claim' AS rule, claim_id AS subject FROM {f_claim} AS c WHERE supersedes_claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f_claim} AS x WHERE x.claim_id = c.supersedes_claim_id)
 UNION ALL SELECT 'decided_mark', CAST(event_id AS VARCHAR) FROM events WHERE NOT EXISTS (SELECT 1 FROM {f_mark} AS m WHERE m.cust_key = user_id)
 UNION ALL SELECT 'gap_claim', gap_id FROM {f_gap} AS g WHERE NOT EXISTS (SELECT 1 FROM {f_claim} AS c WHERE c.holding_id = g.holding_id)""")
def aud_03(fr):
    return audits.orphans(fr["f_claim"], "supersedes_claim_id", fr["f_claim"], "claim_id", "superseded_claim", "claim_id").unionByName(
        audits.orphans(fr["events"], "user_id", fr["f_mark"], "cust_key", "decided_mark", "event_id")).unionByName(
        audits.orphans(fr["f_gap"], "holding_id", fr["f_claim"], "holding_id", "gap_claim", "gap_id"))


@query("aud_04", "SELECT CASE cust_key % 50 WHEN 3 THEN 'removed' ELSE 'changed' END AS rule, mark_id AS subject FROM {f_mark} WHERE cust_key % 50 IN (3, 4)")
def aud_04(fr):
    old = fr["f_mark"]
    new = old.filter("cust_key % 50 <> 3").withColumn("reported_amount", F.when(F.col("cust_key") % 50 == 4, F.col("reported_amount") + 1).otherwise(F.col("reported_amount")).cast("decimal(24,4)"))
    return audits.rewritten(old, new, "mark_id")


@query("aud_05", """SELECT 'approval_names_no_evidence' AS rule, CAST(decision_id AS VARCHAR) AS subject FROM {f_decision} AS d WHERE decision_type IN ('valuation', 'management_assessment') AND status = 'approved' AND NOT EXISTS (SELECT 1 FROM {f_decision_evidence} AS e WHERE e.decision_id = d.decision_id)""")
def aud_05(fr):
    return audits.approvals_without_evidence(fr["f_decision"], fr["f_decision_evidence"])


@query("aud_06", "SELECT 'evidence_added_after_its_decision' AS rule, assessment_id AS subject, decision_id FROM {f_decision_evidence} WHERE decision_id % 30 = 7")
def aud_06(fr):
    batch = F.col("decision_id") % 100
    evidence = fr["f_decision_evidence"].withColumn("batch", F.when(F.col("decision_id") % 30 == 7, batch + 1).otherwise(batch))
    return audits.unsealed_evidence(fr["f_decision"].withColumn("batch", batch), evidence)


@query("aud_07", """SELECT 'always_applicable_marked_na' AS rule, assessment_id AS subject FROM {f_assessment} AS a JOIN {o_member} AS m ON m.holding_id = a.holding_id AND m.period_id = a.period_id AND m.held WHERE a.requirement IN ('R1', 'R2') AND a.verdict = 'not_applicable'""")
def aud_07(fr):
    return audits.not_applicable_while_held(fr["f_assessment"], assessment(fr).members)


@query("aud_08", """SELECT 'link_outside_reliance_window' AS rule, assessment_id || '|' || l.claim_id AS subject FROM {f_link} AS l JOIN {f_claim} AS c ON c.claim_id = l.claim_id WHERE c.applicable_from > l.period_date OR c.applicable_to < l.period_date
 UNION ALL SELECT 'subsequent_flag_disagrees', assessment_id || '|' || l.claim_id FROM {f_link} AS l JOIN {f_claim} AS c ON c.claim_id = l.claim_id WHERE l.is_subsequent <> (greatest(c.issued_date, coalesce(c.received_date, c.issued_date)) > l.period_date)""")
def aud_08(fr):
    return audits.link_violations(fr["f_link"], fr["f_claim"])


@query("aud_09", """SELECT * FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM {f_assessment} AS a WHERE a.holding_id = d.holding_id AND a.period_id = d.period_id AND a.requirement = 'R1') THEN 'no_R1_row'
 WHEN NOT EXISTS (SELECT 1 FROM {f_assessment} AS a WHERE a.holding_id = d.holding_id AND a.period_id = d.period_id AND a.requirement = 'R2') THEN 'no_R2_row'
 WHEN EXISTS (SELECT 1 FROM {o_lotdate} AS l WHERE l.holding_id = d.holding_id AND l.period_id = d.period_id AND l.realised) AND NOT EXISTS (SELECT 1 FROM {f_assessment} AS a WHERE a.holding_id = d.holding_id AND a.period_id = d.period_id AND a.requirement = 'R4' AND a.applicable) THEN 'realised_without_R4_row'
 WHEN s.req IS NOT NULL THEN 'no_sufficient_' || s.req WHEN u.req IS NOT NULL THEN 'unlinked_' || u.req END AS rule, CAST(d.decision_id AS VARCHAR) AS subject
FROM {f_decision} AS d LEFT JOIN (SELECT d.decision_id, min(a.requirement) AS req FROM {f_decision} AS d JOIN {f_assessment} AS a ON a.holding_id = d.holding_id AND a.period_id = d.period_id AND a.applicable
  LEFT JOIN {f_decision_evidence} AS e ON e.decision_id = d.decision_id AND e.assessment_id = a.assessment_id WHERE e.decision_id IS NULL OR a.verdict <> 'sufficient' OR a.mark_id <> d.mark_id OR a.policy_version <> 'policy-1' GROUP BY 1) AS s ON s.decision_id = d.decision_id
 LEFT JOIN (SELECT e.decision_id, min(a.requirement) AS req FROM {f_decision_evidence} AS e JOIN {f_assessment} AS a ON a.assessment_id = e.assessment_id AND a.applicable AND a.verdict = 'sufficient' AND a.requirement IN ('R1', 'R2')
  WHERE NOT EXISTS (SELECT 1 FROM {f_link} AS l WHERE l.assessment_id = a.assessment_id) GROUP BY 1) AS u ON u.decision_id = d.decision_id
WHERE d.decision_type = 'valuation' AND d.status = 'approved') WHERE rule IS NOT NULL""")
def aud_09(fr):
    return audits.incomplete_approvals(fr["f_decision"], fr["f_decision_evidence"], fr["f_assessment"], fr["f_link"], assessment(fr).realised_lots, "policy-1")


@query("aud_10", """SELECT * FROM (SELECT CASE WHEN p.policy_version <> 'policy-1' THEN 'policy_version_differs' WHEN m.n IS NULL THEN 'empty_manifest' WHEN m.lo <> 1 OR m.hi <> m.n THEN 'manifest_not_contiguous'
 WHEN NOT EXISTS (SELECT 1 FROM {f_mark} AS k WHERE k.period_id = p.period_id) THEN 'no_mark_at_all'
 WHEN EXISTS (SELECT 1 FROM {f_latest_mark} AS k WHERE k.period_id = p.period_id AND NOT EXISTS (SELECT 1 FROM {f_decision} AS d WHERE d.mark_id = k.mark_id AND d.decision_type = 'valuation' AND d.status = 'approved')) THEN 'unapproved_mark' END AS rule, p.packet_id AS subject
FROM {f_packet} AS p LEFT JOIN (SELECT packet_id, count(*) AS n, min(ordinal) AS lo, max(ordinal) AS hi FROM {f_manifest} GROUP BY 1) AS m ON m.packet_id = p.packet_id WHERE p.approved_on IS NOT NULL) WHERE rule IS NOT NULL""")
def aud_10(fr):
    return audits.packet_violations(fr["f_packet"], fr["f_manifest"], fr["f_mark"], fr["f_decision"], "policy-1")


@query("aud_11", "SELECT 'entry_after_approval' AS rule, path AS subject FROM {f_manifest} AS m JOIN {f_packet} AS p ON p.packet_id = m.packet_id WHERE m.recorded_on > p.approved_on")
def aud_11(fr):
    return audits.entries_after_approval(fr["f_packet"], fr["f_manifest"])


@query("aud_12", """SELECT 'holding_and_period_of_two_funds' AS rule, mark_id AS subject FROM {f_mark} AS m JOIN {f_holding} AS h ON h.holding_id = m.holding_id WHERE m.cust_key % 60 = 1 AND h.fund_id <> 'fund_0'""")
def aud_12(fr):
    moved = F.when(F.col("cust_key") % 60 == 1, F.concat(F.lit("fund_0_"), F.col("period_date").cast("string"))).otherwise(F.col("period_id"))
    return audits.other_funds(fr["f_mark"].withColumn("period_id", moved), fr["f_holding"], fr["f_period"], "mark_id")


@query("aud_13", "SELECT 'mark_for_an_unheld_period' AS rule, holding_id || '@' || period_id AS subject FROM {o_during_period} WHERE NOT held_during")
def aud_13(fr):
    return joins.held_during_reported_period(from_derived(fr)).filter("NOT held_during").select(
        F.lit("mark_for_an_unheld_period").alias("rule"), F.concat_ws("@", "holding_id", "period_id").alias("subject"))


@query("aud_14", """SELECT * FROM (SELECT CASE WHEN unstated THEN 'priced_without_a_class'
 WHEN len([x for x in priced if not list_contains(held, x) and len([q for q in decided if q.f = x and list_contains(held, q.t)]) = 0]) > 0 THEN 'priced_from_an_unheld_class'
 WHEN len(priced) > 0 AND len([x for x in held if not list_contains(priced, x) and len([q for q in decided if q.t = x and list_contains(priced, q.f)]) = 0]) > 0 THEN 'held_class_without_a_price' END AS rule, CAST(decision_id AS VARCHAR) AS subject
FROM (SELECT d.decision_id, s.unstated, coalesce(s.priced, []) AS priced, coalesce(h.held_classes, []) AS held, coalesce(p.decided, []) AS decided FROM {f_decision} AS d
 JOIN (SELECT e.decision_id, bool_or(c.priced_class IS NULL) AS unstated, list(DISTINCT c.priced_class) FILTER (c.priced_class IS NOT NULL) AS priced FROM {f_decision_evidence} AS e JOIN {f_link} AS l ON l.assessment_id = e.assessment_id JOIN {f_claim} AS c ON c.claim_id = l.claim_id AND c.price_per_share IS NOT NULL WHERE e.requirement = 'R2' GROUP BY 1) AS s ON s.decision_id = d.decision_id
 LEFT JOIN {o_held} AS h ON h.holding_id = d.holding_id AND h.period_id = d.period_id
 LEFT JOIN (SELECT holding_id, period_id, list(struct_pack(f := from_class, t := to_class)) AS decided FROM {f_policy_decision} GROUP BY 1, 2) AS p ON p.holding_id = d.holding_id AND p.period_id = d.period_id
WHERE d.decision_type = 'valuation' AND d.status = 'approved')) WHERE rule IS NOT NULL""")
def aud_14(fr):
    a = assessment(fr)
    return audits.cross_class_violations(fr["f_decision"], fr["f_decision_evidence"], fr["f_link"], fr["f_claim"], a.held_dates, fr["f_policy_decision"])


LIBRARY["o_support_spoilt"] = """
SELECT CASE WHEN lot_id IS NOT NULL AND CAST(substr(lot_id, 2) AS BIGINT) % 40 = 2 THEN 'h0' ELSE holding_id END AS holding_id, component, CASE WHEN CAST(substr(holding_id, 2) AS BIGINT) % 37 = 5 THEN supported_on + 1 ELSE supported_on END AS supported_on, lot_id, claim_id FROM {f_support}"""


@query("aud_15", """SELECT * FROM (SELECT unnest([CASE WHEN (s.claim_id IS NULL) = (s.lot_id IS NULL) THEN 'support_names_one_artefact' END,
 CASE WHEN NOT (CASE WHEN s.claim_id IS NOT NULL THEN s.supported_on IN (c.issued_date, c.applicable_from, coalesce(c.received_date, c.issued_date)) ELSE s.supported_on = l.acquired_date END) THEN 'support_date_is_the_artefacts_own' END,
 CASE WHEN coalesce(c.holding_id, l.holding_id) <> s.holding_id THEN 'support_of_the_same_holding' END]) AS rule, s.component || '|' || coalesce(s.lot_id, '') || '|' || coalesce(s.claim_id, '') AS subject
FROM {o_support_spoilt} AS s LEFT JOIN {f_claim} AS c ON c.claim_id = s.claim_id LEFT JOIN {f_lot} AS l ON l.lot_id = s.lot_id) WHERE rule IS NOT NULL""")
def aud_15(fr):
    lot_no, key = F.substring("lot_id", 2, 20).cast("bigint"), F.substring("holding_id", 2, 20).cast("bigint")
    spoilt = fr["f_support"].withColumn("supported_on", F.when(key % 37 == 5, F.date_add("supported_on", 1)).otherwise(F.col("supported_on"))).withColumn(
        "holding_id", F.when(F.coalesce(lot_no % 40 == 2, F.lit(False)), "h0").otherwise(F.col("holding_id")))
    return audits.support_violations(spoilt, fr["f_claim"], fr["f_lot"])


@query("aud_16", "SELECT 'request_bears_no_evidence' AS rule, claim_id AS subject FROM {f_claim_requirement} WHERE CAST(substr(holding_id, 2) AS INT) % 90 = 4 AND requirement = 'R1'")
def aud_16(fr):
    spoilt = fr["f_claim_requirement"].withColumn("requirement", F.when((F.substring("holding_id", 2, 20).cast("int") % 90 == 4) & (F.col("requirement") == "R1"), "R3").otherwise(F.col("requirement")))
    return audits.broken(spoilt, "claim_id", {"request_bears_no_evidence": F.col("requirement").isin(*model.EVIDENCE_BEARING)})


@query("aud_17", """SELECT 'kind_iff_management_assessment' AS rule, CAST(decision_id AS VARCHAR) AS subject FROM {f_decision} WHERE decision_type <> 'management_assessment' AND decision_id % 33 = 1
 UNION ALL SELECT 'consideration_on_representativeness_only', CAST(c.decision_id AS VARCHAR) FROM {f_consideration} AS c JOIN {f_decision} AS d ON d.decision_id = c.decision_id WHERE d.assessment_kind <> 'representativeness'
 UNION ALL SELECT 'consideration_note_not_blank', CAST(decision_id AS VARCHAR) FROM {f_consideration} WHERE NOT regexp_matches(note, '[^[:space:]]')""")
def aud_17(fr):
    spoilt = fr["f_decision"].withColumn("assessment_kind", F.when((F.col("decision_type") != "management_assessment") & (F.col("decision_id") % 33 == 1), "basis_memo").otherwise(F.col("assessment_kind")))
    return audits.assessment_kind_violations(spoilt, fr["f_consideration"])


@query("aud_18", """SELECT 'adverse_verdict_states_a_reason' AS rule, assessment_id AS subject FROM {f_assessment} WHERE verdict NOT IN ('sufficient', 'not_applicable', 'not_assessed') AND reason_code = ''
 UNION ALL SELECT 'span_is_ordered', claim_id || '/' || field_name FROM {f_fact} WHERE NOT (0 <= span_start AND span_start < span_end) UNION ALL SELECT 'input_has_one_source', figure_id || '/' || ordinal FROM {f_figure_input} WHERE child_id IS NOT NULL""")
def aud_18(fr):
    verdicts = audits.broken(fr["f_assessment"], "assessment_id", {
        "adverse_verdict_states_a_reason": F.col("verdict").isin("sufficient", "not_applicable", "not_assessed") | (F.col("reason_code") != "")})
    spans = audits.broken(fr["f_fact"].withColumn("s", F.concat_ws("/", "claim_id", "field_name")), "s", {
        "span_is_ordered": (F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end"))})
    inputs = audits.broken(fr["f_figure_input"].withColumn("s", F.concat_ws("/", "figure_id", F.col("ordinal").cast("string"))), "s", {
        "input_has_one_source": F.col("fact_id").isNull() != F.col("child_id").isNull()})
    return verdicts.unionByName(spans).unionByName(inputs)


@query("aud_19", """SELECT 'held_without_a_mark' AS rule, h.holding_id || '@' || h.period_id AS subject FROM {o_held} AS h WHERE NOT EXISTS (SELECT 1 FROM {f_moved_mark} AS m WHERE m.holding_id = h.holding_id AND m.period_id = h.period_id)
 UNION ALL SELECT 'matrix_cell_ruled_twice', concat_ws('/', requirement, source_class, execution_status, position_type) FROM (SELECT requirement, source_class, execution_status, position_type FROM {d_matrix} UNION ALL SELECT * FROM {f_ruling}) GROUP BY requirement, source_class, execution_status, position_type HAVING count(*) > 1
 UNION ALL SELECT 'holding_without_lots', holding_id FROM {f_holding} AS h WHERE NOT EXISTS (SELECT 1 FROM {f_lot} AS l WHERE l.holding_id = h.holding_id)
 UNION ALL SELECT 'declared_count_differs', d.table_name || ': ' || d.declared || ' declared, ' || t.n || ' found' FROM {f_declared} AS d JOIN (SELECT 'lot' AS table_name, count(*) AS n FROM {f_lot} UNION ALL SELECT 'period', count(*) FROM {f_period}) AS t USING (table_name) WHERE d.declared <> t.n""")
def aud_19(fr):
    a = assessment(fr)
    marks = fr["f_moved_mark"].select("holding_id", "period_id").distinct()
    cell = ["requirement", "source_class", "execution_status", "position_type"]
    ruled = audits.duplicates(model.matrix(fr.spark).select(*cell).unionByName(fr["f_ruling"]), cell, "matrix_cell_ruled_twice")
    unmarked = a.held_dates.join(marks, ["holding_id", "period_id"], "left_anti").select(F.lit("held_without_a_mark").alias("rule"), F.concat_ws("@", "holding_id", "period_id").alias("subject"))
    bare = fr["f_holding"].join(fr["f_lot"].select("holding_id").distinct(), "holding_id", "left_anti").select(F.lit("holding_without_lots").alias("rule"), F.col("holding_id").alias("subject"))
    counts = documents.declared_counts({"lot": fr["f_lot"], "period": fr["f_period"]}, fr["f_declared"]).filter("NOT agrees")
    counted = counts.select(F.lit("declared_count_differs").alias("rule"), F.concat("table_name", F.lit(": "), F.col("declared").cast("string"), F.lit(" declared, "), F.col("rows").cast("string"), F.lit(" found")).alias("subject"))
    return unmarked.unionByName(bare).unionByName(counted).unionByName(ruled.select("rule", "subject"))


LIBRARY["o_request"] = """
SELECT decision_id, decision_type, status, CASE WHEN decision_id % 13 = 0 THEN '' WHEN decision_id % 17 = 0 THEN 'mark-x' ELSE CAST(decision_id AS VARCHAR) END AS subject_id, CASE WHEN decision_id % 3 = 0 THEN 'because' WHEN decision_id % 3 = 1 THEN ' ' || chr(10) END AS reason FROM {f_decision}"""


@query("aud_20", """SELECT 'status_is_recordable' AS rule, CAST(decision_id AS VARCHAR) AS subject FROM {o_request} WHERE status NOT IN ('approved', 'rejected') UNION ALL SELECT 'subject_is_named', CAST(decision_id AS VARCHAR) FROM {o_request} WHERE NOT regexp_matches(subject_id, '\\S')
 UNION ALL SELECT 'mark_bound_subject_is_a_number', CAST(decision_id AS VARCHAR) FROM {o_request} WHERE decision_type IN ('valuation', 'management_assessment') AND NOT regexp_full_match(subject_id, '[0-9]+')
 UNION ALL SELECT 'rejection_states_its_reason', CAST(decision_id AS VARCHAR) FROM {o_request} WHERE status = 'rejected' AND NOT regexp_matches(coalesce(reason, ''), '\\S')""")
def aud_20(fr):
    k = F.col("decision_id")
    requests = fr["f_decision"].select("decision_id", "decision_type", "status", F.when(k % 13 == 0, "").when(k % 17 == 0, "mark-x").otherwise(k.cast("string")).alias("subject_id"),
                                       F.when(k % 3 == 0, "because").when(k % 3 == 1, " \n").alias("reason"))
    return audits.request_violations(requests)


@query("aud_21", """SELECT CASE WHEN c.decision_id IS NULL THEN 'assessment_not_cited' ELSE 'cited_but_not_of_the_set' END AS rule, coalesce(d.decision_id, c.decision_id) || '|' || coalesce(d.assessment_id, c.assessment_id) AS subject FROM
 (SELECT d.decision_id, a.assessment_id FROM {f_decision} AS d JOIN {f_assessment} AS a ON a.mark_id = d.mark_id AND a.policy_version = 'policy-1' WHERE d.decision_type = 'valuation' AND d.status = 'approved') AS d
 FULL JOIN (SELECT e.decision_id, e.assessment_id FROM {f_decision_evidence} AS e JOIN {f_decision} AS d ON d.decision_id = e.decision_id AND d.status = 'approved') AS c ON c.decision_id = d.decision_id AND c.assessment_id = d.assessment_id WHERE c.decision_id IS NULL OR d.decision_id IS NULL""")
def aud_21(fr):
    return audits.evidence_is_the_whole_set(fr["f_decision"], fr["f_decision_evidence"], fr["f_assessment"], "policy-1")
