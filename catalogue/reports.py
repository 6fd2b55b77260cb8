"""AGG and PKT: totals that say what they are, scorecards, and the tables of a packet."""

from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import citing, joins, order, packets, rules, temporal, totals, validators
from attestor.sources import workbook
from attestor.sources.ledger import from_derived
from catalogue import LIBRARY, query
from catalogue.rules import assessment
from catalogue.scalars import FUND_SQL, cell_number


@query("agg_01", f"SELECT sheet, label, CAST(sum({cell_number('cell')}) AS DECIMAL(36,6)) AS computed FROM {{o_grid_long}} WHERE company <> 'TOTAL' GROUP BY 1, 2", text="computed")
def agg_01(fr):
    long = workbook.unpivot_grid(workbook.company_rows(fr["f_grid"])).filter("cell IS NOT NULL")
    return long.groupBy("sheet", "label").agg(F.sum("amount").cast("decimal(36,6)").alias("computed"))


@query("agg_02", "SELECT fund, company, CAST(computed AS DECIMAL(36,6)) AS computed FROM {o_cost_breakdown}", text="computed")
def agg_02(fr):
    return joins.breakdown_costs(fr)


@query("agg_03", """SELECT h.holding_id, d.period_id, coalesce(bool_or(l.held), false) AS held, coalesce(bool_or(l.realised), false) AS realised, EXISTS (SELECT 1 FROM {f_lot} AS x WHERE x.holding_id = h.holding_id) AS has_lots
 FROM {f_holding} AS h JOIN {o_date} AS d ON d.fund_id = h.fund_id LEFT JOIN {o_lotdate} AS l ON l.holding_id = h.holding_id AND l.period_id = d.period_id GROUP BY 1, 2""")
def agg_03(fr):
    a = assessment(fr)
    flags = a.lots.groupBy("holding_id", "period_id").agg(
        F.bool_or("held").alias("held"), F.bool_or(temporal.realised_between(F.col("previous_date"), F.col("period_date"))).alias("realised"))
    has = a.ledger.lot.groupBy("holding_id").agg(F.lit(True).alias("has_lots"))
    dates = a.ledger.holding.select("holding_id", "fund_id").join(a.periods.select("fund_id", "period_id"), "fund_id")
    out = dates.join(flags, ["holding_id", "period_id"], "left").join(has, "holding_id", "left")
    return out.select("holding_id", "period_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("held", "realised", "has_lots")])


@query("agg_04", """SELECT d.decision_id, e.assessment_id, CASE WHEN e.assessment_id IS NOT NULL THEN row_number() OVER (PARTITION BY d.decision_id ORDER BY e.assessment_id) END AS ordinal FROM {f_decision} AS d
 LEFT JOIN {f_decision_evidence} AS e ON e.decision_id = d.decision_id WHERE d.decision_type = 'valuation'""")
def agg_04(fr):
    """The assessments a decision binds, in order, a row each; a decision that binds none keeps a row that says so."""
    bound = order.numbered(fr["f_decision_evidence"].select("decision_id", "assessment_id"), ["decision_id"], ["assessment_id"])
    return fr["f_decision"].filter("decision_type = 'valuation'").select("decision_id").join(bound, "decision_id", "left")


@query("agg_05", "SELECT h.holding_id, h.period_id, array_to_string(held_classes, ',') AS held, coalesce(array_to_string(list_sort(priced), ','), '') AS priced FROM {o_held} AS h LEFT JOIN {o_r2_set} AS s ON s.holding_id = h.holding_id AND s.period_id = h.period_id")
def agg_05(fr):
    a = assessment(fr)
    return a.held_dates.join(a.priced_sets.select("holding_id", "period_id", "priced_classes"), ["holding_id", "period_id"], "left").select(
        "holding_id", "period_id", F.concat_ws(",", F.array_sort("held_classes")).alias("held"), F.concat_ws(",", F.array_sort("priced_classes")).alias("priced"))


@query("agg_06", """SELECT holding_id, period_id, priced_class, count(DISTINCT price_per_share) AS prices FROM {o_r2_claim} WHERE priced_class IS NOT NULL AND price_per_share IS NOT NULL GROUP BY ALL HAVING count(DISTINCT price_per_share) > 1""")
def agg_06(fr):
    a = assessment(fr)
    priced = a.relied.filter("requirement = 'R2' AND priced_class IS NOT NULL AND price_per_share IS NOT NULL").join(a.held_dates.select("holding_id", "period_id"), ["holding_id", "period_id"], "left_semi")
    return priced.groupBy("holding_id", "period_id", "priced_class").agg(F.countDistinct("price_per_share").alias("prices")).filter("prices > 1")


@query("agg_07", """SELECT holding_id, requirement, CASE min(ord) WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' WHEN 3 THEN 'sufficient' END AS worst, CASE max(ord) WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' WHEN 3 THEN 'sufficient' END AS best
 FROM {f_assessment} AS a JOIN {o_rank} AS r ON r.verdict = a.verdict GROUP BY 1, 2""")
def agg_07(fr):
    return rules.best_and_worst(fr["f_assessment"], ["holding_id", "requirement"])


@query("agg_08", """SELECT a.holding_id, a.period_id, CASE WHEN bool_or(x.holding_id IS NOT NULL) THEN 'conflicting' ELSE CASE max(a.ord) WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' ELSE 'sufficient' END END AS verdict
 FROM {o_r2_claim} AS a LEFT JOIN {o_clash} AS x ON x.holding_id = a.holding_id AND x.period_id = a.period_id GROUP BY 1, 2""")
def agg_08(fr):
    a = assessment(fr)
    links = a.by_class("R2").join(a.held_dates.select("holding_id", "period_id"), ["holding_id", "period_id"], "left_semi")
    return rules.reduce_links(links, ["holding_id", "period_id"])


@query("agg_09", """SELECT holding_id, period_id, CASE WHEN count(ord) = 0 THEN 'not_applicable' ELSE CASE min(ord) WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' ELSE 'sufficient' END END AS verdict
 FROM {f_assessment} AS a LEFT JOIN {o_rank} AS r ON r.verdict = a.verdict GROUP BY 1, 2""")
def agg_09(fr):
    return rules.reduce_rows(fr["f_assessment"], ["holding_id", "period_id"])


@query("agg_10", """SELECT claim_id, count(*) AS fields, max(n) > 1 AS ambiguous, string_agg(field_name || '=' || CAST(v AS VARCHAR), ';' ORDER BY field_name) AS facts FROM (
 SELECT claim_id, field_name, count(DISTINCT value_numeric) AS n, max(value_numeric) AS v FROM {f_fact} WHERE value_numeric IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def agg_10(fr):
    folded = citing.fact_map(fr["f_fact"])
    return folded.select("claim_id", F.size("facts").cast("bigint").alias("fields"), "ambiguous",
                         F.concat_ws(";", F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))))).alias("facts"))


@query("agg_11", """SELECT c.claim_id, max(TRY_CAST(value_text AS DATE)) FILTER (field_name = 'fx_rate_effective_date') AS fx_rate_effective_date, max(value_text) FILTER (field_name = 'currency_pair') AS currency_pair,
 count(*) FILTER (field_name = 'fx_rate_effective_date' AND TRY_CAST(value_text AS DATE) IS NULL) AS unreadable FROM {f_fact} AS c WHERE field_name IN ('fx_rate_effective_date', 'currency_pair') GROUP BY 1""", text="fx_rate_effective_date")
def agg_11(fr):
    return citing.dated_facts(fr["f_fact"])


LIBRARY["o_approval"] = """
SELECT d.mark_id, d.decision_id, d.status, d.actor_id, d.decided_at, coalesce(b.n, 0) AS bound, d.status = 'approved' AND coalesce(b.n, 0) > 0 AS approved FROM {o_valuation_decision} AS d
LEFT JOIN (SELECT decision_id, count(*) AS n FROM {f_decision_evidence} GROUP BY 1) AS b ON b.decision_id = d.decision_id"""
LIBRARY["o_packet"] = """
SELECT r.*, h.company_name, h.position_type, r.unsupported = '' AS supported, coalesce(a.approved, false) AS approved, a.decision_id, a.status AS decision_status, a.actor_id, a.decided_at, coalesce(g.n, 0) AS gaps
FROM {o_row} AS r JOIN {f_holding} AS h ON h.holding_id = r.holding_id LEFT JOIN {o_approval} AS a ON a.mark_id = r.mark_id
LEFT JOIN (SELECT holding_id, count(*) AS n FROM {f_gap} GROUP BY 1) AS g ON g.holding_id = r.holding_id"""
LIBRARY["o_held_total"] = """
SELECT fund_id, period_id, CASE WHEN n <= 1 THEN amount END AS amount, CASE WHEN n <= 1 THEN unsupported_amount END AS unsupported_amount, n AS currencies, positions_held, unsupported_positions, packet_gap_positions, packet_gap_positions - unsupported_positions AS unheld_gap_positions FROM (
 SELECT fund_id, period_id, count(DISTINCT reported_currency) FILTER (held AND reported_amount IS NOT NULL) AS n, CAST(coalesce(sum(reported_amount) FILTER (held), 0) AS DECIMAL(34,4)) AS amount,
  CAST(coalesce(sum(reported_amount) FILTER (held AND NOT supported), 0) AS DECIMAL(34,4)) AS unsupported_amount, count(*) FILTER (held) AS positions_held, count(*) FILTER (held AND NOT supported) AS unsupported_positions, count(*) FILTER (NOT supported) AS packet_gap_positions FROM {o_packet} GROUP BY 1, 2)"""
# The test fund mixes USD and EUR positions, so the total per currency is the usable one.
LIBRARY["o_currency_total"] = """
SELECT p.fund_id, p.period_id, h.currency, 'held_at_date_reported' AS kind, CAST(coalesce(sum(reported_amount) FILTER (held), 0) AS DECIMAL(34,4)) AS amount, CAST(coalesce(sum(reported_amount) FILTER (held AND NOT supported), 0) AS DECIMAL(34,4)) AS unsupported_amount,
 count(*) FILTER (held) AS positions_held, count(*) FILTER (held AND NOT supported) AS unsupported_positions, count(*) FILTER (NOT supported) AS packet_gap_positions, count(*) FILTER (NOT supported AND NOT held) AS unheld_gap_positions
FROM {o_packet} AS p JOIN {f_holding} AS h ON h.holding_id = p.holding_id GROUP BY ALL"""


@query("agg_12", "SELECT * FROM {o_currency_total}", text="amount unsupported_amount")
def agg_12(fr):
    a = assessment(fr)
    rows = a.rows.join(a.ledger.holding.select("holding_id", "currency"), "holding_id")
    return totals.held_totals(rows, ["fund_id", "period_id", "currency"]).drop("currencies")


@query("agg_12_mixed", "SELECT * FROM {o_held_total}", text="amount unsupported_amount")
def agg_12_mixed(fr):
    return totals.held_totals(assessment(fr).rows, ["fund_id", "period_id"]).drop("kind")


@query("agg_13", """SELECT fund_id, period_id, CAST(coalesce(sum(reported_amount) FILTER (approved AND held), 0) AS DECIMAL(34,4)) AS approved_amount, CAST(coalesce(sum(reported_amount) FILTER (approved AND held AND NOT supported), 0) AS DECIMAL(34,4)) AS unsupported_amount,
 count(*) FILTER (approved AND held AND reported_amount IS NOT NULL AND NOT supported) AS unsupported_positions, count(*) FILTER (approved AND held AND reported_amount IS NOT NULL AND NOT supported) = 0 AS usable FROM {o_packet} GROUP BY 1, 2""", text="approved_amount unsupported_amount")
def agg_13(fr):
    return totals.approved_totals(packets.packet_rows(assessment(fr)), ["fund_id", "period_id"])


LIBRARY["o_tracker_total"] = f"""
SELECT d.fund_id, d.period_id, CAST({cell_number('g.cell')} AS DECIMAL(34,4)) AS tracker_total FROM {{o_grid_long}} AS g JOIN {{f_fund}} AS f ON f.fund_label = g.sheet JOIN {{o_date}} AS d ON d.fund_id = f.fund_id AND d.label = g.label WHERE g.company = 'TOTAL'"""


@query("agg_14", """SELECT t.*, k.tracker_total, CAST(t.reported_total - k.tracker_total AS DECIMAL(35,4)) AS delta, CASE WHEN unsupported_rows > 0 THEN 'unsupported_rows' WHEN underived_rows > 0 THEN 'validated_amount_not_derivable' WHEN mismatched_rows > 0 THEN 'validated_reported_mismatch' WHEN unapproved_rows > 0 THEN 'no_valuation_approval' END AS blocked_by,
 CAST(NULL AS VARCHAR) AS approved_total FROM (
 SELECT v.fund_id, v.period_id, count(*) AS positions_held, CAST(sum(coalesce(v.reported_amount, 0)) AS DECIMAL(34,4)) AS reported_total, CAST(coalesce(sum(v.reported_amount) FILTER (NOT fully_supported), 0) AS DECIMAL(34,4)) AS unsupported_subtotal,
  count(*) FILTER (NOT fully_supported) AS unsupported_rows, count(*) FILTER (d.derived IS NULL OR d.reason = 'MANAGEMENT_CARRYING_VALUE') AS underived_rows,
  count(*) FILTER (d.derived IS NOT NULL AND d.reason <> 'MANAGEMENT_CARRYING_VALUE' AND d.derived <> v.reported_amount) AS mismatched_rows, count(*) FILTER (NOT approved) AS unapproved_rows
 FROM {o_packet} AS v LEFT JOIN {o_derived} AS d ON d.holding_id = v.holding_id AND d.period_id = v.period_id WHERE held GROUP BY 1, 2) AS t
 LEFT JOIN {o_tracker_total} AS k ON k.fund_id = t.fund_id AND k.period_id = t.period_id""", text="reported_total unsupported_subtotal tracker_total delta")
def agg_14(fr):
    return packets.period_totals(assessment(fr), tracker_totals(fr))


def tracker_totals(fr):
    stated = workbook.unpivot_grid(workbook.total_rows(fr["f_grid"])).filter("amount IS NOT NULL")
    periods = temporal.packet_sequence(fr["f_period"]).join(fr["f_fund"].select("fund_id", F.col("fund_label").alias("sheet")), "fund_id")
    return stated.join(periods, ["sheet", "label"]).select("fund_id", "period_id", F.col("amount").cast("decimal(34,4)").alias("tracker_total"))


@query("agg_15", """SELECT d.fund_id, d.period_id, d.label, s.positions, s.fully_supported, s.open_gap_positions, s.pro_forma_positions, s.held_at_date, s.not_held_at_date, CASE WHEN s.positions IS NULL THEN 'a listed fund-period without a single position' END AS absent_reason FROM (
  SELECT fund_id, period_id, label FROM {o_date} UNION ALL SELECT fund_id, fund_id || '_planned', 'planned' FROM {f_fund}) AS d LEFT JOIN (
 SELECT fund_id, period_id, count(*) AS positions, count(*) FILTER (supported) AS fully_supported, count(*) FILTER (NOT supported) AS open_gap_positions, count(*) FILTER (pro_forma) AS pro_forma_positions, count(*) FILTER (held) AS held_at_date, count(*) FILTER (NOT held) AS not_held_at_date FROM {o_packet} GROUP BY 1, 2) AS s USING (fund_id, period_id)""")
def agg_15(fr):
    a = assessment(fr)
    planned = fr["f_fund"].select("fund_id", F.concat("fund_id", F.lit("_planned")).alias("period_id"), F.lit("planned").alias("label"))
    return packets.scorecard(a.rows, a.periods.select("fund_id", "period_id", "label").unionByName(planned))


@query("agg_16", """SELECT fund_id, period_id, count(*) AS positions, count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS unheld, count(mark_id) AS marked, count(*) FILTER (supported) AS supported, count(*) FILTER (approved) AS approved, CAST(sum(gaps) AS BIGINT) AS gap_observations FROM {o_packet} GROUP BY 1, 2""")
def agg_16(fr):
    return packets.packet_counts(packets.packet_rows(assessment(fr)))


@query("agg_18", """SELECT fund_id, period_id, outcome, count(*) AS positions FROM (SELECT m.fund_id, m.period_id, coalesce(c.outcome, 'not_applicable') AS outcome FROM {o_member} AS m LEFT JOIN {o_compared} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id) GROUP BY ALL""")
def agg_18(fr):
    return packets.recomputations(assessment(fr)).groupBy("fund_id", "period_id", "outcome").agg(F.count("*").alias("positions"))


@query("agg_19", """SELECT h.holding_id, coalesce(c.documents, 0) AS documents, coalesce(c.claims, 0) AS claims, coalesce(f.facts, 0) AS facts, coalesce(f.failing, 0) AS failing_citations, coalesce(p.n, 0) AS appearances FROM {f_holding} AS h
 LEFT JOIN (SELECT holding_id, count(DISTINCT document_no) AS documents, count(*) AS claims FROM {f_claim} GROUP BY 1) AS c ON c.holding_id = h.holding_id
 LEFT JOIN (SELECT f.holding_id, count(*) AS facts, count(*) FILTER (NOT (span_end <= length(canonical_text) AND substr(canonical_text, CAST(span_start AS INT) + 1, CAST(span_end - span_start AS INT)) = quote)) AS failing FROM {f_fact} AS f JOIN {f_statement} AS s ON s.claim_id = f.claim_id GROUP BY 1) AS f ON f.holding_id = h.holding_id
 LEFT JOIN (SELECT holding_id, count(*) AS n FROM {o_member} GROUP BY 1) AS p ON p.holding_id = h.holding_id""")
def agg_19(fr):
    a = assessment(fr)
    claims = a.ledger.claim.groupBy("holding_id").agg(F.countDistinct("document_no").alias("documents"), F.count("*").alias("claims"))
    bound = citing.bind_facts(fr["f_fact"], fr["f_statement"])
    facts = bound.groupBy("holding_id").agg(F.count("*").alias("facts"), F.count_if(F.array_contains("violations", "span_does_not_resolve")).alias("failing_citations"))
    seen = a.members.groupBy("holding_id").agg(F.count("*").alias("appearances"))
    out = a.ledger.holding.select("holding_id").join(claims, "holding_id", "left").join(facts, "holding_id", "left").join(seen, "holding_id", "left")
    return out.select("holding_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "claims", "facts", "failing_citations", "appearances")])


@query("agg_20", """SELECT (SELECT count(*) FROM {f_document}) AS documents, (SELECT CAST(sum(length(canonical_text)) AS BIGINT) FROM {f_document}) AS characters, (SELECT count(*) FROM {f_claim}) AS claims, (SELECT count(*) FROM {f_fact}) AS facts, (SELECT count(*) FROM {f_holding}) AS holdings""")
def agg_20(fr):
    docs = fr["f_document"].agg(F.count("*").alias("documents"), F.sum(F.length("canonical_text")).alias("characters"))
    one = lambda name, alias: fr[name].agg(F.count("*").alias(alias))
    return docs.crossJoin(one("f_claim", "claims")).crossJoin(one("f_fact", "facts")).crossJoin(one("f_holding", "holdings"))


@query("agg_21", "SELECT count(*) AS marks, count(basis) AS marks_with_basis, count(DISTINCT CASE WHEN basis IS NOT NULL THEN holding_id END) AS holdings_stating_basis FROM {f_mark}")
def agg_21(fr):
    return fr["f_mark"].agg(F.count("*").alias("marks"), F.count("basis").alias("marks_with_basis"),
                            F.countDistinct(F.when(F.col("basis").isNotNull(), F.col("holding_id"))).alias("holdings_stating_basis"))


@query("pkt_01", "SELECT holding_id, period_id, held, realised, mark_id, reported_amount FROM {o_member}", text="reported_amount")
def pkt_01(fr):
    return assessment(fr).members.select("holding_id", "period_id", "held", "realised", "mark_id", "reported_amount")


LIBRARY["o_texts"] = """
SELECT *, CASE WHEN mark_id IS NOT NULL THEN 'revision ' || CAST(revision AS VARCHAR) || ' (mark ' || mark_id || ')' WHEN NOT held THEN 'unmarked, not held on ' || CAST(period_date AS VARCHAR) ELSE 'unmarked on ' || CAST(period_date AS VARCHAR) END AS mark_state,
 CASE WHEN supported THEN 'supported' WHEN NOT held AND unsupported = 'R4 not assessed' THEN 'not held then: ' || unsupported ELSE 'not supported: ' || replace(unsupported, ';', '; ') END AS evidence_support,
 CASE WHEN decision_id IS NULL THEN 'nothing on record' WHEN approved THEN 'approved by ' || actor_id || ' on ' || strftime(decided_at, '%Y-%m-%d %H:%M:%S') ELSE 'valuation ' || decision_status || ' (no approval)' END AS valuation_approval FROM {o_packet}"""


@query("pkt_02", """SELECT t.fund_id, t.period_id, company_name, t.holding_id, position_type, CASE WHEN held THEN 'yes' ELSE 'no' END AS held, mark_state, reported_amount, t.reported_currency, CASE WHEN c.derived IS NOT NULL THEN 'derivable' ELSE 'not_derivable' END AS derivation_status,
 coalesce(c.reason, 'NOT_HELD_AT_MEASUREMENT_DATE') AS derivation_reason, evidence_support, r1, r2, r3, r4, r5, gaps, valuation_approval FROM {o_texts} AS t LEFT JOIN {o_compared} AS c ON c.holding_id = t.holding_id AND c.period_id = t.period_id""", text="reported_amount")
def pkt_02(fr):
    return packets.holdings_table(assessment(fr))


@query("pkt_03", """SELECT m.fund_id, m.period_id, CAST(CASE coalesce(c.outcome, 'not_applicable') WHEN 'fail' THEN 0 WHEN 'not_comparable' THEN 1 WHEN 'blocked_incomplete' THEN 2 WHEN 'unconfirmable' THEN 3 WHEN 'pass' THEN 4 ELSE 5 END AS INT) AS reading_order, h.company_name, m.holding_id,
 coalesce(c.outcome, 'not_applicable') AS outcome, c.derived, c.difference, nullif(c.evidence, '') IS NOT NULL AS cited FROM {o_member} AS m JOIN {f_holding} AS h ON h.holding_id = m.holding_id LEFT JOIN {o_compared} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id""", text="derived difference")
def pkt_03(fr):
    return packets.recomputation_table(assessment(fr)).select("fund_id", "period_id", "reading_order", "company_name", "holding_id", "outcome", "derived", "difference", F.col("evidence").isNotNull().alias("cited"))


@query("win_12", """SELECT m.holding_id, m.period_id, row_number() OVER (PARTITION BY m.fund_id, m.period_id ORDER BY CASE coalesce(c.outcome, 'not_applicable') WHEN 'fail' THEN 0 WHEN 'not_comparable' THEN 1 WHEN 'blocked_incomplete' THEN 2 WHEN 'unconfirmable' THEN 3 WHEN 'pass' THEN 4 ELSE 5 END, h.company_name, m.holding_id) AS place
 FROM {o_member} AS m JOIN {f_holding} AS h ON h.holding_id = m.holding_id LEFT JOIN {o_compared} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id""")
def win_12(fr):
    table = packets.recomputation_table(assessment(fr)).select("fund_id", "period_id", "reading_order", "company_name", "holding_id")
    return order.numbered(table, ["fund_id", "period_id"], ["reading_order", "company_name", "holding_id"], "place").select("holding_id", "period_id", "place")


LIBRARY["o_link"] = """
SELECT DISTINCT c.holding_id, c.period_id, 'R1' AS requirement, c.claim_id, c.effective_date > c.period_date AS is_subsequent FROM {o_relied} AS c JOIN {o_lotdate} AS l ON l.holding_id = c.holding_id AND l.period_id = c.period_id AND l.during AND (c.priced_class IS NULL OR c.priced_class = l.held_class) WHERE c.requirement = 'R1'
UNION ALL SELECT holding_id, period_id, 'R2', claim_id, effective_date > period_date FROM {o_r2_claim}
UNION ALL SELECT c.holding_id, c.period_id, 'R4', c.claim_id, c.effective_date > c.period_date FROM {o_relied} AS c WHERE c.requirement = 'R4' AND EXISTS (SELECT 1 FROM {o_lotdate} AS l WHERE l.holding_id = c.holding_id AND l.period_id = c.period_id AND l.realised)"""
LIBRARY["o_outcome"] = """
SELECT holding_id, period_id, requirement, verdict, reasons, next_actions, false AS pro_forma FROM {o_r1} UNION ALL SELECT holding_id, period_id, requirement, verdict, reasons, next_actions, pro_forma FROM {o_r2}
UNION ALL SELECT holding_id, period_id, requirement, verdict, reasons, next_actions, false FROM {o_r3} UNION ALL SELECT holding_id, period_id, requirement, verdict, reasons, next_actions, false FROM {o_r4}
UNION ALL SELECT holding_id, period_id, 'R5', 'sufficient', '', '', false FROM {o_r2} WHERE pro_forma"""
LIBRARY["o_requirement_row"] = """
SELECT m.fund_id, m.period_id, m.holding_id, q.requirement, q.category, coalesce(o.verdict, 'not_applicable') AS verdict, coalesce(o.verdict, 'not_applicable') <> 'not_applicable' AS applicable, coalesce(o.pro_forma, false) AS pro_forma,
 replace(coalesce(o.reasons, ''), ',', '; ') AS reason_codes, replace(coalesce(o.next_actions, ''), ',', '; ') AS next_actions, coalesce(l.n, 0) AS evidence_claims, coalesce(l.later, false) AS includes_subsequent
FROM {o_member} AS m CROSS JOIN (VALUES ('R1', 'existence_and_cost'), ('R2', 'fair_value_support'), ('R3', 'unchanged_mark_calibration'), ('R4', 'realization_support'), ('R5', 'pro_forma_identification')) AS q(requirement, category)
LEFT JOIN {o_outcome} AS o ON o.holding_id = m.holding_id AND o.period_id = m.period_id AND o.requirement = q.requirement
LEFT JOIN (SELECT holding_id, period_id, requirement, count(*) AS n, bool_or(is_subsequent) AS later FROM {o_link} GROUP BY 1, 2, 3) AS l ON l.holding_id = m.holding_id AND l.period_id = m.period_id AND l.requirement = q.requirement"""


@query("pkt_04", "SELECT * FROM {o_requirement_row}")
def pkt_04(fr):
    return packets.requirements_table(assessment(fr))


@query("pkt_04_links", "SELECT * FROM {o_link}")
def pkt_04_links(fr):
    return rules.links(assessment(fr))


@query("pkt_05", """SELECT m.period_id, f.claim_id, f.field_name, f.value_text, f.state, d.filename, coalesce(l.relied, 'not relied on') AS relied_on FROM {f_fact} AS f JOIN {f_claim} AS c ON c.claim_id = f.claim_id JOIN {o_member} AS m ON m.holding_id = c.holding_id
 JOIN {f_document} AS d ON d.document_no = c.document_no LEFT JOIN (SELECT period_id, claim_id, string_agg(requirement, '; ' ORDER BY requirement) AS relied FROM {o_link} GROUP BY 1, 2) AS l ON l.period_id = m.period_id AND l.claim_id = f.claim_id""")
def pkt_05(fr):
    return packets.evidence_index(assessment(fr)).select("period_id", "claim_id", "field_name", "value_text", "state", "filename", "relied_on")


@query("pkt_06", """SELECT t.fund_id, t.period_id, t.holding_id, t.approved, t.evidence_support, d.decision_id, coalesce(d.decision_type || ' ' || d.status || ' by ' || d.actor_id || ' (' || CAST(coalesce(b.n, 0) AS VARCHAR) || ' bound)', 'nothing on record') AS decision
 FROM {o_texts} AS t LEFT JOIN {f_decision} AS d ON d.mark_id = t.mark_id LEFT JOIN (SELECT decision_id, count(*) AS n FROM {f_decision_evidence} GROUP BY 1) AS b ON b.decision_id = d.decision_id""")
def pkt_06(fr):
    return packets.approval_log(assessment(fr)).select("fund_id", "period_id", "holding_id", "approved", "evidence_support", "decision_id", "decision")


LIBRARY["o_gap_report"] = """
SELECT m.fund_id, m.period_id, m.holding_id, 'missing_document' AS finding, g.requirement, g.kind, 'open' AS remediation, g.missing_document AS basis FROM {o_member} AS m JOIN {f_gap} AS g ON g.holding_id = m.holding_id
UNION ALL SELECT fund_id, period_id, holding_id, CASE WHEN NOT held AND u = 'R4 not assessed' THEN 'requirement_not_applicable' ELSE 'unsupported_requirement' END, substr(u, 1, 2), substr(u, 4), CASE WHEN NOT held AND u = 'R4 not assessed' THEN 'not_applicable' ELSE 'open' END,
 CASE WHEN NOT held AND u = 'R4 not assessed' THEN 'not in the portfolio on ' || CAST(period_date AS VARCHAR) END FROM (SELECT *, unnest(string_split(unsupported, ';')) AS u FROM {o_packet} WHERE unsupported <> '')
UNION ALL SELECT fund_id, period_id, holding_id, 'no_mark_at_this_date', NULL, CASE WHEN held THEN 'held_without_a_mark' ELSE 'not_held' END, 'open', mark_state FROM {o_texts} WHERE mark_id IS NULL
UNION ALL SELECT fund_id, period_id, holding_id, 'no_valuation_approval', NULL, 'open', 'open', valuation_approval FROM {o_texts} WHERE NOT approved
UNION ALL SELECT fund_id, period_id, holding_id, 'no_source_documents', NULL, 'not_located', 'open', 'no file is kept for this position' FROM {o_member} AS m WHERE NOT EXISTS (SELECT 1 FROM {f_claim} AS c WHERE c.holding_id = m.holding_id)"""


@query("pkt_07", "SELECT * FROM {o_gap_report}")
def pkt_07(fr):
    return packets.gap_report(assessment(fr))


LIBRARY["o_cover"] = """
SELECT c.fund_id, c.period_id, c.positions, c.held, c.unheld, c.marked, c.supported, c.approved, c.gap_observations, t.amount, t.unsupported_amount, t.unsupported_positions, t.unheld_gap_positions,
 concat_ws(' ', CASE WHEN c.approved = 0 THEN 'Not one position here has an approved valuation on record (0 of ' || c.positions || ').' ELSE c.approved || ' of ' || c.positions || ' positions have an approved valuation on record.' END,
  CASE WHEN t.unsupported_positions > 0 THEN CAST(t.unsupported_amount AS VARCHAR) || ' of the ' || CAST(t.amount AS VARCHAR) || ' held_at_date_reported total, from ' || t.unsupported_positions || ' of ' || c.held || ' positions held, lacks support.'
   ELSE 'Nothing held lacks evidence for a request that applies to it.' END) AS statement
FROM (SELECT fund_id, period_id, count(*) AS positions, count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS unheld, count(mark_id) AS marked, count(*) FILTER (supported) AS supported, count(*) FILTER (approved) AS approved, CAST(sum(gaps) AS BIGINT) AS gap_observations FROM {o_packet} GROUP BY 1, 2) AS c
JOIN {o_held_total} AS t ON t.fund_id = c.fund_id AND t.period_id = c.period_id"""


@query("pkt_08", """SELECT fund_id, period_id, item, value FROM (SELECT fund_id, period_id, unnest(['positions', 'held', 'unheld', 'marked', 'supported', 'approved', 'gap_observations', 'amount', 'unsupported_amount', 'unsupported_positions', 'unheld_gap_positions', 'statement']) AS item,
 unnest([CAST(positions AS VARCHAR), CAST(held AS VARCHAR), CAST(unheld AS VARCHAR), CAST(marked AS VARCHAR), CAST(supported AS VARCHAR), CAST(approved AS VARCHAR), CAST(gap_observations AS VARCHAR), CAST(amount AS VARCHAR), CAST(unsupported_amount AS VARCHAR), CAST(unsupported_positions AS VARCHAR), CAST(unheld_gap_positions AS VARCHAR), statement]) AS value FROM {o_cover})""")
def pkt_08(fr):
    return packets.cover(assessment(fr))


@query("pkt_09", "SELECT DISTINCT m.fund_id, m.period_id, d.document_id FROM {o_member} AS m JOIN {f_claim} AS c ON c.holding_id = m.holding_id JOIN {f_document} AS d ON d.document_no = c.document_no")
def pkt_09(fr):
    return packets.evidence_documents(assessment(fr))


@query("pkt_09_claims", "SELECT DISTINCT m.fund_id, m.period_id, c.claim_id, c.document_no, c.source_class FROM {o_member} AS m JOIN {f_claim} AS c ON c.holding_id = m.holding_id")
def pkt_09_claims(fr):
    return packets.evidence_bundle(assessment(fr))["claim"].select("fund_id", "period_id", "claim_id", "document_no", "source_class")


@query("pkt_09_facts", "SELECT m.period_id, f.claim_id, f.field_name, f.value_text, f.span_start FROM {o_member} AS m JOIN {f_claim} AS c ON c.holding_id = m.holding_id JOIN {f_fact} AS f ON f.claim_id = c.claim_id")
def pkt_09_facts(fr):
    return packets.evidence_bundle(assessment(fr))["fact"].select("period_id", "claim_id", "field_name", "value_text", "span_start")


@query("pkt_09_decisions", """SELECT m.fund_id, m.period_id, d.decision_id, d.decision_type, m.revision, (SELECT count(*) FROM {f_decision_evidence} AS e WHERE e.decision_id = d.decision_id) AS bound FROM {f_decision} AS d JOIN {f_mark} AS m ON m.mark_id = d.mark_id JOIN {o_date} AS p ON p.period_id = m.period_id""")
def pkt_09_decisions(fr):
    return packets.evidence_bundle(assessment(fr))["decision"].select("fund_id", "period_id", "decision_id", "decision_type", "revision", "bound")


LIBRARY["o_requests_json"] = "'[' || concat_ws(',', " + ", ".join(f"""'{{"requirement":"{r}","verdict":"' || {r.lower()} || '","applicable":' || CASE WHEN {r.lower()} = 'not_applicable' THEN 'false' ELSE 'true' END || '}}'""" for r in model.REQUESTS) + ") || ']'"


@query("pkt_10", f"""SELECT holding_id, period_id, '{{{{"approved":' || CAST(approved AS VARCHAR) || ',"assessments":' || {LIBRARY.pop("o_requests_json").replace("{", "{{").replace("}", "}}")} || ',"held":' || CAST(held AS VARCHAR) || ',"holding":"' || holding_id || '"' || CASE WHEN reported_amount IS NULL THEN '' ELSE ',"reported":"' || CAST(reported_amount AS VARCHAR) || '"' END || ',"row_verdict":"' || row_verdict || '","supported":' || CAST(supported AS VARCHAR)
 || ',"unsupported_reasons":{{{{' || CASE WHEN unsupported = '' THEN '' ELSE array_to_string([ '"' || substr(u, 1, 2) || '":"' || substr(u, 4) || '"' for u in list_sort(string_split(unsupported, ';'))], ',') END || '}}}}}}}}' AS json FROM {{o_packet}}""".replace("{{", "{").replace("}}", "}"))
def pkt_10(fr):
    return packets.row_json(assessment(fr))


@query("pkt_10_recomputation", """SELECT m.fund_id, m.holding_id, m.period_id, CAST(json_object('derived', CAST(c.derived AS VARCHAR), 'difference', CAST(c.difference AS VARCHAR), 'holding', m.holding_id, 'outcome', coalesce(c.outcome, 'not_applicable'), 'policy_version', 'policy-1',
  'reason', coalesce(c.reason, 'NOT_HELD_AT_MEASUREMENT_DATE'), 'reported', CAST(CAST(m.reported_amount AS DECIMAL(38,6)) AS VARCHAR)) AS VARCHAR) AS json FROM {o_member} AS m LEFT JOIN {o_compared} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id""")
def pkt_10_recomputation(fr):
    return packets.recomputation_json(assessment(fr), "policy-1")


@query("pkt_10_totals", "SELECT fund_id, period_id, held_total, approved_total FROM {o_totals_json}")
def pkt_10_totals(fr):
    return packets.totals_json(assessment(fr))


@query("pkt_11", "SELECT audit_scope, count(*) AS transitions, count(*) FILTER (reported_amount <> previous_amount) AS changed FROM {o_prev} GROUP BY 1")
def pkt_11(fr):
    return temporal.change_view(fr["f_mark"]).groupBy("audit_scope").agg(F.count("*").alias("transitions"), F.count_if("changed").alias("changed"))


MEANING = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in packets.GLOSSARY.items()) + " END"
#: Reasons and steps whose meaning is known here; one of them speaks of a verdict, so only rows of that verdict get it.
CODE_MEANINGS = {"NO_DOCUMENT_AND_NO_GAP_RECORDED": "Nothing is on file, the request is missing its document.", "REQUEST_FROM_COMPANY": "Ask the company for it."}
LIBRARY["o_kind"] = """
SELECT l.holding_id, l.period_id, l.requirement, c.source_class, c.execution_status, count(*) AS claims, min(c.issued_date) AS low, max(c.issued_date) AS high FROM {o_link} AS l JOIN {f_claim} AS c ON c.claim_id = l.claim_id GROUP BY ALL"""
LIBRARY["o_kinds"] = """
SELECT holding_id, period_id, requirement, '[' || string_agg('{"source_class":"' || source_class || '"' || CASE WHEN execution_status = 'not_applicable' THEN '' ELSE ',"execution_status":"' || execution_status || '"' END || ',"claims":' || claims || ',"first_issued":"' || low || '","last_issued":"' || high || '"}',
 ',' ORDER BY source_class, nullif(execution_status, 'not_applicable') NULLS FIRST, claims, low, high) || ']' AS evidence FROM {o_kind} GROUP BY 1, 2, 3"""
LIBRARY["o_owing"] = "SELECT holding_id, period_id, list(DISTINCT requirement) AS owing FROM {o_outcome} WHERE next_actions <> '' GROUP BY 1, 2"


@query("pkt_12", f"""SELECT o.holding_id, o.period_id, o.requirement, '{{' || concat_ws(',', '"company":"' || h.company_name || '"', '"evidence":' || k.evidence, '"measurement_date":"' || d.period_date || '"',
 CASE WHEN next_actions <> '' THEN '"not_yet_done":[' || array_to_string(['{{"code":"' || a || '"' || CASE WHEN a = 'REQUEST_FROM_COMPANY' THEN ',"meaning":"Ask the company for it."' ELSE '' END || '}}' for a in string_split(next_actions, ',')], ',') || ']' END,
 CASE WHEN len(list_filter(w.owing, lambda x: x <> o.requirement)) > 0 THEN '"other_requests_with_open_steps":["' || array_to_string(list_sort(list_filter(w.owing, lambda x: x <> o.requirement)), '","') || '"]' END,
 CASE WHEN reasons <> '' THEN '"reasons":[' || array_to_string(['{{"code":"' || r || '"' || CASE WHEN r = 'NO_DOCUMENT_AND_NO_GAP_RECORDED' AND verdict = 'missing' THEN ',"meaning":"Nothing is on file, the request is missing its document."' ELSE '' END || '}}' for r in string_split(reasons, ',')], ',') || ']' END,
 '"request":"' || o.requirement || '"', '"request_means":"' || {MEANING('o.requirement')} || '"', '"verdict":"' || verdict || '"', '"verdict_means":"' || {MEANING('verdict')} || '"') || '}}' AS payload
 FROM {{o_outcome}} AS o JOIN {{f_holding}} AS h ON h.holding_id = o.holding_id JOIN {{o_date}} AS d ON d.period_id = o.period_id LEFT JOIN {{o_kinds}} AS k ON k.holding_id = o.holding_id AND k.period_id = o.period_id AND k.requirement = o.requirement
 LEFT JOIN {{o_owing}} AS w ON w.holding_id = o.holding_id AND w.period_id = o.period_id WHERE verdict <> 'not_applicable'""")
def pkt_12(fr):
    return packets.row_payload(assessment(fr), packets.GLOSSARY | CODE_MEANINGS)


@query("pkt_13", "SELECT c.claim_id, c.source_class, f.field_name, f.value_text, f.span_start FROM {f_claim} AS c LEFT JOIN {f_fact} AS f ON f.claim_id = c.claim_id WHERE c.holding_id = 'h1'")
def pkt_13(fr):
    return packets.holding_file(assessment(fr), "h1").select("claim_id", "source_class", "field_name", "value_text", "span_start")


@query("pkt_14", "SELECT document_id, filename, extractor, sha256(extractor || chr(0) || canonical_text) AS text_hash, length(canonical_text) AS text_length, canonical_text FROM {f_document} WHERE document_id = 'd3'")
def pkt_14(fr):
    return packets.document_file(fr["f_document"], "d3")


@query("pkt_15", """SELECT c.fund_id, c.period_id, 'Packet ' || c.period_id || ' of ' || c.fund_id || ': ' || positions || ' positions, ' || held || ' held. ' || statement AS readme, t.held_total, t.approved_total FROM {o_cover} AS c JOIN {o_totals_json} AS t ON t.fund_id = c.fund_id AND t.period_id = c.period_id""")
def pkt_15(fr):
    """The text and the totals beside it come from the same counts."""
    a = assessment(fr)
    rows = packets.packet_rows(a)
    held = totals.held_totals(rows, ["fund_id", "period_id"]).drop("positions_held", "currencies", "kind")
    tally = packets.statement(packets.packet_counts(rows).join(held, ["fund_id", "period_id"]))
    return tally.join(packets.totals_json(a), ["fund_id", "period_id"]).select("fund_id", "period_id", F.concat(
        F.lit("Packet "), "period_id", F.lit(" of "), "fund_id", F.lit(": "), F.col("positions").cast("string"), F.lit(" positions, "),
        F.col("held").cast("string"), F.lit(" held. "), "statement").alias("readme"), "held_total", "approved_total")


@query("pkt_16", "SELECT f.fund_id, f.legal_name, d.period_id, d.label, t.positions_held FROM {f_fund} AS f JOIN {o_date} AS d ON d.fund_id = f.fund_id LEFT JOIN {o_held_total} AS t ON t.fund_id = d.fund_id AND t.period_id = d.period_id")
def pkt_16(fr):
    a = assessment(fr)
    lines = fr["f_fund"].select("fund_id", "legal_name").join(a.periods.select("fund_id", "period_id", "label"), "fund_id")
    held = a.members.groupBy("fund_id", "period_id").agg(F.count_if("held").alias("positions_held"))
    return lines.join(held, ["fund_id", "period_id"], "left")
