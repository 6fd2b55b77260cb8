"""FLT, JN, WIN and SET: what was held when, as-of joins, latest rows, and set algebra on classes."""

from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import joins, order, retrieval, rules, temporal
from attestor.sources.ledger import from_derived
from catalogue import LIBRARY, query
from catalogue.rules import assessment
from catalogue.scalars import FUND_SQL, cell_number, range_sql


@query("flt_01", "SELECT holding_id, period_id, count(*) AS held_lots FROM {o_lotdate} WHERE held GROUP BY 1, 2")
def flt_01(fr):
    return assessment(fr).lots.filter(temporal.held_at(F.col("period_date"))).groupBy("holding_id", "period_id").agg(F.count("*").alias("held_lots"))


@query("flt_02", "SELECT lot_id, period_id FROM {o_lotdate} WHERE during")
def flt_02(fr):
    return assessment(fr).lots.filter(temporal.held_during_year(F.col("period_date"))).select("lot_id", "period_id")


LIBRARY["o_tranche"] = f"""
SELECT s.fund_label AS fund, r.company, r.title, r.row_no, r.c0 AS kind, r.amount AS investment, r.price AS share_price, r.shares AS share_count, r.c5 AS acquired_text, r.lo, r.hi,
 regexp_matches(trim(r.c0), '(?i)^(exit|realis|realiz|distrib)') AS is_exit,
 regexp_matches(r.c0, '(?i)\\bfund\\b') AND NOT regexp_matches(trim(r.c0), '(?i)^(exit|realis|realiz|distrib)') AS is_investment
FROM (SELECT *, {cell_number('c1')} AS amount, {cell_number('c3')} AS price, {cell_number('c4')} AS shares, {range_sql('t', 'lo')} AS lo, {range_sql('t', 'hi')} AS hi FROM {{o_rows}}) AS r
JOIN {{f_fund}} AS s ON s.fund_id = 'fund_' || CAST(r.sheet_no // 100000000 AS VARCHAR) WHERE r.amount IS NOT NULL"""
LIBRARY["o_tranche_date"] = """
SELECT t.*, d.period_end, CASE WHEN t.hi <= d.period_end THEN true WHEN t.lo > d.period_end THEN false END AS by_then
FROM {o_tranche} AS t CROSS JOIN (SELECT DISTINCT period_date AS period_end FROM {f_period} WHERE audit_scope = 'packet') AS d"""


@query("flt_03", """SELECT period_end, count(*) FILTER (by_then) AS yes, count(*) FILTER (NOT by_then) AS no, count(*) FILTER (by_then IS NULL) AS unknown
 FROM {o_tranche_date} GROUP BY 1""", text="period_end")
def flt_03(fr):
    return joins.known_by(joins.tranches(fr), joins.packet_dates(fr), "period_end")


@query("flt_04", """SELECT fund, company, period_end, CASE
 WHEN bool_or(is_exit AND by_then IS NULL) THEN NULL
 WHEN NOT bool_or(NOT is_exit AND coalesce(by_then, false)) THEN CASE WHEN bool_or(NOT is_exit AND by_then IS NULL) THEN NULL ELSE false END
 WHEN NOT bool_or(is_exit AND coalesce(by_then, false)) THEN true
 WHEN bool_or(by_then AND share_count IS NULL) THEN NULL
 ELSE coalesce(sum(share_count) FILTER (is_exit AND by_then), 0) < coalesce(sum(share_count) FILTER (NOT is_exit AND by_then), 0) END AS held
 FROM {o_tranche_date} GROUP BY ALL""", text="period_end")
def flt_04(fr):
    figures = joins.running_at(joins.tranches(fr), ["fund", "company"], joins.packet_dates(fr), "period_end")
    return joins.position_held(figures, ["fund", "company", "period_end"])


@query("flt_05", "SELECT claim_id, period_id FROM {f_claim} JOIN {o_date} USING (fund_id) WHERE applicable_from <= period_date AND (applicable_to IS NULL OR applicable_to >= period_date)")
def flt_05(fr):
    led = from_derived(fr)
    dated = led.claim.join(temporal.packet_sequence(led.period), "fund_id")
    return dated.filter(temporal.window_covers(F.col("period_date"))).select("claim_id", "period_id")


@query("flt_06", "SELECT claim_id, requirement, period_id FROM {o_app}")
def flt_06(fr):
    a = assessment(fr)
    return rules.applicable_claims(a.ledger, a.periods).select("claim_id", "requirement", "period_id")


@query("flt_07", """SELECT DISTINCT c.holding_id, d.period_id FROM {f_claim} AS c JOIN {o_date} AS d ON d.fund_id = c.fund_id WHERE c.r2 AND c.applicable_to < d.period_date""")
def flt_07(fr):
    a = assessment(fr)
    dates = a.ledger.holding.select("holding_id", "fund_id").join(a.periods, "fund_id")
    return dates.join(a.expired, "holding_id").filter("first_closed < period_date").select("holding_id", "period_id")


@query("flt_08", "SELECT lot_id, period_id, realized_date FROM {o_lotdate} WHERE realised", text="realized_date")
def flt_08(fr):
    return assessment(fr).realised_lots.select("lot_id", "period_id", "realized_date")


LIBRARY["o_during_period"] = """
SELECT h.holding_id, p.period_id, count(l.lot_id) = 0 OR bool_or(l.acquired_date <= p.period_date AND (l.realized_date IS NULL OR l.realized_date > coalesce(p.opens, DATE '0001-01-01'))) AS held_during
FROM {f_holding} AS h JOIN (SELECT q.*, (SELECT max(d.period_date) FROM {o_date} AS d WHERE d.fund_id = q.fund_id AND d.period_date < q.period_date) AS opens FROM {f_period} AS q) AS p ON p.fund_id = h.fund_id
LEFT JOIN {f_lot} AS l ON l.holding_id = h.holding_id GROUP BY ALL"""


@query("flt_09", "SELECT * FROM {o_during_period}")
def flt_09(fr):
    return joins.held_during_reported_period(from_derived(fr)).select("holding_id", "period_id", "held_during")


@query("flt_10", "SELECT m.mark_id, m.period_id FROM {f_mark} AS m JOIN {f_period} AS p ON p.period_id = m.period_id WHERE p.audit_scope = 'packet'")
def flt_10(fr):
    led = from_derived(fr)
    return led.mark.join(led.packet_period.select("period_id"), "period_id", "left_semi").select("mark_id", "period_id")


@query("flt_11", """SELECT DISTINCT c.claim_id FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id AND r.requirement = 'R2'
 WHERE c.applicable_from <= DATE '1999-12-31' AND (c.applicable_to IS NULL OR c.applicable_to >= DATE '1999-12-31') AND c.source_class IN ('press', 'company_cap_table')""")
def flt_11(fr):
    import datetime
    return retrieval.candidate_claims(from_derived(fr).claim, on=datetime.date(1999, 12, 31), requirement="R2",
                                      source_classes=("press", "company_cap_table")).select("claim_id")


@query("flt_12", """SELECT fund_id, period_id, count(*) FILTER (held AND mark_id IS NOT NULL) AS inputs, count(*) FILTER (NOT held) AS unheld, count(*) FILTER (held AND mark_id IS NULL) AS unmarked FROM {o_member} GROUP BY 1, 2""")
def flt_12(fr):
    marked = F.col("mark_id").isNotNull()
    return assessment(fr).members.groupBy("fund_id", "period_id").agg(
        F.count_if(F.col("held") & marked).alias("inputs"), F.count_if(~F.col("held")).alias("unheld"), F.count_if(F.col("held") & ~marked).alias("unmarked"))


@query("jn_01", "SELECT lot_id, holding_id, period_id FROM {o_lotdate} WHERE held")
def jn_01(fr):
    return assessment(fr).lots.filter("held").select("lot_id", "holding_id", "period_id")


@query("jn_02", """SELECT holding_id, requirement, period_id, count(*) AS claims FROM {f_claim_requirement} AS r JOIN {f_claim} AS c USING (claim_id, holding_id)
 JOIN {o_date} AS d ON d.fund_id = c.fund_id AND c.applicable_from <= d.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= d.period_date) GROUP BY 1, 2, 3""")
def jn_02(fr):
    led = from_derived(fr)
    return retrieval.claims_in_window(led).groupBy("holding_id", "requirement", "period_id").agg(F.count("*").alias("claims"))


@query("jn_03", "SELECT lot_id, period_id, held_class, held_shares FROM {o_lotdate}", text="held_shares")
def jn_03(fr):
    return assessment(fr).lots.select("lot_id", "period_id", "held_class", "held_shares")


LIBRARY["o_cost_tracker"] = f"""
SELECT sheet, trim(split_part(company, ' (', 1)) AS company, sum({cell_number('cost_cell')}) AS stated, count(*) AS labels FROM {{f_grid}} WHERE company <> 'TOTAL' AND cost_cell IS NOT NULL GROUP BY 1, 2"""
LIBRARY["o_cost_breakdown"] = "SELECT fund, company, sum(investment) AS computed FROM {o_tranche} WHERE is_investment GROUP BY 1, 2"


@query("jn_04", """SELECT coalesce(t.sheet, b.fund) AS fund, coalesce(t.company, b.company) AS company, CAST(t.stated AS DECIMAL(38,6)) AS stated, CAST(b.computed AS DECIMAL(38,6)) AS computed
 FROM {o_cost_tracker} AS t FULL JOIN {o_cost_breakdown} AS b ON b.fund = t.sheet AND b.company = t.company""", text="stated computed")
def jn_04(fr):
    return joins.cost_bases(fr).select("fund", "company", "stated", "computed")


@query("jn_05", """SELECT fund, company, 'tracker_only' AS side FROM (SELECT sheet AS fund, company FROM {o_cost_tracker}) AS t WHERE NOT EXISTS (SELECT 1 FROM {o_cost_breakdown} AS b WHERE b.fund = t.fund AND b.company = t.company)
 UNION ALL SELECT fund, company, 'breakdown_only' FROM {o_cost_breakdown} AS b WHERE NOT EXISTS (SELECT 1 FROM {o_cost_tracker} AS t WHERE b.fund = t.sheet AND b.company = t.company)""")
def jn_05(fr):
    return joins.unmatched(joins.tracker_costs(fr), joins.breakdown_costs(fr), ["fund", "company"], "tracker_only", "breakdown_only").select("fund", "company", "side")


#: Whole names; the sheets of some holdings are renamed, so that several of a fund reduce to one key.
LIBRARY["o_sheet"] = """
SELECT fund_id, CASE WHEN cust_key % 40 = 3 THEN 'Shared Holding (' || company_name || ')' ELSE company_name || ' (' || holding_id || ')' END AS sheet FROM {f_holding}"""


@query("jn_06", "SELECT fund_id, trim(split_part(sheet, ' (', 1)) AS key, count(DISTINCT sheet) AS sheets FROM {o_sheet} GROUP BY 1, 2 HAVING count(DISTINCT sheet) > 1")
def jn_06(fr):
    renamed = F.concat(F.lit("Shared Holding ("), "company_name", F.lit(")"))
    sheet = F.when(F.col("cust_key") % 40 == 3, renamed).otherwise(F.concat("company_name", F.lit(" ("), "holding_id", F.lit(")")))
    rows = fr["f_holding"].select("fund_id", sheet.alias("sheet")).withColumn("key", S.company_key(F.col("sheet")))
    return joins.ambiguous_keys(rows, ["fund_id", "key"], "sheet").select("fund_id", "key", F.col("sources").alias("sheets"))


LIBRARY["o_spoilt"] = """
SELECT c.claim_id, r.requirement, CASE WHEN c.order_key % 1000 = 0 THEN 'rumor' ELSE c.source_class END AS source_class, c.execution_status, c.position_type, c.price_per_share
FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id"""


def spoilt(fr):
    claims = from_derived(fr).claim.withColumn("requirement", F.explode("requirements"))
    return claims.withColumn("source_class", F.when(F.col("order_key") % 1000 == 0, "rumor").otherwise(F.col("source_class")))


@query("jn_07", """SELECT s.requirement, s.source_class, s.execution_status, s.position_type, count(*) AS claims FROM {o_spoilt} AS s WHERE NOT EXISTS (
 SELECT 1 FROM {d_matrix} AS m WHERE m.requirement = s.requirement AND m.source_class = s.source_class AND m.execution_status = s.execution_status AND m.position_type = s.position_type) GROUP BY ALL""")
def jn_07(fr):
    return rules.unlisted_tuples(spoilt(fr))


@query("jn_08", """SELECT c.claim_id, r.requirement, c.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL AS fallback,
 CASE WHEN c.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL THEN m.priceless_verdict ELSE m.verdict END AS verdict,
 CASE WHEN c.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL THEN m.priceless_reason ELSE m.reason_code END AS reason_code
 FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id LEFT JOIN {d_matrix} AS m ON m.requirement = r.requirement AND m.source_class = c.source_class
 AND m.execution_status = c.execution_status AND m.position_type = c.position_type""")
def jn_08(fr):
    claims = from_derived(fr).claim.withColumn("requirement", F.explode("requirements"))
    return rules.matrix_cells(claims).select("claim_id", "requirement", "fallback", "verdict", "reason_code")


@query("jn_09", """SELECT l.lot_id, g.gap_id, g.kind FROM {f_lot} AS l JOIN {f_gap} AS g ON g.holding_id = l.holding_id AND g.requirement = 'R1' AND g.security_class = l.security_class""")
def jn_09(fr):
    return fr["f_lot"].select("lot_id", "holding_id", "security_class").join(
        fr["f_gap"].filter("requirement = 'R1'").select("holding_id", "security_class", "gap_id", "kind"), ["holding_id", "security_class"]).select("lot_id", "gap_id", "kind")


@query("jn_10", """SELECT a.claim_id, a.period_id FROM {o_app} AS a WHERE a.requirement = 'R2' AND EXISTS (SELECT 1 FROM {o_app} AS s WHERE s.requirement = 'R2' AND s.period_id = a.period_id AND s.supersedes_claim_id = a.claim_id)""")
def jn_10(fr):
    a = assessment(fr)
    scoped = rules.applicable_claims(a.ledger, a.periods)
    kept = rules.supersede(scoped).select("claim_id", "requirement", "period_id")
    named = scoped.filter("requirement = 'R2'").join(fr["f_claim"].filter("supersedes_claim_id IS NOT NULL").select(F.col("supersedes_claim_id").alias("claim_id")).distinct(), "claim_id", "left_semi")
    return named.join(kept, ["claim_id", "requirement", "period_id"], "left_anti").select("claim_id", "period_id")


@query("jn_11", "SELECT claim_id FROM {f_claim} AS c WHERE EXISTS (SELECT 1 FROM {f_claim_requirement} AS r WHERE r.claim_id = c.claim_id AND r.requirement = 'R4')")
def jn_11(fr):
    return fr["f_claim"].join(fr["f_claim_requirement"].filter("requirement = 'R4'"), "claim_id", "left_semi").select("claim_id")


@query("jn_12", "SELECT c.claim_id, d.document_id, d.filename FROM {f_claim} AS c JOIN {f_document} AS d ON d.document_no = c.document_no")
def jn_12(fr):
    return joins.claim_documents(from_derived(fr)).select("claim_id", "document_id", "filename")


@query("jn_13", """SELECT h.holding_id, (SELECT max(period_date) FROM {f_period} WHERE audit_scope = 'packet') AS measured, count(l.lot_id) AS lots_before FROM {f_holding} AS h
 LEFT JOIN {f_lot} AS l ON l.holding_id = h.holding_id AND l.acquired_date <= (SELECT max(period_date) FROM {f_period} WHERE audit_scope = 'packet') GROUP BY 1""", text="measured")
def jn_13(fr):
    bounds = fr["f_period"].filter("audit_scope = 'packet'").agg(F.max("period_date").alias("measured"))
    counted = fr["f_lot"].join(F.broadcast(bounds), F.col("acquired_date") <= F.col("measured")).groupBy("holding_id").agg(F.count("*").alias("lots_before"))
    return fr["f_holding"].select("holding_id").crossJoin(F.broadcast(bounds)).join(counted, "holding_id", "left").select(
        "holding_id", "measured", F.coalesce("lots_before", F.lit(0)).alias("lots_before"))


LIBRARY["o_valuation_decision"] = """
SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY mark_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM {f_decision} AS d WHERE decision_type = 'valuation') WHERE rn = 1"""


@query("jn_14", """SELECT m.mark_id, m.holding_id, d.decision_id, d.status, h.company_name FROM {f_latest_mark} AS m JOIN {f_holding} AS h ON h.holding_id = m.holding_id
 LEFT JOIN {o_valuation_decision} AS d ON d.mark_id = m.mark_id WHERE m.audit_scope = 'packet'""")
def jn_14(fr):
    return joins.marks_with_decisions(from_derived(fr)).select("mark_id", "holding_id", "decision_id", "status", "company_name")


@query("jn_15", """SELECT c.claim_id, CASE WHEN c.order_key % 4 = 0 THEN 'not_comparable' ELSE 'comparable' END AS state FROM {f_claim} AS c WHERE c.r2""")
def jn_15(fr):
    claims = fr["f_claim"].filter("r2")
    left = claims.select("claim_id", F.col("holding_id").alias("company"), F.lit("A").alias("round_name"), F.col("issued_date").alias("effective_date"),
                         F.lit("USD").alias("currency"), F.lit("fully_diluted").alias("scope"))
    right = claims.select("claim_id", F.col("holding_id").alias("company"), F.lit("A").alias("round_name"), F.col("issued_date").alias("effective_date"),
                          F.when(F.col("order_key") % 4 == 0, "EUR").otherwise("USD").alias("currency"), F.lit("fully_diluted").alias("scope"))
    return joins.comparable_rounds(left, right).select("claim_id", "state")


@query("jn_16", """SELECT h.holding_id, d.period_id, max(struct_pack(a := c.issued_date, b := c.claim_id)).b AS quote_claim, arg_max(c.price_per_share, struct_pack(a := c.issued_date, b := c.claim_id)) AS close_price
 FROM {f_holding} AS h JOIN {o_date} AS d ON d.fund_id = h.fund_id JOIN {f_claim} AS c ON c.holding_id = h.holding_id AND c.source_class = 'public_market_quote' AND c.price_per_share IS NOT NULL AND c.issued_date <= d.period_date
 WHERE h.position_type = 'public_listed' GROUP BY 1, 2""", text="close_price")
def jn_16(fr):
    a = assessment(fr)
    dates = a.ledger.holding.filter("position_type = 'public_listed'").select("holding_id", "fund_id").join(a.periods, "fund_id")
    quotes = a.ledger.claim.filter("source_class = 'public_market_quote' AND price_per_share IS NOT NULL")
    found = temporal.as_of_latest(dates, quotes, "holding_id", "period_date", "issued_date", "claim_id", ["claim_id", "price_per_share"])
    return found.filter("claim_id IS NOT NULL").select("holding_id", "period_id", F.col("claim_id").alias("quote_claim"), F.col("price_per_share").alias("close_price"))


@query("jn_17", """SELECT c.claim_id, count(f.claim_id) AS facts, coalesce(string_agg(f.field_name || '=' || f.value_text, ';' ORDER BY f.ordinal), '') AS stated
 FROM {f_claim} AS c LEFT JOIN {f_fact} AS f ON f.claim_id = c.claim_id GROUP BY 1""")
def jn_17(fr):
    stated = F.concat_ws(";", F.transform("facts", lambda x: F.concat_ws("=", x.field_name, x.value_text)))
    return joins.claims_with_facts(fr["f_claim"], fr["f_fact"], "ordinal").select("claim_id", F.size("facts").cast("bigint").alias("facts"), stated.alias("stated"))


@query("jn_18", """SELECT period_id, claim_id, effective_date > period_date AS is_subsequent FROM {o_r2_claim}""")
def jn_18(fr):
    a = assessment(fr)
    cited = a.relied.filter("requirement = 'R2'").join(a.held_dates.select("holding_id", "period_id"), ["holding_id", "period_id"], "left_semi")
    return cited.select("period_id", "claim_id", (F.col("effective_date") > F.col("period_date")).alias("is_subsequent"))


@query("win_01", "SELECT holding_id, period_id, mark_id, revision, reported_amount FROM {f_latest_mark}", text="reported_amount")
def win_01(fr):
    marks = fr["f_mark"].select("holding_id", "period_id", "mark_id", "revision", "reported_amount")
    return temporal.latest(marks, ["holding_id", "period_id"], "revision")


@query("win_02", "SELECT mark_id, decision_id, status FROM {o_valuation_decision}")
def win_02(fr):
    decisions = fr["f_decision"].filter("decision_type = 'valuation'").select("mark_id", "decision_id", "decided_at", "status")
    return temporal.latest(decisions, ["mark_id"], "decided_at", "decision_id").select("mark_id", "decision_id", "status")


@query("win_03", "SELECT holding_id, period_id, previous_date, previous_amount FROM {o_prev}", text="previous_date previous_amount")
def win_03(fr):
    return temporal.previous_mark(fr["f_mark"]).select("holding_id", "period_id", "previous_date", "previous_amount")


@query("win_04", """SELECT holding_id, period_id, period_date, audit_scope, reported_amount AS amount, previous_amount, CAST(reported_amount - previous_amount AS DECIMAL(24,4)) AS delta,
 reported_amount <> previous_amount AS changed FROM {o_prev}""", text="period_date amount previous_amount delta")
def win_04(fr):
    return temporal.change_view(fr["f_mark"])


@query("win_05", "SELECT fund_id, period_id, previous_date FROM {o_date}", text="previous_date")
def win_05(fr):
    return temporal.packet_sequence(fr["f_period"]).select("fund_id", "period_id", "previous_date")


LIBRARY["o_follow"] = """
SELECT a.fund, a.company, a.title, a.row_no, NOT coalesce(bool_or(b.lo > a.hi), false) AS candidate, coalesce(bool_or(b.hi < a.lo), false) AS follows
FROM {o_tranche} AS a LEFT JOIN {o_tranche} AS b ON b.fund = a.fund AND b.company = a.company AND b.row_no <> a.row_no AND b.is_investment
WHERE a.is_investment GROUP BY ALL"""


@query("win_06", "SELECT fund, company, title, row_no FROM {o_follow} WHERE candidate")
def win_06(fr):
    return temporal.latest_candidates(joins.tranches(fr).filter("is_investment"), ["fund", "company"]).filter("candidate").select("fund", "company", "title", "row_no")


@query("win_07", "SELECT fund, company, title, row_no FROM {o_follow} WHERE follows")
def win_07(fr):
    return temporal.latest_candidates(joins.tranches(fr).filter("is_investment"), ["fund", "company"]).filter("follows").select("fund", "company", "title", "row_no")


@query("win_08", """SELECT h.holding_id, d.period_id, s.component, max(s.supported_on) AS latest_support FROM {f_support} AS s JOIN {f_holding} AS h ON h.holding_id = s.holding_id
 JOIN {o_date} AS d ON d.fund_id = h.fund_id AND s.supported_on <= d.period_date GROUP BY ALL""", text="latest_support")
def win_08(fr):
    a = assessment(fr)
    dates = a.ledger.holding.select("holding_id", "fund_id").join(a.periods, "fund_id").select("holding_id", "period_id", "period_date")
    return temporal.latest_support(a.ledger.support, dates)


@query("win_09", """SELECT holding_id, period_id, priced_class AS held_class, claim_id AS price_claim, price_per_share AS price FROM (
 SELECT *, row_number() OVER (PARTITION BY holding_id, period_id, priced_class ORDER BY issued_date DESC, claim_id DESC) AS rn FROM {o_relied}
 WHERE requirement = 'R2' AND priced_class IS NOT NULL AND price_per_share IS NOT NULL) WHERE rn = 1""", text="price")
def win_09(fr):
    from attestor.operators import validators
    priced = assessment(fr).relied.filter("requirement = 'R2' AND price_per_share IS NOT NULL")
    return validators.class_prices(priced).select("holding_id", "period_id", "held_class", "own.price_claim", "own.price")


@query("win_11", """SELECT lot_id, CAST(row_number() OVER (PARTITION BY holding_id ORDER BY acquired_date, lot_id) AS BIGINT) AS ordinal FROM {f_lot}""")
def win_11(fr):
    return order.numbered(fr["f_lot"].select("lot_id", "holding_id", "acquired_date"), ["holding_id"], ["acquired_date", "lot_id"]).select("lot_id", "ordinal")


@query("set_01", """SELECT holding_id, period_id, len(list_filter(held_classes, lambda x: NOT list_contains(priced, x))) > 0 OR len(list_filter(priced, lambda x: NOT list_contains(held_classes, x))) > 0 AS cross_class
 FROM {o_held} JOIN {o_r2_set} USING (holding_id, period_id) WHERE len(priced) > 0""")
def set_01(fr):
    a = assessment(fr)
    both = a.priced_sets
    differ = (F.size(F.array_except("held_classes", "priced_classes")) > 0) | (F.size(F.array_except("priced_classes", "held_classes")) > 0)
    return both.filter(F.size("priced_classes") > 0).select("holding_id", "period_id", differ.alias("cross_class"))


@query("set_02", """SELECT holding_id, period_id, array_to_string(list_sort(list_filter(held_classes, lambda x: NOT list_contains(priced, x))), ',') AS uncovered FROM {o_held} JOIN {o_r2_set} USING (holding_id, period_id)
 WHERE NOT class_free AND len(list_filter(held_classes, lambda x: NOT list_contains(priced, x))) > 0""")
def set_02(fr):
    a = assessment(fr)
    both = a.priced_sets
    uncovered = F.array_sort(F.array_except("held_classes", "priced_classes"))
    return both.filter(~F.col("class_free") & (F.size(uncovered) > 0)).select("holding_id", "period_id", F.concat_ws(",", uncovered).alias("uncovered"))


@query("set_03", """SELECT holding_id, period_id, bool_and(settled) AS resolved FROM (SELECT holding_id, period_id, priced_class, CAST(substr(holding_id, 2) AS INT) % 20 = 0 AS settled FROM {o_r2_claim}
 WHERE priced_class IS NOT NULL AND price_per_share IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT price_per_share) > 1) GROUP BY 1, 2""")
def set_03(fr):
    import dataclasses
    settled = fr["f_holding"].filter("cust_key % 20 = 0").select("holding_id", F.explode(F.array(*[F.lit(c) for c in "abcd"])).alias("priced_class"))
    evidence = dataclasses.replace(assessment(fr), resolutions=settled).r2_evidence
    found = evidence.filter("differing AND holding_id IS NOT NULL AND period_id IS NOT NULL")
    return found.select("holding_id", "period_id", (~F.col("contradicted")).alias("resolved"))


@query("set_04", """SELECT claim_id, requirement, CASE WHEN s.seen IS NULL THEN 'declared_only' ELSE 'stored_only' END AS side FROM (SELECT claim_id, requirement, 1 AS seen FROM {f_stored_reliance}) AS s
 FULL JOIN (SELECT claim_id, requirement, 1 AS seen FROM {f_declared_reliance}) AS d USING (claim_id, requirement) WHERE s.seen IS NULL OR d.seen IS NULL""")
def set_04(fr):
    return joins.unmatched(fr["f_declared_reliance"], fr["f_stored_reliance"], ["claim_id", "requirement"], "declared_only", "stored_only").select("claim_id", "requirement", "side")


@query("set_06", r"""SELECT document_id, array_to_string(list_sort(list_filter(mine, lambda x: NOT list_contains(known, x))), ' ') AS invented FROM (
 SELECT document_id, list_distinct([replace(rtrim(x, '.,'), ',', '') for x in regexp_extract_all(canonical_text, '\d[\d,.]*') if rtrim(x, '.,') <> '']) AS mine, [CAST(document_no AS VARCHAR), '2', '5'] AS known FROM {f_document})
 WHERE len(list_filter(mine, lambda x: NOT list_contains(known, x))) > 0""")
def set_06(fr):
    known = F.array(F.col("document_no").cast("string"), F.lit("2"), F.lit("5"))
    invented = F.array_sort(F.array_except(S.figure_tokens(F.col("canonical_text")), known))
    return fr["f_document"].withColumn("invented", invented).filter(F.size("invented") > 0).select("document_id", F.concat_ws(" ", "invented").alias("invented"))


@query("set_08", """SELECT holding_id, array_to_string(list(security_class ORDER BY first_seen, security_class), ',') AS classes FROM (
 SELECT holding_id, security_class, min(acquired_date) AS first_seen FROM {f_lot} GROUP BY 1, 2) GROUP BY 1""")
def set_08(fr):
    first = fr["f_lot"].groupBy("holding_id", "security_class").agg(F.min("acquired_date").alias("first_seen"))
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "security_class")))
    return first.groupBy("holding_id").agg(ordered.alias("seen")).select("holding_id", F.concat_ws(",", F.array_distinct(F.col("seen.security_class"))).alias("classes"))
