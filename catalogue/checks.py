"""VAL: figures recomputed from the evidence and compared with the ones stated."""

import dataclasses

from pyspark.sql import functions as F

from attestor import model
from attestor.operators import packets, rules, validators
from attestor.sources.ledger import from_derived
from catalogue import LIBRARY, query
from catalogue.rules import assessment


@query("val_01", """SELECT lot_id, CASE WHEN shares IS NULL THEN 'not_applicable' WHEN shares * entry_pps = cost_amount THEN 'pass' ELSE 'fail' END AS outcome,
 CASE WHEN shares IS NULL THEN 'NO_SHARE_COUNT' ELSE 'SHARES_X_ENTRY_PPS' END AS reason, CAST(shares * entry_pps AS DECIMAL(38,6)) AS computed, CAST(cost_amount AS DECIMAL(38,6)) AS stated FROM {f_lot}""", text="computed stated")
def val_01(fr):
    return validators.entry_cost(fr["f_lot"])


LIBRARY["o_class_lots"] = """
SELECT holding_id, period_id, held_class, sum(held_shares) AS shares, bool_or(held_shares IS NULL) AS no_shares FROM {o_lotdate} WHERE held GROUP BY ALL"""
LIBRARY["o_priced"] = "SELECT * FROM {o_relied} WHERE requirement = 'R2' AND price_per_share IS NOT NULL"
LIBRARY["o_own_price"] = """
SELECT holding_id, period_id, priced_class, claim_id, price_per_share FROM (SELECT *, row_number() OVER (PARTITION BY holding_id, period_id, priced_class ORDER BY issued_date DESC, claim_id DESC) AS rn
 FROM {o_priced} WHERE priced_class IS NOT NULL) WHERE rn = 1"""
LIBRARY["o_last_price"] = """
SELECT holding_id, period_id, priced_class, claim_id, price_per_share FROM (SELECT *, row_number() OVER (PARTITION BY holding_id, period_id ORDER BY issued_date DESC, claim_id DESC) AS rn FROM {o_priced}) WHERE rn = 1"""
LIBRARY["o_lot_value"] = """
SELECT l.holding_id, l.period_id, l.lot_id, l.held_class, l.held_shares, l.held_shares IS NULL AS no_shares, a.claim_id IS NULL AS no_price, o.claim_id IS NULL AND p.holding_id IS NULL AS uncovered,
 coalesce(o.price_per_share, CASE WHEN p.holding_id IS NOT NULL THEN a.price_per_share END) AS price, coalesce(o.claim_id, CASE WHEN p.holding_id IS NOT NULL THEN a.claim_id END) AS used,
 o.claim_id IS NULL AND p.holding_id IS NOT NULL AND a.claim_id IS NOT NULL AND a.priced_class IS DISTINCT FROM l.held_class AS cross_class
FROM {o_lotdate} AS l LEFT JOIN {o_own_price} AS o ON o.holding_id = l.holding_id AND o.period_id = l.period_id AND o.priced_class = l.held_class
LEFT JOIN {o_last_price} AS a ON a.holding_id = l.holding_id AND a.period_id = l.period_id
LEFT JOIN {f_policy_decision} AS p ON p.holding_id = l.holding_id AND p.period_id = l.period_id WHERE l.held"""
LIBRARY["o_class_value"] = """
SELECT holding_id, period_id, CASE WHEN bool_or(no_shares) THEN 'COMPONENT_WITHOUT_SHARE_COUNT' WHEN bool_or(no_price) THEN 'NO_PRICE_IN_EVIDENCE'
  WHEN bool_or(uncovered) THEN 'NO_PRICE_FOR_CLASS:' || array_to_string(list_sort(list(DISTINCT held_class) FILTER (uncovered)), ',') ELSE 'PER_CLASS_SHARES_X_PPS' END AS reason,
 CASE WHEN NOT bool_or(no_shares) AND NOT bool_or(no_price) AND NOT bool_or(uncovered) THEN sum(held_shares * price) END AS total,
 CASE WHEN NOT bool_or(no_shares) AND NOT bool_or(no_price) AND NOT bool_or(uncovered) THEN array_to_string(list_sort(list(DISTINCT used)), ',') ELSE '' END AS evidence
FROM {o_lot_value} GROUP BY 1, 2"""
LIBRARY["o_amount"] = """
SELECT holding_id, period_id, claim_id, stated_value, source_class FROM (
 SELECT c.holding_id, c.period_id, c.claim_id, c.source_class, v.stated_value, row_number() OVER (PARTITION BY c.holding_id, c.period_id
   ORDER BY CASE c.source_class WHEN 'third_party_valuation_memo' THEN 0 WHEN 'administrator_statement' THEN 1 ELSE 2 END, c.issued_date, c.claim_id) AS rn
 FROM {o_relied} AS c JOIN {o_stated_value} AS v ON v.claim_id = c.claim_id AND v.stated_value IS NOT NULL WHERE c.requirement = 'R2') WHERE rn = 1"""
LIBRARY["o_derived"] = """
SELECT h.holding_id, h.period_id, h.fund_id, h.period_date, CASE WHEN a.claim_id IS NOT NULL THEN CAST(a.stated_value AS DECIMAL(38,6)) WHEN e.any_price THEN CAST(v.total AS DECIMAL(38,6)) END AS derived,
 CASE WHEN e.holding_id IS NULL THEN 'NO_APPLICABLE_EVIDENCE' WHEN a.claim_id IS NOT NULL THEN CASE a.source_class WHEN 'third_party_valuation_memo' THEN 'THIRD_PARTY_CONCLUSION' WHEN 'administrator_statement' THEN 'ADMINISTRATOR_NAV' ELSE 'MANAGEMENT_CARRYING_VALUE' END
   WHEN e.any_price THEN v.reason WHEN e.bearing THEN 'NO_VALUE_FIELD_CITED' ELSE 'NO_PRICE_IN_EVIDENCE' END AS reason,
 CASE WHEN a.claim_id IS NOT NULL THEN a.claim_id WHEN e.any_price THEN v.evidence ELSE '' END AS evidence
FROM {o_held} AS h LEFT JOIN (SELECT holding_id, period_id, bool_or(price_per_share IS NOT NULL) AS any_price, bool_or(source_class IN ('third_party_valuation_memo', 'administrator_statement', 'fund_internal_record')) AS bearing
  FROM {o_relied} WHERE requirement = 'R2' GROUP BY 1, 2) AS e ON e.holding_id = h.holding_id AND e.period_id = h.period_id
LEFT JOIN {o_amount} AS a ON a.holding_id = h.holding_id AND a.period_id = h.period_id LEFT JOIN {o_class_value} AS v ON v.holding_id = h.holding_id AND v.period_id = h.period_id"""
LIBRARY["o_compared"] = """
SELECT d.holding_id, d.period_id, d.fund_id, d.period_date, d.derived, CAST(m.reported_amount AS DECIMAL(38,6)) AS reported, CAST(m.reported_amount - d.derived AS DECIMAL(38,6)) AS difference, d.evidence, m.reported_currency,
 CASE WHEN d.derived IS NOT NULL AND d.reason <> 'MANAGEMENT_CARRYING_VALUE' AND m.reported_amount IS NULL THEN 'NO_STATED_FIGURE_TO_COMPARE' ELSE d.reason END AS reason,
 CASE WHEN d.derived IS NULL THEN CASE WHEN d.reason IN ('COMPONENT_WITHOUT_SHARE_COUNT', 'NO_VALUE_FIELD_CITED') THEN 'blocked_incomplete' ELSE 'unconfirmable' END
   WHEN d.reason = 'MANAGEMENT_CARRYING_VALUE' THEN 'not_comparable' WHEN m.reported_amount IS NULL THEN 'blocked_incomplete' WHEN m.reported_amount = d.derived THEN 'pass' ELSE 'fail' END AS outcome
FROM {o_derived} AS d LEFT JOIN (SELECT * FROM {f_latest_mark} WHERE audit_scope = 'packet') AS m ON m.holding_id = d.holding_id AND m.period_id = d.period_id"""


@query("val_02", "SELECT holding_id, period_id, derived, reason, evidence FROM {o_derived}", text="derived")
def val_02(fr):
    return validators.derive_marks(assessment(fr)).select("holding_id", "period_id", "derived", "reason", F.concat_ws(",", "evidence").alias("evidence"))


@query("val_03", "SELECT holding_id, period_id, CAST(total AS DECIMAL(38,6)) AS class_value, reason AS class_reason, evidence AS class_evidence FROM {o_class_value}", text="class_value")
def val_03(fr):
    a = assessment(fr)
    priced = a.relied.filter("requirement = 'R2' AND price_per_share IS NOT NULL")
    return validators.per_class(validators.held_classes(a), priced, a.authorised).select(
        "holding_id", "period_id", "class_value", "class_reason", F.concat_ws(",", "class_evidence").alias("class_evidence"))


@query("val_03_lineage", """SELECT holding_id, period_id, lot_id, held_class, held_shares, price, CAST(held_shares * price AS DECIMAL(38,6)) AS amount, cross_class FROM {o_lot_value} AS v
 WHERE NOT EXISTS (SELECT 1 FROM {o_class_value} AS c WHERE c.holding_id = v.holding_id AND c.period_id = v.period_id AND c.total IS NULL)""", text="held_shares price amount")
def val_03_lineage(fr):
    return validators.lot_lineage(assessment(fr))


@query("val_04", "SELECT holding_id, period_id, outcome, reason, derived, reported FROM {o_compared}", text="derived reported")
def val_04(fr):
    return validators.mark_check(assessment(fr)).select("holding_id", "period_id", "outcome", "reason", "derived", "reported")


@query("val_05", """SELECT claim_id, CASE WHEN order_key % 4 = 0 THEN 'not_comparable' WHEN price = 0 THEN 'blocked_incomplete' WHEN stated * price = post THEN 'pass' ELSE 'not_comparable' END AS outcome,
 CASE WHEN order_key % 4 = 0 THEN 'JOIN_KEYS_DIFFER' WHEN price = 0 THEN 'ZERO_PRICE_PER_SHARE' ELSE 'POST_MONEY_OVER_PRICE_PER_SHARE' END AS reason, stated FROM (
 SELECT claim_id, order_key, CAST(CASE WHEN order_key % 9 = 1 THEN 0 ELSE price_per_share END AS DECIMAL(18,6)) AS price, CAST(1000 + order_key AS DECIMAL(18,0)) AS stated,
  CAST((1000 + order_key) * price_per_share + CASE WHEN order_key % 5 = 2 THEN 1 ELSE 0 END AS DECIMAL(24,4)) AS post FROM {f_claim} WHERE price_per_share IS NOT NULL)""", text="stated")
def val_05(fr):
    k = F.col("order_key")
    shares = (F.lit(1000) + k).cast("decimal(18,0)")
    post = (shares * F.col("price_per_share") + F.when(k % 5 == 2, 1).otherwise(0)).cast("decimal(24,4)")
    parts = {"company": F.col("holding_id"), "round_name": F.lit("A"), "effective_date": F.col("issued_date"), "currency": F.lit("USD"), "scope": F.lit("fully_diluted")}
    rounds = fr["f_claim"].filter("price_per_share IS NOT NULL").select(
        "claim_id", shares.alias("stated_shares"), post.alias("post_money"),
        F.when(k % 9 == 1, F.lit(0)).otherwise(F.col("price_per_share")).cast("decimal(18,6)").alias("price_per_share"),
        *[c.alias(n) for n, c in parts.items()], *[c.alias(f"price_{n}") for n, c in parts.items()],
        *[(F.when(k % 4 == 0, "EUR").otherwise("USD") if n == "currency" else c).alias(f"shares_{n}") for n, c in parts.items()])
    return validators.diluted_shares(rounds).select("claim_id", "outcome", "reason", "stated")


LIBRARY["o_fx"] = """
SELECT c.claim_id, c.holding_id, max(f.value_text) FILTER (field_name = 'currency_pair') AS pair, max(f.value_numeric) FILTER (field_name = 'fx_rate') AS rate,
 TRY_CAST(max(f.value_text) FILTER (field_name = 'fx_rate_effective_date') AS DATE) AS stated_for, bool_or(field_name = 'fx_rate') AS has_rate
FROM {f_claim} AS c JOIN {f_fact} AS f ON f.claim_id = c.claim_id WHERE c.position_type = 'fx_denominated_interest' GROUP BY 1, 2"""
LIBRARY["o_observed"] = """
SELECT 'EUR' AS base, 'USD' AS quote, CAST(rate AS DECIMAL(18,8)) AS rate, stated_for AS effective_for, CASE WHEN part_key % 6 = 0 THEN stated_for - 1 ELSE stated_for END AS observed_date,
 claim_id AS source_claim_id, CASE WHEN part_key % 11 = 0 THEN '' ELSE 'doc' END AS source_document_id
FROM {o_fx} JOIN (SELECT claim_id, part_key FROM {f_claim}) USING (claim_id) WHERE has_rate AND stated_for IS NOT NULL"""


@query("val_06", """SELECT h.holding_id, h.period_id, CASE WHEN x.n IS NOT NULL THEN 'blocked_incomplete' ELSE 'fail' END AS outcome, CASE WHEN x.n IS NOT NULL THEN 'FX_RATE_NOT_IN_LEDGER' ELSE 'unsupported_missing_fx' END AS reason
 FROM {o_held} AS h JOIN {f_holding} AS g ON g.holding_id = h.holding_id AND g.position_type = 'fx_denominated_interest'
 LEFT JOIN (SELECT r.holding_id, r.period_id, count(*) AS n FROM {o_relied} AS r JOIN {o_fx} AS f ON f.claim_id = r.claim_id AND f.has_rate AND f.stated_for = r.period_date WHERE r.requirement = 'R2' GROUP BY 1, 2) AS x
 ON x.holding_id = h.holding_id AND x.period_id = h.period_id""")
def val_06(fr):
    return validators.fx_rate_present(assessment(fr)).select("holding_id", "period_id", "outcome", "reason")


@query("val_06_observed", """SELECT h.holding_id, h.period_id, CASE WHEN n IS NULL THEN 'fail' WHEN n > 1 THEN 'blocked_incomplete' WHEN doc = '' OR obs <> h.period_date THEN 'fail' ELSE 'pass' END AS outcome,
 CASE WHEN n IS NULL THEN 'unsupported_missing_fx' WHEN n > 1 THEN 'MULTIPLE_FX_RATES_FOR_DATE' WHEN doc = '' THEN 'FX_RATE_UNCITED' WHEN obs <> h.period_date THEN 'FX_RATE_NOT_OBSERVED_FOR_DATE' ELSE 'FX_RATE_OBSERVED_FOR_MEASUREMENT_DATE' END AS reason
 FROM {o_held} AS h JOIN {f_holding} AS g ON g.holding_id = h.holding_id AND g.position_type = 'fx_denominated_interest'
 LEFT JOIN (SELECT f.holding_id, o.effective_for, count(*) AS n, min(o.source_document_id) AS doc, min(o.observed_date) AS obs FROM {o_observed} AS o JOIN {o_fx} AS f ON f.claim_id = o.source_claim_id AND f.pair = 'EUR/USD' GROUP BY 1, 2) AS k
 ON k.holding_id = h.holding_id AND k.effective_for = h.period_date""")
def val_06_observed(fr):
    a = assessment(fr)
    text = fr["f_fact"].groupBy("claim_id", "part_key").agg(
        F.max(F.when(F.col("field_name") == "fx_rate", F.col("value_numeric"))).cast("decimal(18,8)").alias("rate"),
        F.max(F.when(F.col("field_name") == "fx_rate_effective_date", F.col("value_text"))).try_cast("date").alias("effective_for"))
    observed = text.filter("rate IS NOT NULL AND effective_for IS NOT NULL").select(
        F.lit("EUR").alias("base"), F.lit("USD").alias("quote"), "rate", "effective_for",
        F.when(F.col("part_key") % 6 == 0, F.date_sub("effective_for", 1)).otherwise(F.col("effective_for")).alias("observed_date"),
        F.col("claim_id").alias("source_claim_id"), F.when(F.col("part_key") % 11 == 0, "").otherwise("doc").alias("source_document_id"))
    return validators.fx_rate_present(a, observed).select("holding_id", "period_id", "outcome", "reason")


@query("val_07", """SELECT claim_id, CASE WHEN concluded = computed THEN 'EXACT' WHEN unit > 0 AND concluded = round_even(CAST(computed / unit AS DOUBLE), 0) * unit THEN 'ROUNDING_VARIANCE' ELSE 'UNRECOGNISED_VARIANCE' END AS reason, computed FROM (
 SELECT claim_id, CAST(amount * rate AS DECIMAL(38,8)) AS computed, CASE part_key % 3 WHEN 0 THEN CAST(amount * rate AS DECIMAL(38,8)) WHEN 1 THEN round(amount * rate / 100) * 100 ELSE amount * rate + 7 END AS concluded,
  CASE WHEN part_key % 2 = 0 THEN 100 ELSE 0 END AS unit FROM (SELECT claim_id, part_key, CAST(1000 + part_key * 3 + 0.125 AS DECIMAL(20,4)) AS amount, CAST(CAST(90 + part_key % 30 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(16,8)) AS rate FROM {f_claim} WHERE position_type = 'fx_denominated_interest'))""", text="computed")
def val_07(fr):
    p = F.col("part_key")
    amount = (F.lit("1000.125").cast("decimal(20,4)") + p.cast("decimal(10,0)") * 3).cast("decimal(20,4)")
    rate = ((F.lit(90) + p % 30).cast("decimal(8,2)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(16,8)")
    rows = fr["f_claim"].filter("position_type = 'fx_denominated_interest'").select("claim_id", "part_key", amount.alias("foreign_amount"), rate.alias("rate"))
    product = (F.col("foreign_amount") * F.col("rate")).cast("decimal(38,8)")
    concluded = F.when(p % 3 == 0, product).when(p % 3 == 1, (F.round(product / 100, 0) * 100).cast("decimal(38,8)")).otherwise((product + 7).cast("decimal(38,8)"))
    rows = rows.withColumn("concluded", concluded).withColumn("rounding_unit", F.when(p % 2 == 0, 100).otherwise(0))
    return validators.fx_recomputation(rows).select("claim_id", "reason", "computed")


LIBRARY["o_terms"] = """
SELECT lot_id, shares AS realised_shares, entry_pps AS cash_per_share, CASE WHEN order_key % 6 = 5 THEN NULL ELSE CAST(shares * entry_pps + CASE WHEN order_key % 8 = 3 THEN 1 ELSE 0 END AS DECIMAL(24,4)) END AS stated_gross,
 CAST(order_key % 3 AS DECIMAL(24,4)) AS fees, CAST(order_key % 5 AS DECIMAL(24,4)) AS escrow, CASE WHEN order_key % 6 = 4 THEN NULL ELSE CAST(shares * entry_pps - order_key % 3 - order_key % 5 AS DECIMAL(24,4)) END AS stated_net
FROM {f_lot} WHERE realized_date IS NOT NULL AND shares IS NOT NULL"""


def terms(fr):
    k = F.col("order_key")
    gross = F.col("shares") * F.col("entry_pps")
    money = "decimal(24,4)"
    return fr["f_lot"].filter("realized_date IS NOT NULL AND shares IS NOT NULL").select(
        "lot_id", F.col("shares").alias("realised_shares"), F.col("entry_pps").alias("cash_per_share"),
        F.when(k % 6 != 5, gross + F.when(k % 8 == 3, 1).otherwise(0)).cast(money).alias("stated_gross"),
        (k % 3).cast(money).alias("fees"), (k % 5).cast(money).alias("escrow"), F.lit(0).cast(money).alias("earnout"), F.lit(None).cast(money).alias("withholding"),
        F.when(k % 6 != 4, gross - k % 3 - k % 5).cast(money).alias("stated_net"))


@query("val_08", """SELECT lot_id, CAST(realised_shares * cash_per_share AS DECIMAL(38,6)) AS computed_gross, CASE WHEN stated_gross IS NULL THEN 'blocked_incomplete' WHEN realised_shares * cash_per_share = stated_gross THEN 'pass' ELSE 'fail' END AS gross_outcome FROM {o_terms}""", text="computed_gross")
def val_08(fr):
    return validators.realised_gross(terms(fr)).select("lot_id", "computed_gross", "gross_outcome")


@query("val_09", """SELECT lot_id, CAST(realised_shares * cash_per_share - fees - escrow AS DECIMAL(38,6)) AS computed_net, CASE WHEN stated_net IS NULL THEN 'blocked_incomplete' WHEN realised_shares * cash_per_share - fees - escrow = stated_net THEN 'pass' ELSE 'fail' END AS net_outcome FROM {o_terms}""", text="computed_net")
def val_09(fr):
    return validators.realised_net(terms(fr)).select("lot_id", "computed_net", "net_outcome")


@query("val_10", """SELECT l.lot_id, l.period_id, CASE WHEN max(c.claim_id) IS NULL THEN 'unconfirmable' ELSE 'blocked_incomplete' END AS outcome,
 CASE WHEN max(c.claim_id) IS NULL THEN 'NO_REALIZATION_PRICE_IN_EVIDENCE' WHEN l.exit_shares IS NULL THEN 'NO_REALIZED_SHARE_COUNT' ELSE 'NO_STATED_GROSS_IN_LEDGER' END AS reason,
 CAST(l.exit_shares * arg_max(c.price_per_share, struct_pack(a := c.issued_date, b := c.claim_id)) AS DECIMAL(38,6)) AS computed,
 CASE WHEN l.exit_shares IS NOT NULL THEN arg_max(c.claim_id, struct_pack(a := c.issued_date, b := c.claim_id)) END AS evidence
FROM (SELECT l.lot_id, l.holding_id, d.period_id, CASE WHEN v.effective_date <= l.realized_date THEN v.to_security_class ELSE l.security_class END AS exit_class, CASE WHEN v.effective_date <= l.realized_date THEN v.to_shares ELSE l.shares END AS exit_shares
 FROM {f_lot} AS l JOIN {f_holding} AS h ON h.holding_id = l.holding_id JOIN {o_date} AS d ON d.fund_id = h.fund_id AND l.realized_date <= d.period_date LEFT JOIN {f_conversion} AS v ON v.lot_id = l.lot_id) AS l
LEFT JOIN {o_relied} AS c ON c.requirement = 'R4' AND c.holding_id = l.holding_id AND c.period_id = l.period_id AND c.price_per_share IS NOT NULL AND (c.priced_class IS NULL OR c.priced_class = l.exit_class)
GROUP BY l.lot_id, l.period_id, l.exit_shares""", text="computed")
def val_10(fr):
    return validators.realisations(assessment(fr))


LIBRARY["o_quote"] = """
SELECT holding_id, period_id, count(*) AS quotes, arg_max(claim_id, struct_pack(a := issued_date, b := claim_id)) FILTER (issued_date <= period_date) AS claim_id,
 arg_max(struct_pack(x := price_per_share), struct_pack(a := issued_date, b := claim_id)) FILTER (issued_date <= period_date) AS price, arg_max(struct_pack(x := priced_class), struct_pack(a := issued_date, b := claim_id)) FILTER (issued_date <= period_date) AS cls
FROM {o_relied} WHERE requirement = 'R2' AND source_class = 'public_market_quote' GROUP BY 1, 2"""


@query("val_11", """SELECT holding_id, period_id, CASE WHEN quotes IS NULL THEN 'unconfirmable' WHEN q IS NULL THEN 'fail' WHEN value IS NOT NULL THEN CASE WHEN value = reported THEN 'pass' ELSE 'fail' END WHEN no_shares OR (price IS NULL AND list_contains(held_classes, cls)) THEN 'blocked_incomplete' ELSE 'unconfirmable' END AS outcome,
 CASE WHEN quotes IS NULL THEN 'NO_QUOTE_IN_EVIDENCE' WHEN q IS NULL THEN 'QUOTE_AFTER_MEASUREMENT_DATE' WHEN value IS NOT NULL THEN 'QUOTED_CLOSE_X_SHARES' WHEN no_shares OR (price IS NULL AND list_contains(held_classes, cls)) THEN 'COMPONENT_WITHOUT_SHARE_COUNT'
  ELSE 'NO_PRICE_FOR_CLASS:' || array_to_string(list_filter(held_classes, lambda x: cls IS NULL OR x <> cls), ',') END AS reason, CAST(value AS DECIMAL(38,6)) AS computed, q AS evidence
FROM (SELECT h.holding_id, h.period_id, h.held_classes, o.quotes, o.claim_id AS q, o.price.x AS price, o.cls.x AS cls, s.no_shares, m.reported_amount AS reported,
  CASE WHEN NOT s.no_shares AND o.price.x IS NOT NULL AND len(h.held_classes) = 1 AND h.held_classes[1] = o.cls.x THEN s.shares * o.price.x END AS value
 FROM {o_held} AS h JOIN {f_holding} AS g ON g.holding_id = h.holding_id AND g.position_type = 'public_listed' LEFT JOIN {o_quote} AS o ON o.holding_id = h.holding_id AND o.period_id = h.period_id
 JOIN (SELECT holding_id, period_id, sum(shares) AS shares, bool_or(no_shares) AS no_shares FROM {o_class_lots} GROUP BY 1, 2) AS s ON s.holding_id = h.holding_id AND s.period_id = h.period_id
 LEFT JOIN {f_latest_mark} AS m ON m.holding_id = h.holding_id AND m.period_id = h.period_id)""", text="computed")
def val_11(fr):
    return validators.quoted_value(assessment(fr)).select("holding_id", "period_id", "outcome", "reason", "computed", "evidence")


@query("val_12", """SELECT c.lot_id, CASE WHEN shares * exchange_ratio <> floor(shares * exchange_ratio) THEN 'fail' WHEN shares * exchange_ratio = to_shares THEN 'pass' ELSE 'fail' END AS outcome,
 CASE WHEN shares * exchange_ratio <> floor(shares * exchange_ratio) THEN 'FRACTIONAL_SHARE_UNSUPPORTED' ELSE 'PRIOR_SHARES_X_EXCHANGE_RATIO' END AS reason, CAST(shares * exchange_ratio AS DECIMAL(38,8)) AS computed, to_shares AS stated
 FROM {f_conversion} AS c JOIN {f_lot} AS l ON l.lot_id = c.lot_id""", text="computed stated")
def val_12(fr):
    return validators.recapitalisation(fr["f_lot"], fr["f_conversion"])


@query("val_13", """SELECT m.holding_id, m.period_id, coalesce(c.outcome, 'not_applicable') AS outcome, coalesce(c.reason, 'NOT_HELD_AT_MEASUREMENT_DATE') AS reason, c.derived, CAST(m.reported_amount AS DECIMAL(38,6)) AS reported, c.difference
 FROM {o_member} AS m LEFT JOIN {o_compared} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id""", text="derived reported difference")
def val_13(fr):
    return packets.recomputations(assessment(fr)).select("holding_id", "period_id", "outcome", "reason", "derived", "reported", "difference")


@query("val_14", """SELECT l.holding_id, l.period_id, m.reported_amount, CAST(cost AS DECIMAL(34,4)) AS cost, CAST(shares * top AS DECIMAL(38,6)) AS last_round, CAST(shares * top - cost AS DECIMAL(38,6)) AS variance FROM (
 SELECT holding_id, period_id, bool_or(held_shares IS NULL) AS no_shares, sum(cost_amount) AS cost, max(entry_pps) AS top, sum(held_shares) AS shares FROM {o_lotdate} WHERE held GROUP BY 1, 2) AS l
 JOIN {f_latest_mark} AS m ON m.holding_id = l.holding_id AND m.period_id = l.period_id WHERE NOT no_shares AND m.reported_amount = cost AND shares * top > cost""", text="reported_amount cost last_round variance")
def val_14(fr):
    return validators.basis_checks(assessment(fr))


@query("val_15", """SELECT f.claim_id, CAST(f.value_numeric AS DECIMAL(26,6)) AS concluded, m.reported_amount, CASE WHEN m.reported_amount = f.value_numeric THEN 'pass' ELSE 'fail' END AS outcome, CAST(l.amount * r.value_numeric AS DECIMAL(38,6)) AS recomputed
 FROM {f_fact} AS f JOIN {f_claim} AS c ON c.claim_id = f.claim_id JOIN {f_memo_claim} AS v ON v.claim_id = f.claim_id LEFT JOIN {f_fact} AS r ON r.claim_id = f.claim_id AND r.field_name = 'fx_rate'
 LEFT JOIN (SELECT v.claim_id, CASE WHEN count(*) = count(x.foreign_amount) THEN sum(x.foreign_amount) END AS amount FROM {f_claim} AS c JOIN {f_memo_claim} AS v ON v.claim_id = c.claim_id JOIN {f_lot} AS l ON l.holding_id = c.holding_id AND l.acquired_date <= v.valued_on AND (l.realized_date IS NULL OR l.realized_date > v.valued_on)
  LEFT JOIN {f_foreign} AS x ON x.lot_id = l.lot_id GROUP BY 1) AS l ON l.claim_id = f.claim_id
 LEFT JOIN {f_latest_mark} AS m ON m.holding_id = c.holding_id AND m.period_date = v.valued_on WHERE f.field_name = 'concluded_fair_value_usd'""", text="concluded reported_amount recomputed")
def val_15(fr):
    """Memos are dated by their own day: most on a year end, some on days at which nothing is measured."""
    led = from_derived(fr)
    dated = led.claim.join(fr["f_memo_claim"], "claim_id").withColumn("applicable_from", F.col("valued_on")).drop("valued_on")
    memos = rules.Assessment(dataclasses.replace(led, claim=dated))
    return validators.concluded_values(memos, fr["f_foreign"]).select("claim_id", "concluded", "reported_amount", "outcome", "recomputed")


@query("val_16", """SELECT lot_id, CASE WHEN coalesce(realised_shares * cash_per_share = stated_gross AND realised_shares * cash_per_share - fees - escrow = stated_net, false) THEN 'pass' ELSE 'fail' END AS outcome FROM {o_terms}""")
def val_16(fr):
    both = validators.realised_net(validators.realised_gross(terms(fr)))
    ok = (F.col("gross_outcome") == "pass") & (F.col("net_outcome") == "pass")
    return both.select("lot_id", F.when(ok, "pass").otherwise("fail").alias("outcome"))


@query("val_17", """SELECT 'entry_cost' AS check_name, CASE WHEN shares IS NULL THEN 'not_applicable' WHEN shares * entry_pps = cost_amount THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS lots FROM {f_lot} GROUP BY ALL
 UNION ALL SELECT 'recapitalisation', CASE WHEN shares * exchange_ratio = to_shares THEN 'pass' ELSE 'fail' END, count(*) FROM {f_conversion} AS c JOIN {f_lot} AS l ON l.lot_id = c.lot_id GROUP BY ALL""")
def val_17(fr):
    cost = validators.entry_cost(fr["f_lot"]).select(F.lit("entry_cost").alias("check_name"), "outcome")
    recap = validators.recapitalisation(fr["f_lot"], fr["f_conversion"]).select(F.lit("recapitalisation").alias("check_name"), "outcome")
    return cost.unionByName(recap).groupBy("check_name", "outcome").agg(F.count("*").alias("lots"))


@query("val_18", """SELECT v.holding_id, v.period_id, CASE WHEN d.reason <> 'MANAGEMENT_CARRYING_VALUE' THEN d.derived END AS validated, CASE WHEN d.reason = 'MANAGEMENT_CARRYING_VALUE' THEN d.derived END AS carried,
 CASE WHEN d.reason <> 'MANAGEMENT_CARRYING_VALUE' THEN v.reported_amount = d.derived END AS matches, concat_ws(',', CASE WHEN cross_class THEN 'cross_class_policy' END, CASE WHEN pro_forma THEN 'pro_forma' END, CASE WHEN subsequent THEN 'subsequent_evidence' END) AS labels
 FROM {o_verdicts} AS v LEFT JOIN {o_derived} AS d ON d.holding_id = v.holding_id AND d.period_id = v.period_id""", text="validated carried")
def val_18(fr):
    return packets.validated_amounts(assessment(fr)).select("holding_id", "period_id", "validated", "carried", "matches", F.concat_ws(",", "labels").alias("labels"))


@query("val_19", """SELECT d.decision_id, NOT EXISTS (SELECT 1 FROM {o_relied} AS c WHERE c.holding_id = d.holding_id AND c.period_id = d.period_id AND c.price_per_share IS NOT NULL AND c.part_key % 6 = 0) AS current
 FROM {f_decision} AS d JOIN {f_latest_mark} AS r ON r.mark_id = d.mark_id WHERE d.decision_type = 'valuation' AND d.status = 'approved'""")
def val_19(fr):
    """Approvals were recorded when some claims stated another price; exactly those that rest on such a claim are no longer current."""
    now = assessment(fr)
    changed = F.when(F.col("part_key") % 6 == 0, F.col("price_per_share") + 1).otherwise(F.col("price_per_share")).cast("decimal(18,6)")
    stored = lambda df, name: fr.store(df, f"val_19/{name}")
    then = packets.approval_fingerprints(now.with_claims(now.ledger.claim.withColumn("price_per_share", changed), stored), "policy-1")
    recorded = fr["f_decision"].filter("decision_type = 'valuation' AND status = 'approved'").select("decision_id", "holding_id", "period_id", "mark_id")
    approvals = recorded.join(then.select("holding_id", "period_id", "mark_id", F.col("fingerprint").alias("recorded")), ["holding_id", "period_id", "mark_id"])
    return packets.stale_approvals(approvals, packets.approval_fingerprints(now, "policy-1")).select("decision_id", "current")
