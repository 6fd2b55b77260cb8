"""Oracle statements several queries stand on, written row by row from the rules and not from the Spark plan."""

from catalogue import LIBRARY

LIBRARY.update({
    "o_date": """
SELECT fund_id, period_id, period_date, label, lag(period_date) OVER (PARTITION BY fund_id ORDER BY period_date) AS previous_date
FROM {f_period} WHERE audit_scope = 'packet'""",
    "o_lotdate": """
SELECT l.lot_id, l.holding_id, h.fund_id, h.position_type, d.period_id, d.period_date, d.previous_date, l.security_class, l.shares, l.entry_pps, l.cost_amount,
       l.acquired_date, l.realized_date,
       CASE WHEN v.effective_date <= d.period_date THEN v.to_security_class ELSE l.security_class END AS held_class,
       CASE WHEN v.effective_date <= d.period_date THEN v.to_shares ELSE l.shares END AS held_shares,
       l.realized_date IS NULL OR l.realized_date > d.period_date AS held,
       l.realized_date IS NULL OR l.realized_date > d.period_date - INTERVAL 12 MONTH AS during,
       l.realized_date IS NOT NULL AND l.realized_date <= d.period_date AND (d.previous_date IS NULL OR l.realized_date > d.previous_date) AS realised
FROM {f_lot} AS l JOIN {f_holding} AS h ON h.holding_id = l.holding_id JOIN {o_date} AS d ON d.fund_id = h.fund_id AND l.acquired_date <= d.period_date
LEFT JOIN {f_conversion} AS v ON v.lot_id = l.lot_id""",
    "o_app": """
SELECT c.*, r.requirement, d.period_id, d.period_date FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id
JOIN {o_date} AS d ON d.fund_id = c.fund_id
WHERE CASE WHEN r.requirement = 'R2' THEN c.applicable_from <= d.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= d.period_date)
           ELSE c.issued_date <= d.period_date END""",
    "o_relied": """
SELECT a.*, greatest(a.issued_date, coalesce(a.received_date, a.issued_date)) AS effective_date,
       CASE WHEN a.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL THEN m.priceless_verdict ELSE m.verdict END AS verdict,
       CASE WHEN a.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL THEN m.priceless_reason ELSE m.reason_code END AS reason_code,
       CASE WHEN a.price_per_share IS NULL AND m.priceless_verdict IS NOT NULL THEN 'REQUEST_EXECUTED_DOC' ELSE m.next_action END AS next_action
FROM {o_app} AS a LEFT JOIN {d_matrix} AS m ON m.requirement = a.requirement AND m.source_class = a.source_class
 AND m.execution_status = a.execution_status AND m.position_type = a.position_type
WHERE NOT (a.requirement = 'R2' AND EXISTS (SELECT 1 FROM {o_app} AS s WHERE s.requirement = 'R2' AND s.period_id = a.period_id AND s.supersedes_claim_id = a.claim_id))""",
    "o_rank": "SELECT * FROM (VALUES ('missing', 0), ('insufficient', 1), ('partial', 2), ('sufficient', 3)) AS t(verdict, ord)",
    "o_flags": """
SELECT claim_id,
 bool_or(field_name IN ('fund_shares', 'shares_held', 'position_shares', 'schedule_a_total_shares', 'fund_series_a_shares', 'fund_series_a2_shares', 'fund_a3_shares', 'capital_commitment') AND value_numeric > 0) AS has_count,
 bool_or(field_name IN ('fund_price_per_share', 'round_price_per_share', 'original_purchase_pps', 'fund_entry_price_per_share', 'fund_series_a2_original_pps') AND value_numeric > 0) AS has_price,
 bool_or(field_name IN ('settlement_amount_received', 'contributed_capital', 'acquisition_consideration_usd') AND value_numeric > 0) AS has_settlement,
 bool_or(field_name IN ('gross_consideration', 'net_payment')) AS has_proceeds,
 bool_or(field_name IN ('consideration_per_share', 'consideration_per_share_stated')) AS has_per_share,
 bool_or(field_name = 'shares_of_record') AS has_record FROM {f_fact} GROUP BY claim_id""",
    "o_r1_cover": """
SELECT l.lot_id, l.holding_id, l.period_id, l.shares, c.claim_id, k.ord, c.reason_code, c.next_action, coalesce(f.has_count, false) AS has_count,
       coalesce(f.has_price, false) AS has_price, coalesce(f.has_settlement, false) AS has_settlement, true AS is_claim
FROM {o_lotdate} AS l JOIN {o_relied} AS c ON c.requirement = 'R1' AND c.holding_id = l.holding_id AND c.period_id = l.period_id
 AND (c.priced_class IS NULL OR c.priced_class = l.held_class) JOIN {o_rank} AS k ON k.verdict = c.verdict LEFT JOIN {o_flags} AS f ON f.claim_id = c.claim_id
WHERE l.during
UNION ALL
SELECT l.lot_id, l.holding_id, l.period_id, l.shares, NULL, k.ord, d.reason_code, d.next_action, false, false, false, false
FROM {o_lotdate} AS l JOIN {f_gap} AS g ON g.holding_id = l.holding_id AND g.requirement = 'R1' AND g.security_class = l.security_class
JOIN {d_gap} AS d ON d.kind = g.kind JOIN {o_rank} AS k ON k.verdict = d.verdict WHERE l.during""",
    "o_r1_lot": """
SELECT l.lot_id, l.holding_id, l.period_id, l.shares, coalesce(max(c.ord), 0) AS best, count(c.ord) = 0 AS nothing,
       coalesce(bool_or(has_count), false) AS hc, coalesce(bool_or(has_price), false) AS hp, coalesce(bool_or(has_settlement), false) AS hs
FROM {o_lotdate} AS l LEFT JOIN {o_r1_cover} AS c ON c.lot_id = l.lot_id AND c.period_id = l.period_id WHERE l.during GROUP BY ALL""",
    "o_r1_codes": """
SELECT holding_id, period_id, reason_code, next_action FROM {o_r1_cover}
UNION ALL SELECT holding_id, period_id, 'NO_DOCUMENT_AND_NO_GAP_RECORDED', 'REQUEST_FROM_COMPANY' FROM {o_r1_lot} WHERE nothing
UNION ALL SELECT holding_id, period_id, 'NO_SHARE_COUNT_STATED', 'REQUEST_ACQUISITION_FIGURES' FROM {o_r1_lot} WHERE best = 3 AND shares IS NOT NULL AND NOT hc
UNION ALL SELECT holding_id, period_id, 'NO_ACQUISITION_PRICE_STATED', 'REQUEST_ACQUISITION_FIGURES' FROM {o_r1_lot} WHERE best = 3 AND shares IS NOT NULL AND NOT hp
UNION ALL SELECT holding_id, period_id, 'SETTLEMENT_OF_FUNDS_NOT_EVIDENCED', 'REQUEST_ACQUISITION_FIGURES' FROM {o_r1_lot} WHERE best = 3 AND NOT hs""",
    "o_r1": """
SELECT w.holding_id, w.period_id, 'R1' AS requirement, k.verdict, c.reasons, c.next_actions, w.lots FROM (
  SELECT holding_id, period_id, count(*) AS lots,
         min(CASE WHEN best = 3 AND ((shares IS NOT NULL AND NOT (hc AND hp)) OR NOT hs) THEN 2 ELSE best END) AS ord FROM {o_r1_lot} GROUP BY 1, 2) AS w
JOIN {o_rank} AS k ON k.ord = w.ord
JOIN (SELECT holding_id, period_id, coalesce(array_to_string(list_sort(list(DISTINCT reason_code) FILTER (reason_code IS NOT NULL)), ','), '') AS reasons,
             coalesce(array_to_string(list_sort(list(DISTINCT next_action) FILTER (next_action IS NOT NULL)), ','), '') AS next_actions
      FROM (SELECT holding_id, period_id, NULL AS reason_code, NULL AS next_action FROM {o_r1_lot} UNION ALL SELECT * FROM {o_r1_codes}) GROUP BY 1, 2) AS c
  ON c.holding_id = w.holding_id AND c.period_id = w.period_id""",
    "o_held": """
SELECT holding_id, period_id, fund_id, period_date, list_sort(list(DISTINCT held_class)) AS held_classes FROM {o_lotdate} WHERE held GROUP BY ALL""",
    "o_r2_claim": """
SELECT c.*, k.ord, h.held_classes, p.holding_id IS NOT NULL AS authorised,
       c.priced_class IS NOT NULL AND NOT list_contains(h.held_classes, c.priced_class) AND p.holding_id IS NULL AS off_class
FROM {o_relied} AS c JOIN {o_held} AS h ON h.holding_id = c.holding_id AND h.period_id = c.period_id JOIN {o_rank} AS k ON k.verdict = c.verdict
LEFT JOIN {f_policy_decision} AS p ON p.holding_id = c.holding_id AND p.period_id = c.period_id WHERE c.requirement = 'R2'""",
    "o_r2_set": """
SELECT holding_id, period_id, count(*) AS relied, max(ord) FILTER (NOT off_class) AS best, bool_or(off_class) AS off_class,
       list(DISTINCT reason_code) FILTER (NOT off_class AND reason_code IS NOT NULL) AS reasons, list(DISTINCT next_action) FILTER (NOT off_class AND next_action IS NOT NULL) AS actions,
       bool_or(priced_class IS NULL) AS class_free, coalesce(list(DISTINCT priced_class) FILTER (priced_class IS NOT NULL), []) AS priced,
       max(issued_date) FILTER (execution_status = 'pro_forma') AS last_pf, max(issued_date) FILTER (execution_status = 'executed') AS last_ex,
       bool_or(effective_date > period_date) AS subsequent
FROM {o_r2_claim} GROUP BY 1, 2""",
    "o_clash": """
SELECT DISTINCT holding_id, period_id FROM {o_r2_claim} WHERE priced_class IS NOT NULL AND price_per_share IS NOT NULL
GROUP BY holding_id, period_id, priced_class HAVING count(DISTINCT price_per_share) > 1""",
    "o_r2_state": """
SELECT h.holding_id, h.period_id, h.fund_id, h.period_date, coalesce(s.relied, 0) AS relied, s.best, coalesce(s.off_class, false) AS off_class, s.reasons, s.actions,
       x.holding_id IS NOT NULL AS contradicted, p.holding_id IS NOT NULL AS authorised, s.last_pf, s.last_ex, coalesce(s.subsequent, false) AS subsequent,
       e.holding_id IS NOT NULL AS closed, g.kind AS gap_kind,
       len(coalesce(s.priced, [])) > 0 AND list_sort(s.priced) <> h.held_classes AS cross_class,
       NOT coalesce(s.class_free, false) AND len(list_filter(h.held_classes, lambda x: NOT list_contains(coalesce(s.priced, []), x))) > 0 AS uncovered
FROM {o_held} AS h LEFT JOIN {o_r2_set} AS s ON s.holding_id = h.holding_id AND s.period_id = h.period_id
LEFT JOIN {o_clash} AS x ON x.holding_id = h.holding_id AND x.period_id = h.period_id
LEFT JOIN {f_policy_decision} AS p ON p.holding_id = h.holding_id AND p.period_id = h.period_id
LEFT JOIN (SELECT DISTINCT c.holding_id, d.period_id FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id AND r.requirement = 'R2'
           JOIN {o_date} AS d ON d.fund_id = c.fund_id AND c.applicable_to < d.period_date) AS e ON e.holding_id = h.holding_id AND e.period_id = h.period_id
LEFT JOIN (SELECT holding_id, arg_min(kind, gap_id) AS kind FROM {f_gap} WHERE requirement = 'R2' GROUP BY 1) AS g ON g.holding_id = h.holding_id""",
    "o_r2_cap": """
SELECT *, uncovered AND start = 3 AS capped, CASE WHEN uncovered AND start = 3 THEN 2 ELSE start END AS after_cap FROM (
 SELECT s.*, CASE WHEN relied = 0 AND closed THEN 0 WHEN relied = 0 THEN CASE coalesce(gap_kind, 'none') WHEN 'with_counsel' THEN 2 WHEN 'referenced_location_unspecified' THEN 1 ELSE 0 END
   WHEN best IS NULL THEN 1 ELSE best END AS start FROM {o_r2_state} AS s)""",
    "o_r2": """
SELECT holding_id, period_id, fund_id, period_date, 'R2' AS requirement,
 CASE WHEN contradicted THEN 'conflicting' ELSE CASE CASE WHEN cross_class AND NOT authorised AND after_cap = 3 THEN 2 ELSE after_cap END
   WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' ELSE 'sufficient' END END AS verdict,
 CASE WHEN contradicted THEN 'CONTRADICTORY_CLAIMS' ELSE coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(reasons, []), list_filter([
   CASE WHEN off_class THEN 'OFF_CLASS_EVIDENCE_NOT_RELIED' END, CASE WHEN relied > 0 AND best IS NULL THEN 'NO_SUPPORT_FOR_A_HELD_CLASS' END,
   CASE WHEN relied = 0 AND closed THEN 'SUPPORT_OUTSIDE_ITS_OWN_RELIANCE_WINDOW' END,
   CASE WHEN relied = 0 AND NOT closed THEN 'NO_APPLICABLE_SUPPORT_' || upper(coalesce(gap_kind, 'none')) END,
   CASE WHEN capped THEN 'UNCOVERED_SECURITY_CLASS' END, CASE WHEN cross_class AND NOT authorised THEN 'CROSS_CLASS_POLICY_DECISION_REQUIRED' END], lambda x: x IS NOT NULL)))), ','), '') END AS reasons,
 CASE WHEN contradicted THEN 'RESOLVE_CONTRADICTION' ELSE coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(actions, []), list_filter([
   CASE WHEN relied = 0 AND closed THEN 'REQUEST_UPDATED_VALUATION' END,
   CASE WHEN relied = 0 AND NOT closed THEN CASE coalesce(gap_kind, 'none') WHEN 'with_counsel' THEN 'REQUEST_FROM_COUNSEL' WHEN 'referenced_location_unspecified' THEN 'REQUEST_WITH_LOCATION' ELSE 'REQUEST_FROM_COMPANY' END END,
   CASE WHEN capped THEN 'REQUEST_SUPPORT_FOR_CLASS' END, CASE WHEN cross_class AND NOT authorised THEN 'RECORD_VALUATION_POLICY_DECISION' END], lambda x: x IS NOT NULL)))), ','), '') END AS next_actions,
 NOT contradicted AND cross_class AS cross_class,
 NOT contradicted AND last_pf IS NOT NULL AND NOT coalesce(last_ex >= last_pf, false) AS pro_forma, NOT contradicted AND subsequent AS subsequent
FROM {o_r2_cap}""",
    "o_prev": """
SELECT *, lag(period_date) OVER w AS previous_date, lag(reported_amount) OVER w AS previous_amount FROM {f_latest_mark} WINDOW w AS (PARTITION BY holding_id ORDER BY period_date)""",
    "o_stale": """
SELECT m.holding_id, m.period_id, m.period_date, m.previous_date, c.component, max(s.supported_on) AS latest_support
FROM {o_prev} AS m JOIN {f_component} AS c ON c.holding_id = m.holding_id
LEFT JOIN {f_support} AS s ON s.holding_id = m.holding_id AND s.component = c.component AND s.supported_on <= m.period_date
WHERE m.audit_scope = 'packet' AND m.previous_amount = m.reported_amount GROUP BY ALL
HAVING max(s.supported_on) IS NULL OR max(s.supported_on) < m.period_date - INTERVAL 12 MONTH""",
    "o_r3": """
SELECT m.holding_id, m.period_id, 'R3' AS requirement, coalesce(s.n, 0) AS stale_components,
 CASE WHEN s.n IS NULL THEN 'not_applicable' WHEN a.holding_id IS NOT NULL THEN 'sufficient' ELSE 'missing' END AS verdict,
 CASE WHEN s.n IS NOT NULL AND a.holding_id IS NULL THEN 'MARK_UNCHANGED_WITH_STALE_SUPPORT' ELSE '' END AS reasons,
 CASE WHEN s.n IS NOT NULL AND a.holding_id IS NULL THEN 'DRAFT_MANAGEMENT_ASSESSMENT' ELSE '' END AS next_actions,
 CASE WHEN m.previous_amount IS NULL THEN 'first mark on record' WHEN m.previous_amount <> m.reported_amount THEN 'another value than on ' || CAST(m.previous_date AS VARCHAR)
   WHEN s.n IS NULL THEN 'every component was supported in the last 12 months' END AS note
FROM {o_prev} AS m LEFT JOIN (SELECT holding_id, period_id, count(*) AS n FROM {o_stale} GROUP BY 1, 2) AS s ON s.holding_id = m.holding_id AND s.period_id = m.period_id
LEFT JOIN (SELECT DISTINCT holding_id, period_id FROM {f_decision} WHERE decision_type = 'management_assessment' AND status = 'approved') AS a
  ON a.holding_id = m.holding_id AND a.period_id = m.period_id WHERE m.audit_scope = 'packet'""",
    "o_r4_lot": """
SELECT l.lot_id, l.holding_id, l.period_id, coalesce(max(k.ord), 0) AS best, coalesce(bool_or(f.has_proceeds), false) AS hp, coalesce(bool_or(f.has_per_share), false) AS hs, coalesce(bool_or(f.has_record), false) AS hr
FROM {o_lotdate} AS l LEFT JOIN {o_relied} AS c ON c.requirement = 'R4' AND c.holding_id = l.holding_id AND c.period_id = l.period_id AND (c.priced_class IS NULL OR c.priced_class = l.security_class)
LEFT JOIN {o_rank} AS k ON k.verdict = c.verdict LEFT JOIN {o_flags} AS f ON f.claim_id = c.claim_id WHERE l.realised GROUP BY ALL""",
    "o_r4": """
SELECT holding_id, period_id, 'R4' AS requirement, lots AS realised_lots, CASE ord WHEN 0 THEN 'missing' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'partial' ELSE 'sufficient' END AS verdict,
 concat_ws(',', CASE WHEN ord < 3 THEN 'NO_REALIZATION_SUPPORT_FOR_LOT' END, CASE WHEN np THEN 'NO_PROCEEDS_STATED' END, CASE WHEN ns THEN 'NO_PER_SHARE_CONSIDERATION_STATED' END, CASE WHEN nr THEN 'NO_REALIZED_SHARE_COUNT_STATED' END) AS reasons,
 concat_ws(',', CASE WHEN ord < 3 THEN 'REQUEST_REALIZATION_SUPPORT' END, CASE WHEN np OR ns OR nr THEN 'REQUEST_REALIZATION_FIGURES' END) AS next_actions
FROM (SELECT holding_id, period_id, count(*) AS lots, bool_or(best = 3 AND NOT hp) AS np, bool_or(best = 3 AND NOT hs) AS ns, bool_or(best = 3 AND NOT hr) AS nr,
  min(CASE WHEN best < 3 THEN best WHEN NOT hp AND NOT hs AND NOT hr THEN 1 WHEN NOT (hp AND hs AND hr) THEN 2 ELSE 3 END) AS ord FROM {o_r4_lot} GROUP BY 1, 2)""",
    "o_member": """
SELECT coalesce(l.holding_id, m.holding_id) AS holding_id, coalesce(l.period_id, m.period_id) AS period_id, coalesce(l.fund_id, m.fund_id) AS fund_id,
 coalesce(l.period_date, m.period_date) AS period_date, coalesce(l.held, false) OR (m.mark_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f_lot} AS x WHERE x.holding_id = m.holding_id)) AS held,
 coalesce(l.realised, false) AS realised, m.mark_id, m.revision, m.reported_amount, m.reported_currency
FROM (SELECT holding_id, period_id, fund_id, period_date, bool_or(held) AS held, bool_or(realised) AS realised FROM {o_lotdate} GROUP BY ALL) AS l
FULL JOIN (SELECT * FROM {f_latest_mark} WHERE audit_scope = 'packet') AS m ON m.holding_id = l.holding_id AND m.period_id = l.period_id
WHERE coalesce(l.held, false) OR coalesce(l.realised, false) OR m.mark_id IS NOT NULL""",
    "o_verdicts": """
SELECT m.*, coalesce(a.verdict, 'not_applicable') AS r1, coalesce(b.verdict, 'not_applicable') AS r2, coalesce(c.verdict, 'not_applicable') AS r3, coalesce(d.verdict, 'not_applicable') AS r4,
 CASE WHEN b.pro_forma THEN 'sufficient' ELSE 'not_applicable' END AS r5, coalesce(b.cross_class, false) AS cross_class, coalesce(b.pro_forma, false) AS pro_forma, coalesce(b.subsequent, false) AS subsequent
FROM {o_member} AS m LEFT JOIN {o_r1} AS a ON a.holding_id = m.holding_id AND a.period_id = m.period_id LEFT JOIN {o_r2} AS b ON b.holding_id = m.holding_id AND b.period_id = m.period_id
LEFT JOIN {o_r3} AS c ON c.holding_id = m.holding_id AND c.period_id = m.period_id LEFT JOIN {o_r4} AS d ON d.holding_id = m.holding_id AND d.period_id = m.period_id""",
    "o_row": """
SELECT v.*, CASE WHEN list_contains(x, 'conflicting') THEN 'conflicting' WHEN list_contains(x, 'missing') THEN 'missing' WHEN list_contains(x, 'insufficient') THEN 'insufficient'
  WHEN list_contains(x, 'partial') THEN 'partial' WHEN list_contains(x, 'sufficient') THEN 'sufficient' ELSE 'not_applicable' END AS row_verdict,
 CAST(len(list_filter(x, lambda q: q <> 'not_applicable')) AS INT) AS applicable_count, CAST(len(list_filter(x, lambda q: q = 'sufficient')) AS INT) AS sufficient_count,
 len(list_filter(x, lambda q: q <> 'not_applicable')) > 0 AND len(list_filter(x, lambda q: q NOT IN ('not_applicable', 'sufficient'))) = 0 AS fully_supported,
 concat_ws(';', CASE WHEN r1 NOT IN ('sufficient', 'not_applicable') OR (held AND r1 <> 'sufficient') THEN 'R1 ' || r1 END, CASE WHEN r2 NOT IN ('sufficient', 'not_applicable') OR (held AND r2 <> 'sufficient') THEN 'R2 ' || r2 END,
   CASE WHEN r3 NOT IN ('sufficient', 'not_applicable') THEN 'R3 ' || r3 END,
   CASE WHEN NOT held AND len(list_filter(x, lambda q: q <> 'not_applicable')) = 0 THEN 'R4 not assessed' WHEN r4 NOT IN ('sufficient', 'not_applicable') THEN 'R4 ' || r4 END,
   CASE WHEN r5 NOT IN ('sufficient', 'not_applicable') THEN 'R5 ' || r5 END) AS unsupported
FROM (SELECT *, [r1, r2, r3, r4, r5] AS x FROM {o_verdicts}) AS v""",
})
