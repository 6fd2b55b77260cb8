"""Ledger-shaped frames derived from the star-schema test tables (FIXTURES.md, part B).

Every frame is one SELECT that Spark SQL and DuckDB read alike, so the operators and the
oracle start from the same rows. Only the inputs are shared: each operator and its oracle
statement are written separately.
"""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.session import shared_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Facts of a claim: field, when it is stated, its text and its number (null when not numeric).
FACT_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("fund_shares", "r1 AND part_key % 3 <> 0", "CAST(10 + part_key % 500 AS STRING)", "10 + part_key % 500"),
    ("fund_price_per_share", "r1 AND part_key % 4 <> 0",
     "CAST(CAST(CAST(100 + part_key % 900 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS STRING)",
     "CAST(100 + part_key % 900 AS DECIMAL(18,2)) * 0.01"),
    ("settlement_amount_received", "r1 AND part_key % 6 <> 1",
     "CAST(CASE WHEN part_key % 23 = 0 THEN 0 ELSE 1000 + part_key END AS STRING)",
     "CASE WHEN part_key % 23 = 0 THEN 0 ELSE 1000 + part_key END"),
    ("gross_consideration", "r4 AND part_key % 2 <> 0", "CAST(5000 + part_key AS STRING)", "5000 + part_key"),
    ("consideration_per_share", "r4 AND part_key % 3 <> 1",
     "CAST(CAST(CAST(100 + part_key % 70 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS STRING)",
     "CAST(100 + part_key % 70 AS DECIMAL(18,2)) * 0.01"),
    ("shares_of_record", "r4 AND part_key % 5 <> 2", "CAST(10 + part_key % 50 AS STRING)", "10 + part_key % 50"),
    ("concluded_fair_value_usd", "source_class = 'third_party_valuation_memo' AND part_key % 4 <> 3",
     "CAST(100000 + CASE WHEN part_key % 2 = 0 THEN 0 ELSE part_key END AS STRING)",
     "100000 + CASE WHEN part_key % 2 = 0 THEN 0 ELSE part_key END"),
    ("net_asset_value", "source_class = 'administrator_statement' AND part_key % 4 <> 3",
     "CAST(100000 + CASE WHEN part_key % 2 = 0 THEN 0 ELSE part_key END AS STRING)",
     "100000 + CASE WHEN part_key % 2 = 0 THEN 0 ELSE part_key END"),
    ("fund_holding_value", "source_class = 'fund_internal_record' AND part_key % 3 <> 1",
     "CAST(90000 + part_key AS STRING)", "90000 + part_key"),
    ("fx_rate", "position_type = 'fx_denominated_interest' AND part_key % 5 <> 4",
     "CAST(CAST(CAST(90 + part_key % 30 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS STRING)",
     "CAST(90 + part_key % 30 AS DECIMAL(18,2)) * 0.01"),
    ("fx_rate_effective_date", "position_type = 'fx_denominated_interest' AND part_key % 5 <> 4",
     "CAST(make_date(CAST(year(issued_date) AS INT), 12, 31) AS STRING)", "CAST(NULL AS INT)"),
    ("currency_pair", "position_type = 'fx_denominated_interest' AND part_key % 7 <> 6",
     "CASE WHEN part_key % 2 = 0 THEN 'EUR/USD' ELSE 'GBP/USD' END", "CAST(NULL AS INT)"),
)


def _pick(column: str) -> str:
    arms = " ".join(f"WHEN {n} THEN {column.format(when=rule[1], text=rule[2], number=rule[3], field=rule[0])}"
                    for n, rule in enumerate(FACT_RULES))
    return f"CASE n.ordinal {arms} END"


def _fact_rows() -> str:
    ordinals = ", ".join(f"({n})" for n in range(len(FACT_RULES)))
    return f"""
SELECT claim_id, holding_id, part_key, ordinal, field_name, value_text, value_numeric,
       replace(field_name, '_', ' ') || ' is ' || value_text AS quote
FROM (SELECT claim_id, holding_id, part_key, n.ordinal, {_pick("'{field}'")} AS field_name,
             {_pick("CASE WHEN {when} THEN {text} END")} AS value_text,
             {_pick("CAST({number} AS DECIMAL(26,6))")} AS value_numeric
      FROM {{f_claim}} CROSS JOIN (VALUES {ordinals}) AS n(ordinal)) AS t
WHERE value_text IS NOT NULL"""


def _statement_parts() -> str:
    return ", ".join(
        f"CASE WHEN {when} THEN '{field.replace('_', ' ')} is ' || {text} END" for field, when, text, _ in FACT_RULES
    )


GRID_PERIODS = ("96Q2", "FY1996", "97Q2", "FY1997", "98Q2", "FY1998", "99Q2", "FY1999", "00Q2", "FY2000", "01Q2", "FY2001", "01Q5")

_CELL = (
    "CASE WHEN m.cust_key % 17 = 5 THEN '—' WHEN m.cust_key % 13 = 4 THEN 'pending' "
    "WHEN m.cust_key % 11 = 3 THEN '$' || CAST(reported_amount AS STRING) "
    "WHEN m.cust_key % 19 = 6 THEN '(' || CAST(reported_amount AS STRING) || ')' "
    "ELSE CAST(reported_amount AS STRING) END"
)


def _grid_columns(source: str) -> str:
    return ", ".join(f"MAX(CASE WHEN label = '{p}' THEN {source} END) AS p_{p}" for p in GRID_PERIODS)


FRAMES: dict[str, str] = {
    "f_holding": """
SELECT 'h' || CAST(c_custkey AS STRING) AS holding_id, 'fund_' || CAST(r_regionkey AS STRING) AS fund_id,
       r_regionkey AS region_key, c_custkey AS cust_key, c_name AS company_name,
       CASE c_mktsegment WHEN 'FURNITURE' THEN 'indirect_feeder' WHEN 'HOUSEHOLD' THEN 'public_listed'
            WHEN 'MACHINERY' THEN 'fx_denominated_interest' ELSE 'direct_equity' END AS position_type,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'EUR' ELSE 'USD' END AS currency
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "f_fund": """
SELECT 'fund_' || CAST(r_regionkey AS STRING) AS fund_id, r_name AS legal_name,
       CASE r_regionkey WHEN 0 THEN 'Fund I' WHEN 1 THEN 'Fund II' WHEN 2 THEN 'Fund III'
            WHEN 3 THEN 'Fund IV' ELSE 'Fund V' END AS fund_label FROM {region}""",
    "f_period": """
SELECT fund_id || '_' || CAST(period_date AS STRING) AS period_id, fund_id, period_date, audit_scope, label FROM (
  SELECT 'fund_' || CAST(r_regionkey AS STRING) AS fund_id, make_date(y, m, CASE WHEN m = 12 THEN 31 ELSE 30 END) AS period_date,
         CASE WHEN m = 12 THEN 'packet' ELSE 'lineage_only' END AS audit_scope,
         CASE WHEN m = 12 THEN 'FY' || CAST(y AS STRING) ELSE substr(CAST(y AS STRING), 3, 2) || 'Q2' END AS label
  FROM {region} CROSS JOIN (VALUES (1996), (1997), (1998), (1999), (2000), (2001)) AS years(y)
  CROSS JOIN (VALUES (6), (12)) AS months(m)) AS p""",
    "f_lot": """
SELECT lot_id, holding_id, order_key, cust_key, security_class, shares, entry_pps,
       CAST(CASE WHEN shares IS NULL THEN 1000 ELSE shares * entry_pps + CASE WHEN order_key % 13 = 0 THEN 1 ELSE 0 END END
            AS DECIMAL(24,4)) AS cost_amount, acquired_date, realized_date
FROM (SELECT 'l' || CAST(o_orderkey AS STRING) AS lot_id, 'h' || CAST(o_custkey AS STRING) AS holding_id, o_orderkey AS order_key,
       o_custkey AS cust_key,
       substr('abcd', CAST((o_custkey + CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey % 2 ELSE 0 END) % 4 AS INT) + 1, 1) AS security_class,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS DECIMAL(18,0)) ELSE CAST(coalesce(qty, 100) AS DECIMAL(18,0)) END AS shares,
       CAST(CAST(100 + o_orderkey % 900 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,6)) AS entry_pps,
       CAST(o_orderdate AS DATE) AS acquired_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(100 + o_orderkey % 900 AS INT) END AS realized_date
  FROM {orders} LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM {lineitem} GROUP BY l_orderkey) AS q
    ON o_orderkey = l_orderkey) AS t""",
    "f_conversion": """
SELECT lot_id, effective_date, to_security_class, exchange_ratio,
       CAST(floor(shares * exchange_ratio) AS DECIMAL(18,0)) AS to_shares
FROM (SELECT lot_id, shares, acquired_date + 200 AS effective_date, 'z' AS to_security_class,
       CAST(CASE WHEN order_key % 2 = 0 THEN 1.5 ELSE 1.25 END AS DECIMAL(18,8)) AS exchange_ratio
  FROM {f_lot} WHERE order_key % 17 = 0 AND shares IS NOT NULL) AS t""",
    "f_mark": """
SELECT holding_id || '@' || CAST(period_date AS STRING) || '#' || CAST(revision AS STRING) AS mark_id, holding_id, fund_id, period_id,
       period_date, audit_scope, label, cust_key, revision, currency AS reported_currency,
       CAST(CASE WHEN cust_key % 3 = 0 THEN 100000 ELSE total END + CASE WHEN revision = 2 THEN 10 ELSE 0 END AS DECIMAL(24,4)) AS reported_amount,
       CASE WHEN cust_key % 4 = 1 THEN 'cost' WHEN cust_key % 4 = 2 THEN 'last_round' END AS basis
FROM (SELECT h.holding_id, h.fund_id, h.cust_key, h.currency, p.period_id, p.period_date, p.audit_scope, p.label,
             SUM(coalesce(CAST(l.shares * l.entry_pps AS DECIMAL(24,4)), l.cost_amount)) AS total
      FROM {f_lot} AS l JOIN {f_holding} AS h ON l.holding_id = h.holding_id
      JOIN {f_period} AS p ON p.fund_id = h.fund_id AND l.acquired_date <= p.period_date
       AND (l.realized_date IS NULL OR l.realized_date > p.period_date)
      GROUP BY h.holding_id, h.fund_id, h.cust_key, h.currency, p.period_id, p.period_date, p.audit_scope, p.label) AS t
CROSS JOIN (VALUES (1), (2)) AS revisions(revision)
WHERE revision = 1 OR (cust_key + year(period_date)) % 7 = 0""",
    "f_claim": """
SELECT claim_id, holding_id, fund_id, position_type, cust_key, order_key, line_no, part_key, supp_key, document_no, source_class,
       execution_status, r1, r2, r4, issued_date, received_date, applicable_from, applicable_to, priced_class,
       CASE WHEN part_key % 7 = 0 THEN NULL ELSE CAST(CAST(100 + (cust_key * 7 + coalesce(class_no, 0) * 13) % 900
            + CASE WHEN cust_key % 10 = 0 THEN part_key % 50 ELSE 0 END AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,6)) END AS price_per_share,
       supersedes_claim_id
FROM (SELECT claim_id, holding_id, fund_id, position_type, cust_key, order_key, line_no, part_key, supp_key, document_no,
       CASE position_type WHEN 'indirect_feeder' THEN 'administrator_statement' WHEN 'public_listed' THEN 'public_market_quote'
            WHEN 'fx_denominated_interest' THEN CASE WHEN supp_key % 2 = 0 THEN 'third_party_valuation_memo' ELSE 'fund_internal_record' END
            ELSE CASE WHEN kind IN (0, 1, 9) THEN 'executed_transaction_doc' WHEN kind IN (2, 3, 6) THEN 'company_communication'
                 WHEN kind IN (4, 5) THEN 'company_cap_table' WHEN kind = 7 THEN 'third_party_valuation_memo' ELSE 'press' END END AS source_class,
       CASE WHEN position_type <> 'direct_equity' THEN 'not_applicable'
            ELSE CASE WHEN kind IN (0, 1, 9) THEN 'executed' WHEN kind = 2 THEN 'non_binding' WHEN kind = 4 THEN 'pro_forma'
                 WHEN kind IN (5, 6) THEN 'unexecuted_referenced' ELSE 'not_applicable' END END AS execution_status,
       position_type = 'indirect_feeder' OR (position_type = 'direct_equity' AND kind IN (0, 2, 3, 9)) AS r1,
       position_type <> 'direct_equity' OR kind NOT IN (1, 3) AS r2,
       position_type = 'direct_equity' AND kind = 1 AS r4,
       issued_date, CASE WHEN part_key % 3 = 0 THEN issued_date + CAST(part_key % 40 AS INT) END AS received_date,
       issued_date AS applicable_from, CASE WHEN return_flag = 'R' THEN issued_date + 365 END AS applicable_to,
       class_no, CASE WHEN class_no IS NOT NULL THEN substr('abcd', CAST(class_no AS INT) + 1, 1) END AS priced_class,
       CASE WHEN order_key % 19 = 0 AND line_no = 2 THEN 'c' || CAST(order_key AS STRING) || '_1' END AS supersedes_claim_id
  FROM (SELECT 'c' || CAST(o_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS claim_id, h.holding_id, h.fund_id,
       h.position_type, h.cust_key, o_orderkey AS order_key, l_linenumber AS line_no, part_key, supp_key, supp_key % 10 AS kind,
       (o_orderkey * 7 + l_linenumber) % n_docs AS document_no, issued_date, return_flag,
       CASE WHEN part_key % 5 = 0 THEN NULL ELSE (h.cust_key + CASE WHEN h.cust_key % 2 = 1 THEN part_key % 3
            WHEN h.cust_key % 3 = 0 THEN 0 ELSE part_key % 2 END) % 4 END AS class_no
    FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS part_key, MIN(l_suppkey) AS supp_key,
                 CAST(MIN(l_shipdate) AS DATE) AS issued_date, MAX(l_returnflag) AS return_flag
          FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l
    JOIN {orders} ON o_orderkey = l_orderkey
    JOIN {f_holding} AS h ON h.cust_key = o_custkey
    CROSS JOIN (SELECT COUNT(*) AS n_docs FROM {documents}) AS d
    WHERE h.cust_key % 20 <> 7) AS a) AS b""",
    "f_claim_requirement": """
SELECT claim_id, holding_id, requirement FROM {f_claim} CROSS JOIN (VALUES ('R1'), ('R2'), ('R4')) AS r(requirement)
WHERE (requirement = 'R1' AND r1) OR (requirement = 'R2' AND r2) OR (requirement = 'R4' AND r4)""",
    "f_statement": f"""
SELECT claim_id, holding_id, concat_ws(chr(10), {_statement_parts()}) AS canonical_text FROM {{f_claim}}""",
    "f_fact_raw": _fact_rows(),
    "f_fact": """
SELECT f.claim_id, f.holding_id, f.part_key, f.ordinal, f.field_name,
       CASE WHEN f.part_key % 31 = 0 THEN f.value_text || '1' ELSE f.value_text END AS value_text,
       CASE WHEN f.part_key % 37 = 0 THEN f.value_numeric + 1 ELSE f.value_numeric END AS value_numeric, f.quote,
       instr(s.canonical_text, f.quote) - 1 + CASE WHEN f.part_key % 29 = 0 THEN 1 ELSE 0 END AS span_start,
       instr(s.canonical_text, f.quote) - 1 + CASE WHEN f.part_key % 29 = 0 THEN 1 ELSE 0 END + length(f.quote) AS span_end,
       CASE f.part_key % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'canonical' ELSE 'approved' END AS state
FROM {f_fact_raw} AS f JOIN {f_statement} AS s ON f.claim_id = s.claim_id""",
    "f_gap": """
SELECT 'g' || CAST(cust_key AS STRING) AS gap_id, holding_id, CASE WHEN cust_key % 10 = 4 THEN 'R2' ELSE 'R1' END AS requirement,
       CASE WHEN cust_key % 4 = 1 THEN substr('abcd', CAST(cust_key % 4 AS INT) + 1, 1) WHEN cust_key % 4 = 2 THEN 'c' END AS security_class,
       CASE cust_key % 10 WHEN 1 THEN 'with_counsel' WHEN 2 THEN 'referenced_location_unspecified' ELSE 'not_located' END AS kind,
       'purchase agreement' AS missing_document FROM {f_holding} WHERE cust_key % 10 IN (1, 2, 3, 4)""",
    "f_component": """
SELECT holding_id, 'valuation' AS component FROM {f_holding}
UNION ALL SELECT holding_id, 'fx_rate' AS component FROM {f_holding} WHERE position_type = 'fx_denominated_interest'""",
    "f_support": """
SELECT holding_id, 'valuation' AS component, acquired_date AS supported_on, lot_id, CAST(NULL AS STRING) AS claim_id
FROM {f_lot} WHERE cust_key % 4 <> 0
UNION ALL SELECT holding_id, 'fx_rate' AS component, issued_date AS supported_on, CAST(NULL AS STRING) AS lot_id, claim_id
FROM {f_claim} WHERE position_type = 'fx_denominated_interest'""",
    "f_policy_decision": """
SELECT 'pd' || CAST(cust_key AS STRING) || '_' || CAST(year(period_date) AS STRING) AS decision_id, holding_id, p.fund_id, period_id, period_date,
       substr('abcd', CAST((cust_key + 1) % 4 AS INT) + 1, 1) AS from_class, substr('abcd', CAST(cust_key % 4 AS INT) + 1, 1) AS to_class
FROM {f_holding} AS h JOIN {f_period} AS p ON p.fund_id = h.fund_id AND audit_scope = 'packet' WHERE cust_key % 25 = 0""",
    "f_latest_mark": """
SELECT holding_id, fund_id, period_id, period_date, audit_scope, label, cust_key, mark_id, revision, reported_currency, reported_amount, basis
FROM (SELECT *, row_number() OVER (PARTITION BY holding_id, period_id ORDER BY revision DESC) AS rn FROM {f_mark}) AS m WHERE rn = 1""",
    "f_decision": """
SELECT event_id AS decision_id, CASE event_type WHEN 'purchase' THEN 'valuation' WHEN 'error' THEN 'valuation'
       WHEN 'signup' THEN 'management_assessment' WHEN 'click' THEN 'transcription' ELSE 'packet' END AS decision_type,
       CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'draft' ELSE 'approved' END AS status,
       CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'representativeness' WHEN 1 THEN 'calibration' ELSE 'basis_memo' END END AS assessment_kind,
       m.holding_id, m.mark_id, m.period_id, m.period_date, ts AS decided_at, 'u' || CAST(user_id % 7 AS STRING) AS actor_id
FROM {events} JOIN (SELECT holding_id, mark_id, period_id, period_date, cust_key,
        row_number() OVER (PARTITION BY holding_id ORDER BY period_date DESC, revision DESC) AS rn FROM {f_mark}
        WHERE audit_scope = 'packet') AS m
  ON m.cust_key = user_id AND m.rn = 1""",
    "f_decision_evidence": """
SELECT decision_id, mark_id, mark_id || '/' || requirement AS assessment_id, requirement
FROM {f_decision} CROSS JOIN (VALUES ('R1'), ('R2')) AS r(requirement)
WHERE decision_type = 'valuation' AND decision_id % 5 <> 0 AND NOT (requirement = 'R2' AND decision_id % 9 = 4)""",
    "f_assessment": """
SELECT mark_id || '/' || requirement AS assessment_id, mark_id, holding_id, period_id, period_date, revision, requirement,
       requirement <> 'R4' OR cust_key % 3 = 0 AS applicable,
       CASE WHEN requirement = 'R4' THEN CASE WHEN cust_key % 3 = 0 THEN 'partial' ELSE 'not_applicable' END
            WHEN cust_key % 29 = 7 THEN 'not_applicable'
            ELSE CASE (cust_key + n) % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'sufficient' END END AS verdict,
       CASE WHEN cust_key % 8 = 5 THEN 'policy-0' ELSE 'policy-1' END AS policy_version,
       CASE WHEN cust_key % 10 = 2 THEN '' ELSE 'REASON' END AS reason_code
FROM {f_latest_mark} CROSS JOIN (VALUES ('R1', 1), ('R2', 2), ('R4', 3)) AS r(requirement, n)
WHERE audit_scope = 'packet' AND NOT (requirement = 'R2' AND cust_key % 21 = 4)""",
    "f_link": """
SELECT a.assessment_id, a.holding_id, a.period_date, a.requirement, c.claim_id,
       (greatest(c.issued_date, coalesce(c.received_date, c.issued_date)) > a.period_date) <> (c.part_key % 17 = 0) AS is_subsequent
FROM {f_assessment} AS a JOIN {f_claim} AS c ON c.holding_id = a.holding_id
 AND ((a.requirement = 'R1' AND c.r1) OR (a.requirement = 'R2' AND c.r2) OR (a.requirement = 'R4' AND c.r4))""",
    "f_packet": """
SELECT 'pk_' || period_id AS packet_id, fund_id, period_id, period_date, CASE WHEN year(period_date) % 3 = 0 THEN 'policy-0' ELSE 'policy-1' END AS policy_version,
       CASE WHEN fund_id <> 'fund_4' THEN period_date + 60 END AS approved_on FROM {f_period} WHERE audit_scope = 'packet'""",
    "f_manifest": """
SELECT 'pk_' || period_id AS packet_id, period_id || '/' || holding_id || '.csv' AS path, holding_id,
       row_number() OVER (PARTITION BY period_id ORDER BY holding_id) + CASE WHEN fund_id = 'fund_2' AND holding_id > 'h5' THEN 1 ELSE 0 END AS ordinal,
       period_date + CASE WHEN cust_key % 97 = 0 THEN 70 ELSE 10 END AS recorded_on
FROM {f_latest_mark} WHERE audit_scope = 'packet' AND NOT (fund_id = 'fund_3' AND year(period_date) = 1996)""",
    "f_consideration": """
SELECT decision_id, CASE decision_id % 3 WHEN 0 THEN 'company_performance' WHEN 1 THEN 'market_conditions' ELSE 'impairment_indicators' END AS consideration,
       CASE WHEN decision_id % 14 = 0 THEN '  ' ELSE 'considered' END AS note FROM {f_decision} WHERE decision_type = 'management_assessment' AND decision_id % 5 < 3""",
    "f_observation": """
SELECT c.claim_id, make_date(CAST(year(c.issued_date) + y.after AS INT), 12, 31) AS observed_on, c.price_per_share
FROM {f_claim} AS c CROSS JOIN (VALUES (0), (1), (2), (9)) AS y(after) WHERE c.source_class = 'public_market_quote' AND (y.after < 9 OR c.part_key % 3 = 0)""",
    "f_mark_arrival": """
SELECT holding_id, period_id, mark_id, revision, reported_amount FROM {f_mark}
UNION ALL SELECT holding_id, period_id, mark_id || '+' AS mark_id, revision + 1 AS revision, reported_amount + 5 AS reported_amount FROM {f_latest_mark} WHERE cust_key % 5 = 0""",
    "f_declared": """
SELECT 'period' AS table_name, count(*) AS declared FROM {f_period} UNION ALL SELECT 'lot' AS table_name, count(*) + 1 AS declared FROM {f_lot}
UNION ALL SELECT 'claim' AS table_name, count(*) AS declared FROM {f_claim}""",
    "f_foreign": """
SELECT l.lot_id, CAST(CASE WHEN l.order_key % 19 = 0 THEN NULL ELSE l.cost_amount * 2 END AS DECIMAL(20,4)) AS foreign_amount FROM {f_lot} AS l JOIN {f_holding} AS h ON h.holding_id = l.holding_id WHERE h.position_type = 'fx_denominated_interest'""",
    "f_memo_claim": """
SELECT claim_id, CASE WHEN part_key % 5 <> 4 THEN make_date(CAST(year(applicable_from) AS INT), 12, 31) ELSE applicable_from END AS valued_on FROM {f_claim}""",
    # Second copies of whole frames, with faults: keys, hashes and dates that were changed, never rows left out.
    "f_stored_reliance": """
SELECT CASE WHEN CAST(substr(holding_id, 2) AS INT) % 50 = 1 THEN claim_id || '~' ELSE claim_id END AS claim_id, holding_id, requirement FROM {f_claim_requirement}""",
    "f_declared_reliance": """
SELECT claim_id, holding_id, CASE WHEN CAST(substr(holding_id, 2) AS INT) % 50 = 2 AND requirement = 'R1' THEN 'R3' ELSE requirement END AS requirement FROM {f_claim_requirement}""",
    "f_stored_document": """
SELECT CASE WHEN document_no % 2 = 1 THEN 'x' || document_id ELSE document_id END AS document_id, document_no, canonical_text || CASE WHEN document_no % 7 = 0 THEN '!' ELSE '' END AS canonical_text FROM {f_document}""",
    "f_moved_mark": """
SELECT mark_id, holding_id, CASE WHEN cust_key % 70 = 2 THEN period_id || '~' ELSE period_id END AS period_id FROM {f_mark}""",
    "f_recorded_component": """
SELECT CASE WHEN CAST(substr(holding_id, 2) AS INT) % 40 = 3 AND component = 'valuation' THEN holding_id || '~' ELSE holding_id END AS holding_id, component FROM {f_component}""",
    "f_expected": """
SELECT CASE WHEN part_key % 23 = 5 THEN claim_id || '~' ELSE claim_id END AS claim_id, field_name, value_text AS expected, 'see  ' || quote || ' there' AS passage,
       CASE WHEN part_key % 13 = 6 THEN field_name || ' zzz' WHEN part_key % 17 = 3 THEN 'is' END AS distractor, part_key % 43 = 8 AS absent FROM {f_fact_raw}""",
    "f_cited": """
SELECT CASE WHEN part_key % 19 = 4 THEN claim_id || '^' ELSE claim_id END AS claim_id, field_name, value_text, quote FROM {f_fact}""",
    "f_recorded_text": """
SELECT claim_id, canonical_text || CASE WHEN CAST(substr(holding_id, 2) AS INT) % 4 = 1 THEN ' ' ELSE '' END AS canonical_text FROM {f_statement}""",
    "f_ruling": """
SELECT DISTINCT r.requirement, c.source_class, c.execution_status, c.position_type FROM {f_claim} AS c JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id WHERE c.cust_key % 29 = 5""",
    "f_restatement": """
SELECT assessment_id, verdict, CASE WHEN verdict = 'missing' THEN 'nothing on file' ELSE 'on this row' END AS verdict_label, payload, outstanding,
       CASE cust_key % 11 WHEN 0 THEN ' ' || chr(10) || chr(9) WHEN 1 THEN 'The finding is ' || replace(verdict, '_', ' ') || '. ' || repeat('Nothing more is said. ', 70)
       WHEN 2 THEN 'The finding is ' || replace(verdict, '_', ' ') || ' on 5 million of value.' WHEN 3 THEN 'The finding is ' || replace(verdict, '_', ' ') || ' for 987654 shares.'
       WHEN 4 THEN 'The finding is ' || replace(verdict, '_', ' ') || ' and the request was sent.' WHEN 5 THEN 'The finding is ' || replace(verdict, '_', ' ') || '; nothing so far has been received.'
       WHEN 6 THEN 'The finding is ' || replace(verdict, '_', ' ') || ', not conflicting.' WHEN 7 THEN 'There is a finding on this row.'
       ELSE 'The finding is ' || replace(verdict, '_', ' ') || ' in ' || CAST(year(period_date) AS STRING) || ' at policy 1.' END AS restatement
FROM (SELECT a.assessment_id, a.verdict, a.period_date, CAST(substr(a.holding_id, 2) AS INT) AS cust_key, CAST(substr(a.holding_id, 2) AS INT) % 2 = 0 AS outstanding,
        'verdict ' || a.verdict || ' date ' || CAST(a.period_date AS STRING) || ' policy 1 revision ' || CAST(a.revision AS STRING) || ' count 5' AS payload FROM {f_assessment} AS a) AS t""",
    "f_proposal": """
SELECT claim_id, holding_id, part_key, field_name, value_text, CASE WHEN part_key % 13 = 1 THEN 'not in the text' WHEN part_key % 13 = 2 THEN ' is ' WHEN part_key % 13 = 3 THEN '' ELSE quote END AS quote
FROM {f_fact_raw}""",
    "f_figure_edge": """
SELECT DISTINCT 'H' || holding_id AS figure_id, 'C' || claim_id AS child_id FROM {f_fact_raw}
UNION ALL SELECT DISTINCT 'F' || h.fund_id AS figure_id, 'H' || f.holding_id AS child_id FROM {f_fact_raw} AS f JOIN {f_holding} AS h ON h.holding_id = f.holding_id""",
    "f_figure_input": """
SELECT 'C' || claim_id AS figure_id, ordinal, claim_id || '/' || field_name AS fact_id, CASE WHEN part_key % 47 = 5 THEN 'X' END AS child_id, state,
       CASE WHEN part_key % 53 = 6 THEN NULL ELSE quote END AS quote FROM {f_fact}""",
    "f_grid": f"""
SELECT fund_label AS sheet, company, CAST(MAX(cost) AS STRING) AS cost_cell, {_grid_columns('cell')}
FROM (SELECT f.fund_label, h.company_name || CASE WHEN h.position_type = 'indirect_feeder' THEN ' (Indirect)' ELSE '' END AS company,
             CASE WHEN m.cust_key % 50 = 21 THEN '01Q5' ELSE m.label END AS label, {_CELL} AS cell, c.cost
      FROM (SELECT * FROM {{f_latest_mark}} WHERE cust_key % 41 <> 7) AS m JOIN {{f_holding}} AS h ON h.holding_id = m.holding_id JOIN {{f_fund}} AS f ON f.fund_id = h.fund_id
      LEFT JOIN (SELECT holding_id, CAST(SUM(cost_amount) + CASE WHEN MIN(cust_key) % 23 = 0 THEN 5 ELSE 0 END AS DECIMAL(24,4)) AS cost
                 FROM {{f_lot}} GROUP BY holding_id) AS c ON c.holding_id = m.holding_id) AS t
GROUP BY fund_label, company
UNION ALL
SELECT fund_label AS sheet, 'TOTAL' AS company, CAST(MAX(cost) AS STRING) AS cost_cell, {_grid_columns('CAST(total AS STRING)')}
FROM (SELECT f.fund_label, p.label, CAST(SUM(l.cost_amount) AS DECIMAL(24,4)) AS total, CAST(SUM(l.cost_amount) AS DECIMAL(24,4)) AS cost
      FROM {{f_lot}} AS l JOIN {{f_holding}} AS h ON h.holding_id = l.holding_id JOIN {{f_fund}} AS f ON f.fund_id = h.fund_id
      JOIN {{f_period}} AS p ON p.fund_id = h.fund_id AND l.acquired_date <= p.period_date
      WHERE l.realized_date IS NULL GROUP BY f.fund_label, p.label) AS t GROUP BY fund_label""",
    "f_sheet": """
SELECT region_key * 100000000 + cust_key + 1 AS sheet_no, company_name || CASE WHEN cust_key % 9 = 2 THEN ' (exited)' ELSE '' END AS title
FROM {f_holding}
UNION ALL SELECT region_key * 100000000 AS sheet_no, fund_label || ' >>' AS title
FROM (SELECT CAST(substr(fund_id, 6) AS INT) AS region_key, fund_label FROM {f_fund}) AS d""",
    "f_breakdown": """
SELECT h.region_key * 100000000 + h.cust_key + 1 AS sheet_no, h.company_name || CASE WHEN h.cust_key % 9 = 2 THEN ' (exited)' ELSE '' END AS title,
       l.order_key * 2 + 10 AS row_no,
       CASE WHEN l.order_key % 101 = 0 THEN 'Grant' WHEN l.shares IS NULL THEN 'Fund (Conv. Note)' ELSE 'Fund' END AS c0,
       CAST(l.cost_amount AS STRING) AS c1, CAST(NULL AS STRING) AS c2,
       CASE WHEN l.shares IS NOT NULL THEN CAST(l.entry_pps AS STRING) END AS c3, CAST(l.shares AS STRING) AS c4,
       CASE WHEN l.order_key % 103 = 0 THEN 'undated'
            WHEN l.order_key % 5 <= 2 THEN CAST(month(l.acquired_date) AS STRING) || '/' || CAST(day(l.acquired_date) AS STRING) || '/' || CAST(year(l.acquired_date) AS STRING)
            WHEN l.order_key % 5 = 3 THEN CAST(month(l.acquired_date) AS STRING) || '/' || CAST(year(l.acquired_date) AS STRING)
            ELSE CAST(year(l.acquired_date) AS STRING) || ' / ' || CAST(year(l.acquired_date) + 1 AS STRING) END AS c5
FROM {f_lot} AS l JOIN {f_holding} AS h ON h.holding_id = l.holding_id WHERE h.cust_key % 43 <> 9
UNION ALL
SELECT h.region_key * 100000000 + h.cust_key + 1, h.company_name || CASE WHEN h.cust_key % 9 = 2 THEN ' (exited)' ELSE '' END,
       l.order_key * 2 + 11, 'Exit', '0', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(l.shares AS STRING),
       CASE WHEN l.order_key % 7 = 0 THEN CAST(year(l.realized_date) AS STRING)
            ELSE CAST(month(l.realized_date) AS STRING) || '/' || CAST(day(l.realized_date) AS STRING) || '/' || CAST(year(l.realized_date) AS STRING) END
FROM {f_lot} AS l JOIN {f_holding} AS h ON h.holding_id = l.holding_id WHERE l.realized_date IS NOT NULL AND h.cust_key % 43 <> 9
UNION ALL
SELECT h.region_key * 100000000 + h.cust_key + 1, h.company_name || CASE WHEN h.cust_key % 9 = 2 THEN ' (exited)' ELSE '' END, n.row_no,
       CASE n.row_no WHEN 1 THEN CASE h.position_type WHEN 'indirect_feeder' THEN 'Indirect fund exposure through a feeder'
                 WHEN 'public_listed' THEN 'Listed since the de-SPAC' WHEN 'fx_denominated_interest' THEN 'EUR-denominated fund interest'
                 ELSE 'Supporting documentation' END
            WHEN 2 THEN 'Series ' || substr('ABCD', CAST(h.cust_key % 4 AS INT) + 1, 1) || '-1 agreement ' || CAST(1995 + h.cust_key % 7 AS STRING)
            ELSE CASE WHEN h.cust_key % 33 = 0 THEN 'Feeder de-SPAC note' ELSE 'Post-recap shares' END END,
       CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN n.row_no = 3 THEN '1.25' END,
       CASE WHEN n.row_no = 3 THEN CASE WHEN h.cust_key % 35 = 0 THEN 'tbd' ELSE CAST(100 + h.cust_key AS STRING) END END,
       CASE WHEN n.row_no = 3 THEN '3/15/' || CAST(1995 + h.cust_key % 7 AS STRING) END
FROM {f_holding} AS h CROSS JOIN (VALUES (1), (2), (3)) AS n(row_no)
WHERE n.row_no < 3 OR h.cust_key % 5 = 0 OR h.cust_key % 33 = 0""",
    "f_label": """
SELECT c_custkey AS label_key,
       CASE c_custkey % 5 WHEN 0 THEN 'Fund II' WHEN 1 THEN 'fund iv - side pocket' WHEN 2 THEN 'Fund I / Fund II Combined'
            WHEN 3 THEN ' Fund 3 ' ELSE c_name END AS fund_text,
       CASE c_custkey % 6 WHEN 0 THEN 'FY' || CAST(1990 + c_custkey % 40 AS STRING)
            WHEN 1 THEN CAST(10 + c_custkey % 30 AS STRING) || 'Q' || CAST(c_custkey % 7 AS STRING)
            WHEN 2 THEN ' fy' || CAST(2000 + c_custkey % 27 AS STRING) || ' ' WHEN 3 THEN '25Q4' WHEN 4 THEN 'Q4 25' ELSE 'FY24E' END AS period_text
FROM {customer}""",
    "f_cite": """
SELECT cite_key, value_text, CASE cite_key % 7 WHEN 0 THEN 'paid ' || value_text || ' at close'
       WHEN 1 THEN 'of ' || value_text || ' and again ' || value_text WHEN 2 THEN 'see 1' || value_text || '0 shares'
       WHEN 3 THEN 'no figure here' WHEN 4 THEN 'rate ' || value_text || 'e5 used' WHEN 5 THEN 'minus -' || value_text || ' net'
       ELSE value_text || ', ' || value_text || '.' END AS quote
FROM (SELECT p_partkey AS cite_key, CASE p_partkey % 12 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN '$' || CAST(p_partkey AS STRING) || '.50'
       WHEN 2 THEN '(' || CAST(p_partkey AS STRING) || ')' WHEN 3 THEN '-' || CAST(p_partkey AS STRING)
       WHEN 4 THEN CAST(1 + p_partkey % 9 AS STRING) || ',' || CAST(100 + p_partkey % 900 AS STRING)
       WHEN 5 THEN CAST(p_partkey % 100 AS STRING) || '%' WHEN 6 THEN '0' || CAST(p_partkey AS STRING)
       WHEN 7 THEN CAST(p_partkey AS STRING) || ',5' WHEN 8 THEN CAST(p_partkey AS STRING) || ' 7' WHEN 9 THEN p_name
       WHEN 10 THEN ' ( $ ' || CAST(p_partkey AS STRING) || ' ) ' ELSE chr(160) || CAST(p_partkey AS STRING) END AS value_text
  FROM {part}) AS t""",
    "f_paged": """
SELECT 'd' || CAST(doc_id AS STRING) AS document_id, doc_id AS document_no,
       replace(text, chr(10), chr(12)) || CASE WHEN doc_id % 3 = 0 THEN chr(12) ELSE '' END AS canonical_text FROM {documents}""",
    "f_document": """
SELECT 'd' || CAST(doc_id AS STRING) AS document_id, doc_id AS document_no, text AS canonical_text, lang, source,
       'source_' || CAST(doc_id AS STRING) || '.txt' AS filename, 'plain' AS extractor FROM {documents}""",
}

def _facts_of_claim() -> str:
    """The rows of `f_fact` where every claim_id stands once: each claim with its own statement, not joined to it."""
    stated = ", ".join(f"named_struct('ordinal', {n}, 'field_name', '{field}', 'value_text', CASE WHEN {when} THEN {text} END, 'value_numeric', CAST({number} AS DECIMAL(26,6)))"
                       for n, (field, when, text, number) in enumerate(FACT_RULES))
    place = "instr(canonical_text, quote) - 1 + CASE WHEN part_key % 29 = 0 THEN 1 ELSE 0 END"
    return f"""
SELECT claim_id, holding_id, part_key, ordinal, field_name, CASE WHEN part_key % 31 = 0 THEN value_text || '1' ELSE value_text END AS value_text,
       CASE WHEN part_key % 37 = 0 THEN value_numeric + 1 ELSE value_numeric END AS value_numeric, quote, {place} AS span_start, {place} + length(quote) AS span_end,
       CASE part_key % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'canonical' ELSE 'approved' END AS state
FROM (SELECT claim_id, holding_id, part_key, canonical_text, f.ordinal, f.field_name, f.value_text, f.value_numeric, replace(f.field_name, '_', ' ') || ' is ' || f.value_text AS quote
  FROM (SELECT claim_id, holding_id, part_key, concat_ws(chr(10), {_statement_parts()}) AS canonical_text, explode(array({stated})) AS f
        FROM {{f_claim}} WHERE claim_id IS NOT NULL) AS c WHERE f.value_text IS NOT NULL) AS t"""


_FACTS_OF_CLAIM = _facts_of_claim()

_NAME = re.compile(r"\{(\w+)\}")


#: Frames that only name the columns of other tables anew: read from these, not stored a second time.
VIEWS = ("f_document", "f_support")

_staged: dict[tuple[str, str, str], str] = {}
_staging = threading.RLock()


def _write(df: DataFrame, path: str) -> None:
    """A table of the ledger or of a run, packed as closely as every reader of Parquet can unpack."""
    df.write.option("compression", "zstd").parquet(path)


class DerivedFrames:
    """Access by name: ``frames["f_lot"]`` builds the frame and whatever it stands on.

    The ledger is staged the way a user would hold it: each frame is written once per application as a Parquet
    table in the shared folder, so queries read narrow columns instead of deriving the ledger again, and a lost
    executor costs a re-read, not a re-derivation. `VIEWS` are not written.
    """

    def __init__(self, spark: SparkSession, folder: str, stage: bool = True):
        self.spark, self.folder, self.stage = spark, folder, stage
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in FRAMES:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif self.stage and name not in VIEWS:
                self._built[name] = self.spark.read.parquet(self._table(name))
            else:
                self._built[name] = self._derive(name)
        return self._built[name]

    def _derive(self, name: str) -> DataFrame:
        if name == "f_fact" and self.stage:
            if self["f_claim"].groupBy("claim_id").count().filter("claim_id IS NOT NULL AND count > 1").isEmpty():
                return self.spark.sql(_FACTS_OF_CLAIM, f_claim=self["f_claim"])
            # Facts and statements of these very claims, whatever another reader of the folder has stored.
            own = DerivedFrames(self.spark, self.folder, stage=False)
            own._built["f_claim"] = self["f_claim"]
            return own["f_fact"]
        text = FRAMES[name]
        read = {n: self[n] for n in set(_NAME.findall(text))}
        if name == "f_claim":
            # Lines lie by order before they are added up, so they are moved once and not again to meet their order.
            read["lineitem"] = read["lineitem"].repartition("l_orderkey")
        return self.spark.sql(text, **read)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """A frame computed from this ledger, written once per application beside it and read back."""
        return self.spark.read.schema(df.schema).parquet(self.written(name, lambda path: _write(df, path)))

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """As `store`, but the frame is only built where it is not stored yet."""
        return self.spark.read.parquet(self.written(name, lambda path: _write(build(), path)))

    def written(self, name: str, write: Callable[[str], None]) -> str:
        """The folder of something that belongs to this ledger, written once per application."""
        key = (self.spark.sparkContext.applicationId, self.folder, f"run/{name}")
        with _staging:
            if key not in _staged:
                where = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
                path = f"{shared_folder(self.spark)}/ledger-{key[0]}-{where}/run/{name}"
                write(path)
                _staged[key] = path
        return _staged[key]

    def _table(self, name: str) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        with _staging:
            if key not in _staged:
                where = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
                path = f"{shared_folder(self.spark)}/ledger-{key[0]}-{where}/{name}"
                _write(self._derive(name), path)
                _staged[key] = path
        return _staged[key]


def compose(body: str, library: dict[str, str]) -> str:
    """One DuckDB statement: the body behind the common table expressions it names."""
    known = {**FRAMES, **library}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(body)

    def plain(text: str) -> str:
        return _NAME.sub(lambda m: m.group(1) if m.group(1) in known or m.group(1) in TABLES else m.group(0), text)

    if not order:
        return plain(body)
    ctes = ",\n".join(f"{name} AS ({plain(known[name])})" for name in order)
    return f"WITH {ctes}\n{plain(body)}"
