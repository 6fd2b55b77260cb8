"""COV: the request letter limb by limb."""

from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import coverage
from catalogue import LIBRARY, query
from catalogue.rules import assessment
from catalogue.scalars import _values

LIBRARY["d_limb"] = "SELECT * FROM " + _values([(k, s, b or "", len(d)) for k, _, s, b, d in model.LIMBS], "limb, scope, branch, dimensions")
LIBRARY["d_limb_value"] = "SELECT * FROM " + _values([(k, n, v) for k, _, _, _, d in model.LIMBS for n, vs in d.items() for v in vs], "limb, dimension, value")
LIBRARY["o_ev_date"] = """
SELECT DISTINCT holding_id, period_id, dimension, value FROM (
 SELECT c.holding_id, d.period_id, unnest(['class', 'status', 'field']) AS dimension, unnest([c.source_class, c.execution_status, f.field_name]) AS value FROM {f_claim} AS c JOIN {o_date} AS d ON d.fund_id = c.fund_id AND c.applicable_from <= d.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= d.period_date) LEFT JOIN {f_fact} AS f ON f.claim_id = c.claim_id
 UNION ALL SELECT holding_id, period_id, 'decision', coalesce(assessment_kind, decision_type) FROM {f_decision} UNION ALL SELECT d.holding_id, d.period_id, 'consideration', c.consideration FROM {f_consideration} AS c JOIN {f_decision} AS d ON d.decision_id = c.decision_id) WHERE value IS NOT NULL"""
LIBRARY["o_ev_position"] = """
SELECT DISTINCT holding_id, dimension, value FROM (SELECT c.holding_id, unnest(['class', 'status', 'field']) AS dimension, unnest([c.source_class, c.execution_status, f.field_name]) AS value FROM {f_claim} AS c LEFT JOIN {f_fact} AS f ON f.claim_id = c.claim_id
 UNION ALL SELECT holding_id, 'decision', coalesce(assessment_kind, decision_type) FROM {f_decision} UNION ALL SELECT d.holding_id, 'consideration', c.consideration FROM {f_consideration} AS c JOIN {f_decision} AS d ON d.decision_id = c.decision_id) WHERE value IS NOT NULL"""
LIBRARY["o_owed"] = """
SELECT l.limb, l.dimensions, h.holding_id, CAST(NULL AS VARCHAR) AS period_id FROM {d_limb} AS l, (SELECT DISTINCT holding_id FROM {o_held}) AS h WHERE l.scope = 'position'
UNION ALL SELECT l.limb, l.dimensions, h.holding_id, NULL FROM {d_limb} AS l, (SELECT DISTINCT holding_id FROM {f_lot} WHERE realized_date IS NOT NULL) AS h WHERE l.scope = 'realisation'
UNION ALL SELECT l.limb, l.dimensions, h.holding_id, h.period_id FROM {d_limb} AS l, {o_held} AS h JOIN {f_holding} AS g ON g.holding_id = h.holding_id WHERE l.scope = 'position_date' AND (l.branch = '' OR l.branch = CASE WHEN g.position_type = 'direct_equity' THEN 'round' ELSE 'other' END)"""
LIBRARY["o_answered"] = """
SELECT o.limb, o.holding_id, o.period_id, coalesce(m.met = o.dimensions, false) AS answered FROM {o_owed} AS o LEFT JOIN (
 SELECT v.limb, e.holding_id, e.period_id, count(DISTINCT v.dimension) AS met FROM {d_limb_value} AS v JOIN {o_ev_date} AS e ON e.dimension = v.dimension AND e.value = v.value GROUP BY 1, 2, 3
 UNION ALL SELECT v.limb, e.holding_id, NULL, count(DISTINCT v.dimension) FROM {d_limb_value} AS v JOIN {o_ev_position} AS e ON e.dimension = v.dimension AND e.value = v.value GROUP BY 1, 2) AS m ON m.limb = o.limb AND m.holding_id = o.holding_id AND m.period_id IS NOT DISTINCT FROM o.period_id"""


def branches(fr):
    return fr["f_holding"].select("holding_id", F.when(F.col("position_type") == "direct_equity", "round").otherwise("other").alias("branch"))


def result(fr):
    a = assessment(fr)
    return coverage.answered(coverage.owed(a, branches(fr)), *coverage.evidence(a, fr["f_consideration"], once=False))


@query("cov_01", "SELECT * FROM {o_answered}")
def cov_01(fr):
    return result(fr).select("limb", "holding_id", "period_id", "answered")


@query("cov_02", "SELECT holding_id, period_id, count(*) FILTER (dimension = 'class') AS classes, count(*) FILTER (dimension = 'field') AS fields, count(*) FILTER (dimension = 'decision') AS decisions FROM {o_ev_date} GROUP BY 1, 2")
def cov_02(fr):
    _, by_date = coverage.evidence(assessment(fr), fr["f_consideration"])
    of = lambda d: F.count_if(F.col("dimension") == d)
    return by_date.groupBy("holding_id", "period_id").agg(of("class").alias("classes"), of("field").alias("fields"), of("decision").alias("decisions"))


@query("cov_03", "SELECT limb, count(*) AS owed FROM {o_owed} GROUP BY 1")
def cov_03(fr):
    return coverage.owed(assessment(fr), branches(fr)).groupBy("limb").agg(F.count("*").alias("owed"))


#: The house's limbs and four that show what cannot be expressed: two in words nobody declares, two that ask what others ask.
LIMBS = (*model.LIMBS, ("x1", "asides", "position", None, {"class": ("oral_history",), "field": ("fund_shares",)}), ("x2", "asides", "position_date", None, {"decision": ("seance",), "status": ("pro_forma",)}),
         ("x3", "asides", "position_date", None, {"decision": ("calibration",)}), ("x4", "asides", "position", None, {"class": ("executed_transaction_doc",)}))
WORDS = ([("class", v) for v in model.SOURCE_CLASSES] + [("status", v) for v in model.EXECUTION_STATUSES] + [("decision", v) for v in ("transcription", "valuation", "management_assessment", "packet", "basis_memo", "representativeness", "calibration")]
         + [("consideration", v) for v in ("company_performance", "market_conditions", "impairment_indicators")])
LIBRARY["d_limb_more"] = "SELECT * FROM " + _values([(k, s, b or "", len(d)) for k, _, s, b, d in LIMBS], "limb, scope, branch, dimensions")
LIBRARY["d_limb_value_more"] = "SELECT * FROM " + _values([(k, n, v) for k, _, _, _, d in LIMBS for n, vs in d.items() for v in vs], "limb, dimension, value")
LIBRARY["o_word"] = "SELECT * FROM " + _values(WORDS, "dimension, value") + " UNION SELECT 'field', field_name FROM {f_fact}"
LIBRARY["o_missing"] = "SELECT limb, string_agg(DISTINCT value, ', ' ORDER BY value) AS missing FROM {d_limb_value_more} AS v WHERE NOT EXISTS (SELECT 1 FROM {o_word} AS w WHERE w.dimension = v.dimension AND w.value = v.value) GROUP BY 1"
LIBRARY["o_predicate"] = "SELECT l.limb, l.scope, string_agg(v.dimension || '=' || v.value, ';' ORDER BY v.dimension || '=' || v.value) AS p FROM {d_limb_more} AS l JOIN {d_limb_value_more} AS v ON v.limb = l.limb GROUP BY 1, 2"


@query("cov_04", "SELECT limb, missing FROM {o_missing}")
def cov_04(fr):
    _, values = coverage.limb_rows(fr.spark, LIMBS)
    return coverage.missing_vocabulary(fr["f_fact"], values).select("limb", F.concat_ws(", ", "missing").alias("missing"))


@query("cov_04_standing", """SELECT l.limb, CASE WHEN m.missing IS NOT NULL OR t.twins IS NOT NULL THEN 'not_expressible' WHEN coalesce(c.answered, 0) = 0 THEN 'unanswered' ELSE 'census' END AS standing,
 concat_ws('; ', 'no word for ' || m.missing, 'asks the same as ' || t.twins) AS reasons, coalesce(c.owed, 0) AS owed, CASE WHEN m.missing IS NULL AND t.twins IS NULL THEN coalesce(c.answered, 0) END AS answered
 FROM {d_limb_more} AS l LEFT JOIN {o_missing} AS m ON m.limb = l.limb LEFT JOIN (SELECT a.limb, string_agg(b.limb, ', ' ORDER BY b.limb) AS twins FROM {o_predicate} AS a JOIN {o_predicate} AS b ON b.scope = a.scope AND b.p = a.p AND b.limb <> a.limb GROUP BY 1) AS t ON t.limb = l.limb
 LEFT JOIN (SELECT limb, count(*) AS owed, count(*) FILTER (answered) AS answered FROM {o_answered} GROUP BY 1) AS c ON c.limb = l.limb""")
def cov_04_standing(fr):
    """Not expressible, unanswered and counted are three answers; the limbs added here are owed by nobody."""
    told = coverage.standing(result(fr), *coverage.limb_rows(fr.spark, LIMBS), fr["f_fact"])
    return told.select("limb", "standing", F.concat_ws("; ", "reasons").alias("reasons"), "owed", "answered")


@query("cov_05", """SELECT scope, array_to_string(list(limb ORDER BY limb), ',') AS limbs FROM (SELECT l.limb, l.scope, string_agg(v.dimension || '=' || v.value, ';' ORDER BY v.dimension || '=' || v.value) AS p FROM {d_limb_more} AS l JOIN {d_limb_value_more} AS v ON v.limb = l.limb
 WHERE EXISTS (SELECT 1 FROM {o_ev_position} AS e WHERE e.dimension = v.dimension AND e.value = v.value) GROUP BY 1, 2) GROUP BY scope, p HAVING count(*) > 1""")
def cov_05(fr):
    """Limbs that the words said of some position cannot tell apart: a word nobody says tells nothing apart."""
    by_position, _ = coverage.evidence(assessment(fr), fr["f_consideration"], once=False)
    return coverage.indistinguishable(*coverage.limb_rows(fr.spark, LIMBS), by_position).select("scope", F.concat_ws(",", "limbs").alias("limbs"))


@query("cov_06", "SELECT limb, fund_id, count(*) FILTER (answered) AS answered, count(*) AS owed, count(DISTINCT CASE WHEN answered THEN a.holding_id END) AS companies_answered FROM {o_answered} AS a JOIN {f_holding} AS h ON h.holding_id = a.holding_id GROUP BY 1, 2")
def cov_06(fr):
    return coverage.by_fund(result(fr), fr["f_holding"])


@query("cov_07", r"""SELECT document_id, CAST((length(flat) - length(replace(flat, fragment, ''))) // length(fragment) AS INT) AS hits FROM (SELECT document_id, flat, regexp_extract(flat, '^((?:[^ ]+ ){1}[^ ]+)', 1) AS fragment FROM (
 SELECT document_id, trim(regexp_replace(canonical_text, '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM {f_document})) WHERE fragment <> ''""")
def cov_07(fr):
    """Quoted fragments must occur exactly once in the flattened letter; the count says which do not."""
    flat = fr["f_document"].select("document_id", F.trim(F.regexp_replace("canonical_text", r"[ \t\n\r\f\x0B]+", " ")).alias("flat"))
    quoted = flat.withColumn("fragment", F.regexp_extract("flat", r"^((?:[^ ]+ ){1}[^ ]+)", 1)).filter("fragment <> ''")
    return quoted.select("document_id", S.occurrences(F.col("flat"), F.col("fragment")).alias("hits"))
