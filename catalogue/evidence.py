"""CIT and GRD: stored citations re-resolved, facts bound and extracted, restatements guarded."""

from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import citing, extraction, guard
from catalogue import LIBRARY, query
from catalogue.scalars import FIGURES_SQL, NUMERAL_SQL, tokens_sql

RESOLVES = "(f.span_end <= length(s.canonical_text) AND substr(s.canonical_text, CAST(f.span_start AS INT) + 1, CAST(f.span_end - f.span_start AS INT)) = f.quote)"
LIBRARY["o_bound"] = f"""
SELECT f.claim_id, f.holding_id, f.field_name, concat_ws(',', CASE WHEN NOT {RESOLVES} THEN 'span_does_not_resolve' END, CASE WHEN ({tokens_sql('f.quote', 'f.value_text')}) <> 1 THEN 'value_not_in_quote' END,
 CASE WHEN CAST(f.value_numeric AS DECIMAL(30,6)) IS DISTINCT FROM CAST({NUMERAL_SQL.replace('{x}', 'f.value_text')} AS DECIMAL(30,6)) THEN 'number_is_not_the_stated_one' END) AS violations FROM {{f_fact}} AS f JOIN {{f_statement}} AS s ON s.claim_id = f.claim_id"""


def bound(fr):
    return citing.bind_facts(fr["f_fact"], fr["f_statement"])


@query("cit_01", f"SELECT count(*) AS citations, count(*) FILTER ({RESOLVES}) AS resolved, count(*) FILTER (NOT {RESOLVES}) AS failing, count(DISTINCT f.claim_id) AS claims FROM {{f_fact}} AS f JOIN {{f_statement}} AS s ON s.claim_id = f.claim_id")
def cit_01(fr):
    return citing.census(bound(fr))


@query("cit_02", "SELECT claim_id, field_name, violations FROM {o_bound} WHERE violations <> ''")
def cit_02(fr):
    return bound(fr).filter(F.size("violations") > 0).select("claim_id", "field_name", F.concat_ws(",", "violations").alias("violations"))


@query("cit_03", """SELECT c.claim_id, CAST(c.price_per_share AS DECIMAL(26,6)) AS figure FROM {f_claim} AS c WHERE c.price_per_share IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f_fact} AS f WHERE f.claim_id = c.claim_id AND f.value_numeric = c.price_per_share)""", text="figure")
def cit_03(fr):
    return citing.uncited_prices(fr["f_claim"], fr["f_fact"])


FAMILY_SQL = """CASE WHEN source_class = 'executed_transaction_doc' THEN 'purchase_agreement' WHEN source_class = 'company_cap_table' THEN 'cap_table' WHEN source_class IN ('third_party_valuation_memo', 'administrator_statement', 'fund_internal_record') THEN 'memo'
 WHEN execution_status = 'non_binding' THEN 'term_sheet' ELSE 'irregular' END"""
LIBRARY["d_rule"] = "SELECT * FROM (VALUES " + ", ".join(f"('{fam}', '{f}')" for fam, rows in citing.FAMILIES.items() for r in rows for f, _ in r.fields) + ") AS t(family, field_name)"
LIBRARY["o_extracted"] = f"""
SELECT t.claim_id, t.family, t.field_name, CAST(len(m) AS INT) AS hits, CASE len(m) WHEN 1 THEN 'cited' WHEN 0 THEN 'pattern_matched_nothing' ELSE 'pattern_is_ambiguous' END AS outcome, CASE WHEN len(m) = 1 THEN split_part(m[1], ' is ', 2) END AS value_text,
 CASE WHEN len(m) = 1 THEN CAST(instr(canonical_text, m[1]) - 1 AS INT) END AS span_start
FROM (SELECT c.claim_id, c.family, r.field_name, s.canonical_text, list_filter(string_split(s.canonical_text, chr(10)), lambda x: x LIKE replace(r.field_name, '_', ' ') || ' is %') AS m
 FROM (SELECT claim_id, {FAMILY_SQL} AS family FROM {{f_claim}}) AS c JOIN {{f_statement}} AS s ON s.claim_id = c.claim_id JOIN {{d_rule}} AS r ON r.family = c.family) AS t"""


def extracted(fr, *families):
    docs = fr["f_claim"].select("claim_id", citing.family_of().alias("family")).join(fr["f_statement"].select("claim_id", "canonical_text"), "claim_id")
    return extraction.extract(docs, citing.rules_of(*families))


@query("cit_04", "SELECT * FROM {o_extracted}")
def cit_04(fr):
    return extracted(fr).select("claim_id", "family", "field_name", "hits", "outcome", "value_text", "span_start")


for n, family in ((16, "purchase_agreement"), (17, "cap_table"), (18, "memo"), (19, "irregular"), (20, "term_sheet")):
    query(f"cit_{n}", f"SELECT field_name, outcome, count(*) AS documents, count(DISTINCT value_text) AS distinct_values FROM {{o_extracted}} WHERE family = '{family}' GROUP BY 1, 2")(
        lambda fr, family=family: extracted(fr, family).groupBy("field_name", "outcome").agg(
            F.count("*").alias("documents"), F.countDistinct("value_text").alias("distinct_values")))


@query("cit_05", f"""SELECT claim_id, family AS claim_key, applicable_to AS closes, price_per_share FROM (SELECT *, {FAMILY_SQL} AS family FROM {{f_claim}}) WHERE source_class <> 'public_market_quote'
 UNION ALL SELECT c.claim_id, 'settlement', c.applicable_to, NULL FROM {{f_claim}} AS c JOIN {{o_extracted}} AS e ON e.claim_id = c.claim_id AND e.field_name = 'settlement_amount_received' AND e.outcome = 'cited'
 UNION ALL SELECT o.claim_id, 'quote_' || CAST(o.observed_on AS VARCHAR), o.observed_on, o.price_per_share FROM {{f_observation}} AS o JOIN {{f_claim}} AS c ON c.claim_id = o.claim_id AND c.source_class = 'public_market_quote'""", text="closes price_per_share")
def cit_05(fr):
    docs = fr["f_claim"].select("claim_id", "issued_date", "applicable_to", "price_per_share", F.when(F.col("source_class") == "public_market_quote", "quote").otherwise(citing.family_of()).alias("family"))
    return citing.claims_of_document(extracted(fr), docs, fr["f_observation"]).select("claim_id", "claim_key", "closes", "price_per_share")


@query("cit_06", """SELECT c.claim_id, CAST(c.price_per_share AS DECIMAL(26,6)) AS declared, f.value_numeric AS cited, c.price_per_share = f.value_numeric AS agrees FROM {f_claim} AS c LEFT JOIN {f_fact} AS f ON f.claim_id = c.claim_id AND f.field_name = 'fund_price_per_share' WHERE c.price_per_share IS NOT NULL""", text="declared cited")
def cit_06(fr):
    return citing.declared_against_cited(fr["f_claim"], fr["f_fact"], "price_per_share", "fund_price_per_share")


LIBRARY["o_proposal"] = f"""
SELECT claim_id, field_name, CASE WHEN length(quote) = 0 THEN 'quote_is_empty' WHEN hits = 0 THEN 'quote_not_found' WHEN hits > 1 THEN 'quote_is_ambiguous' WHEN ({tokens_sql('quote', 'value_text')}) <> 1 THEN 'quote_does_not_state_the_value' END AS refusal, CASE WHEN hits = 1 THEN CAST(instr(canonical_text, quote) - 1 AS INT) END AS span_start, canonical_text
FROM (SELECT p.*, s.canonical_text, CASE WHEN length(p.quote) = 0 THEN 0 ELSE len(string_split(s.canonical_text, p.quote)) - 1 END AS hits FROM {{f_proposal}} AS p JOIN {{f_statement}} AS s ON s.claim_id = p.claim_id)"""


def proposals(fr):
    return citing.bind_proposals(fr["f_proposal"], fr["f_statement"].select("claim_id", "canonical_text"), "claim_id")


@query("cit_07", "SELECT claim_id, field_name, refusal, span_start, refusal IS NULL AS accepted FROM {o_proposal}")
def cit_07(fr):
    return proposals(fr).select("claim_id", "field_name", "refusal", "span_start", "accepted")


LIBRARY["o_sentence"] = r"""
SELECT document_id, document_no, unnest(string_split(regexp_replace(trim(regexp_replace(canonical_text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.;]) ([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM {f_document}"""
LIBRARY["o_fragment"] = r"""
SELECT document_id AS fragment_id, regexp_extract(flat, '^(?:[^ ]* ){2}((?:[^ ]+ ){4}[^ ]+)', 1) AS fragment FROM (SELECT document_id, trim(regexp_replace(canonical_text, '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM {f_document})"""


@query("cit_08", """SELECT f.fragment_id, count(DISTINCT s.sentence) AS sentences, CASE WHEN count(DISTINCT s.sentence) = 1 THEN min(s.sentence) END AS sentence FROM (SELECT * FROM {o_fragment} WHERE fragment <> '') AS f
 LEFT JOIN (SELECT DISTINCT sentence FROM {o_sentence}) AS s ON contains(s.sentence, f.fragment) GROUP BY 1""")
def cit_08(fr):
    flat = F.trim(F.regexp_replace("canonical_text", r"[ \t\n\r\f\x0B]+", " "))
    fragments = fr["f_document"].select(F.col("document_id").alias("fragment_id"), F.regexp_extract(flat, r"^(?:[^ ]* ){2}((?:[^ ]+ ){4}[^ ]+)", 1).alias("fragment")).filter("fragment <> ''")
    return citing.sentence_for_fragment(fragments, fr["f_document"])


RELIANCE = (("executed_transaction_doc", "executed", "R1,R2"), ("administrator_statement", "not_applicable", "R1,R2"), ("press", "not_applicable", "R2"), ("company_communication", "not_applicable", ""))


@query("cit_09", """SELECT c.source_class, c.execution_status, CASE WHEN d.requirements IS NULL THEN 'undeclared' WHEN d.requirements = '' THEN 'declared_none' ELSE d.requirements END AS reliance, count(*) AS claims FROM {f_claim} AS c
 LEFT JOIN (VALUES ('executed_transaction_doc', 'executed', 'R1,R2'), ('administrator_statement', 'not_applicable', 'R1,R2'), ('press', 'not_applicable', 'R2'), ('company_communication', 'not_applicable', '')) AS d(source_class, execution_status, requirements)
 ON d.source_class = c.source_class AND d.execution_status = c.execution_status GROUP BY ALL""")
def cit_09(fr):
    dimension = F.broadcast(fr.spark.createDataFrame(list(RELIANCE), "source_class string, execution_status string, requirements string"))
    counted = fr["f_claim"].groupBy("source_class", "execution_status").agg(F.count("*").alias("claims"))
    reliance = F.when(F.col("requirements").isNull(), "undeclared").when(F.col("requirements") == "", "declared_none").otherwise(F.col("requirements"))
    return counted.join(dimension, ["source_class", "execution_status"], "left").select("source_class", "execution_status", reliance.alias("reliance"), "claims")


@query("cit_10", """SELECT f.claim_id, f.field_name, '{"field":"' || f.field_name || '","ranks":{' || string_agg('"' || r.requirement || '":' || CAST(coalesce(l.lead_position, n.size) AS VARCHAR), ',' ORDER BY r.requirement) || '},"value":"' || f.value_text || '"}' AS json
 FROM {f_fact} AS f JOIN {d_field} AS d ON d.field_name = f.field_name JOIN (SELECT requirement, count(*) AS size FROM {d_lead} GROUP BY 1) AS n ON contains(d.requirements, n.requirement) JOIN (SELECT DISTINCT requirement FROM {d_lead}) AS r ON r.requirement = n.requirement
 LEFT JOIN {d_lead} AS l ON l.requirement = r.requirement AND l.field_name = f.field_name GROUP BY f.claim_id, f.field_name, f.value_text""")
def cit_10(fr):
    names = fr["f_fact"].select("field_name").distinct()
    ranks = citing.answer_ranks(names).groupBy("field_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("requirement", "answer_rank")))).alias("ranks"))
    return fr["f_fact"].join(ranks, "field_name").select("claim_id", "field_name", F.to_json(F.struct(F.col("field_name").alias("field"), "ranks", F.col("value_text").alias("value"))).alias("json"))


@query("cit_11", r"""SELECT claim_id, field_name, CASE WHEN m.expected IS NULL AND m.absent IS NULL THEN 'not_in_manifest' WHEN coalesce(m.absent, false) AND c.quote IS NOT NULL THEN 'stated_absent_but_cited' WHEN coalesce(m.absent, false) THEN NULL WHEN c.quote IS NULL THEN 'expected_but_not_cited'
 WHEN c.value_text <> m.expected THEN 'value_differs' WHEN m.distractor IS NOT NULL AND contains(c.quote, m.distractor) THEN 'distractor_cited' WHEN NOT contains(regexp_replace(m.passage, ' +', ' ', 'g'), c.quote) THEN 'outside_the_passage' END AS problem
 FROM {f_expected} AS m FULL JOIN {f_cited} AS c USING (claim_id, field_name)""")
def cit_11(fr):
    return citing.wrong_passages(fr["f_cited"], fr["f_expected"]).select("claim_id", "field_name", "problem")


@query("cit_12", f"SELECT count(*) AS citations, count(*) FILTER (NOT {RESOLVES}) AS failing FROM {{f_fact}} AS f JOIN {{f_statement}} AS s ON s.claim_id = f.claim_id")
def cit_12(fr):
    """Verified against what was written and read back, not against the frame it was written from."""
    from attestor.sources import publish
    written = publish.staged_copy(fr["f_statement"].select("claim_id", "canonical_text"), "exported_text")
    return citing.census(citing.bind_facts(fr["f_fact"], written)).select("citations", "failing")


@query("cit_13", """SELECT claim_id, field_name, CASE WHEN state = 'approved' AND promoted_by IS NULL THEN 'approved_without_a_decision' WHEN state = 'approved' THEN 'promoted_by_another_decision' ELSE 'candidate_carries_a_promotion' END AS rule
 FROM (SELECT *, CASE WHEN part_key % 4 <> 3 THEN part_key END AS promoted_by FROM {f_fact}) AS f LEFT JOIN {f_decision} AS d ON d.decision_id = f.promoted_by
 WHERE (state = 'approved' AND (promoted_by IS NULL OR NOT coalesce(d.decision_type = 'transcription' AND d.status = 'approved', false))) OR (state = 'candidate' AND promoted_by IS NOT NULL)""")
def cit_13(fr):
    facts = fr["f_fact"].withColumn("promoted_by", F.when(F.col("part_key") % 4 != 3, F.col("part_key")))
    return citing.promotion_violations(facts, fr["f_decision"]).select("claim_id", "field_name", "rule")


LIBRARY["o_lineage"] = """
SELECT e.figure_id, i.fact_id AS leaf_id, i.state, i.quote FROM (SELECT DISTINCT figure_id, figure_id AS node FROM {f_figure_input}
 UNION ALL SELECT figure_id, child_id FROM {f_figure_edge} WHERE figure_id LIKE 'H%' UNION ALL SELECT a.figure_id, b.child_id FROM {f_figure_edge} AS a JOIN {f_figure_edge} AS b ON b.figure_id = a.child_id WHERE a.figure_id LIKE 'F%') AS e
JOIN {f_figure_input} AS i ON i.figure_id = e.node"""


@query("cit_14", "SELECT figure_id, count(*) AS leaves, count(*) FILTER (state = 'candidate') AS candidate_leaves, count(*) FILTER (quote IS NULL) AS uncited_leaves FROM {o_lineage} GROUP BY 1")
def cit_14(fr):
    leaves = fr["f_figure_input"].select("figure_id", F.col("fact_id").alias("leaf_id"), "state", "quote")
    reached = citing.lineage(fr["f_figure_edge"], leaves)
    return reached.groupBy("figure_id").agg(F.count("*").alias("leaves"), F.count_if(F.col("state") == "candidate").alias("candidate_leaves"), F.count_if(F.col("quote").isNull()).alias("uncited_leaves"))


@query("cit_14_sources", "SELECT figure_id, ordinal, fact_id, child_id FROM {f_figure_input} WHERE (fact_id IS NULL) = (child_id IS NULL)")
def cit_14_sources(fr):
    """Each input names exactly one source."""
    return fr["f_figure_input"].filter(F.col("fact_id").isNull() == F.col("child_id").isNull()).select("figure_id", "ordinal", "fact_id", "child_id")


@query("cit_15", """SELECT p.claim_id, r.claim_id IS NOT NULL AS replayed, count(*) AS proposed, count(*) FILTER (r.claim_id IS NOT NULL AND refusal IS NULL) AS accepted, count(*) FILTER (r.claim_id IS NOT NULL AND refusal IS NOT NULL) AS refused
 FROM {o_proposal} AS p LEFT JOIN (SELECT s.claim_id FROM {f_statement} AS s JOIN {f_recorded_text} AS t ON t.claim_id = s.claim_id AND substr(sha256(t.canonical_text), 1, 16) = substr(sha256(s.canonical_text), 1, 16)) AS r ON r.claim_id = p.claim_id GROUP BY 1, 2""")
def cit_15(fr):
    """Recordings name the text they were made on by a prefix of its hash; one whose text has changed since is told and not replayed."""
    recorded = fr["f_recorded_text"].select("claim_id", F.substring(F.sha2("canonical_text", 256), 1, 16).alias("prefix"))
    replayed = citing.replay(fr["f_proposal"], recorded, fr["f_statement"], "claim_id")
    return replayed.groupBy("claim_id", "replayed").agg(
        F.count("*").alias("proposed"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


# Two families of other houses: a schedule of purchasers that several funds share, and a letter that states values by date.
SCHEDULE = (extraction.Rule("transfer_notice", "schedule_row", r"(?m)^(\S[^\t\r\n]*?)(?:\t| {2,})([0-9][0-9,]*)(?:\t| {2,})\$ ?([0-9.]+)[ \t\r]*$", (("fund_shares", 2), ("fund_price_per_share", 3)), where=((1, "purchaser"),)),
            extraction.Rule("transfer_notice", "closing", r"(?i)closing\s+shall\s+occur\s+on\s+([A-Z][a-z]+\s+[0-9]{1,2},\s+[0-9]{4})", (("closing_date", 1),), where=((1, "closes_on"),)),
            extraction.Rule("transfer_notice", "legend", r"(?i)legend\s+class\s+([a-z])\b", (("legend_class", 1),), required=False))
LETTER = (extraction.Rule("value_letter", "value", r"Fair\s+value\s+at\s+([A-Z][a-z]+\s+[0-9]{1,2},\s+[0-9]{4}):\s+USD\s+([0-9,]+\.[0-9]{4})", (("concluded_fair_value_usd", 2),), claim_group=1),
          extraction.Rule("value_letter", "basis", r"(?m)^Basis: ([a-z_]+)$", (("stated_basis", 1),), required=False))


def transfer_notices(fr):
    """A notice a lot: header and total lines, the row of another purchaser, tabs or blanks, line ends of two kinds, the purchaser named again in prose."""
    key = F.col("order_key")
    name = F.concat("legal_name", F.lit(", L.P."))
    gap = F.when(key % 5 == 1, "\t").otherwise(F.lit("          "))
    row = F.concat(name, gap, F.format_number("shares", 0), gap, F.lit("$"), F.when(key % 4 == 2, " ").otherwise(""), F.col("entry_pps").cast("string"))
    rows = F.when(key % 11 == 3, F.lit("no row of the purchaser")).when(key % 13 == 5, F.concat(row, F.lit("\n"), row)).otherwise(row)
    day = F.date_format("acquired_date", "MMMM d, yyyy")
    spelled = F.when(key % 7 == 2, F.replace(day, F.lit(" "), F.lit("\n"))).otherwise(day)
    text = F.concat(F.lit("EXHIBIT A\n\nSchedule  of Purchasers (see Section 2)\nName of Purchaser          Shares          Price\nOther Growth Partners, L.P."), gap, F.lit("77"), gap, F.lit("$9.99\n"), rows,
                    F.lit("\nTOTAL          "), F.format_number(F.col("shares") + 77, 0), F.lit("\n\nThe closing shall occur on "), spelled, F.lit(".\nBy "), name, F.lit(" for "), F.format_number("shares", 0), F.lit(" shares at $"), F.col("entry_pps").cast("string"),
                    F.when(key % 3 == 0, F.concat(F.lit("\nLegend class "), "security_class")).otherwise(""))
    lots = fr["f_lot"].filter("shares IS NOT NULL").join(fr["f_holding"].select("holding_id", "fund_id"), "holding_id").join(fr["f_fund"].select("fund_id", "legal_name"), "fund_id")
    return lots.select(F.col("lot_id").alias("claim_id"), F.lit("transfer_notice").alias("family"), name.alias("purchaser"), day.alias("closes_on"), F.when(key % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("canonical_text"))


@query("cit_16_schedule", """SELECT lot_id AS claim_id, field_name, CASE WHEN field_name = 'closing_date' THEN 1 WHEN field_name = 'legend_class' THEN CASE WHEN order_key % 3 = 0 THEN 1 ELSE 0 END WHEN order_key % 11 = 3 THEN 0 WHEN order_key % 13 = 5 THEN 2 ELSE 1 END::INT AS hits,
 CASE WHEN field_name = 'closing_date' OR (field_name = 'legend_class' AND order_key % 3 = 0) THEN 'cited' WHEN field_name = 'legend_class' THEN 'not_stated' WHEN order_key % 11 = 3 THEN 'pattern_matched_nothing' WHEN order_key % 13 = 5 THEN 'pattern_is_ambiguous' ELSE 'cited' END AS outcome,
 CASE WHEN field_name = 'closing_date' THEN strftime(acquired_date, '%B %-d, %Y') WHEN field_name = 'legend_class' THEN CASE WHEN order_key % 3 = 0 THEN security_class END WHEN order_key % 11 <> 3 AND order_key % 13 <> 5 THEN CASE WHEN field_name = 'fund_shares' THEN format('{:,}', CAST(shares AS BIGINT)) ELSE CAST(entry_pps AS VARCHAR) END END AS value_text, true AS resolves
 FROM {f_lot} CROSS JOIN (VALUES ('fund_shares'), ('fund_price_per_share'), ('closing_date'), ('legend_class')) AS n(field_name) WHERE shares IS NOT NULL""")
def cit_16_schedule(fr):
    """Several groups of one rule, parameters (purchaser, date), required and optional rules, hostile layout."""
    notices = transfer_notices(fr)
    got = extraction.extract(notices, SCHEDULE)
    resolves = F.coalesce(F.expr("substring(canonical_text, span_start + 1, span_end - span_start)") == F.col("quote"), F.col("quote").isNull())
    return got.join(notices.select("claim_id", "canonical_text"), "claim_id").select("claim_id", "field_name", "hits", "outcome", "value_text", resolves.alias("resolves"))


def value_letters(fr):
    """A letter a holding: a value for each packet date, wrapped lines, a first estimate that is no value, one date stated twice."""
    key = F.col("cust_key")
    day = F.date_format("period_date", "MMMM d, yyyy")
    day = F.when(key % 4 == 1, F.replace(day, F.lit(", "), F.lit(",\n"))).otherwise(day)
    line = F.concat(F.lit("Fair value at "), day, F.lit(": USD "), F.format_number("reported_amount", 4))
    line = F.when((key % 9 == 4) & (F.year("period_date") == 1999), F.concat(line, F.lit("\nagain: "), line)).otherwise(line)
    line = F.concat(F.lit("Fair value at "), day, F.lit(" as first estimated: USD 1.0000\n"), line)
    marks = fr["f_latest_mark"].filter("audit_scope = 'packet'").groupBy("holding_id", "cust_key").agg(F.array_sort(F.collect_list(F.struct("period_date", line.alias("line")))).alias("lines"), F.max("basis").alias("basis"))
    text = F.concat(F.lit("To the partners\n"), F.array_join(F.transform("lines", lambda x: x.line), "\n"), F.when(F.col("basis").isNotNull(), F.concat(F.lit("\nBasis: "), "basis")).otherwise(""))
    return marks.select(F.col("holding_id").alias("claim_id"), F.lit("value_letter").alias("family"), text.alias("canonical_text"))


@query("cit_18_dated", """SELECT holding_id AS claim_id, 'concluded_fair_value_usd' AS field_name, strftime(period_date, '%B %-d, %Y') AS claim_key, CASE WHEN cust_key % 9 = 4 AND year(period_date) = 1999 THEN 'pattern_is_ambiguous' ELSE 'cited' END AS outcome,
 CASE WHEN cust_key % 9 = 4 AND year(period_date) = 1999 THEN NULL ELSE format('{:,}', CAST(floor(reported_amount) AS BIGINT)) || '.' || right(CAST(reported_amount AS VARCHAR), 4) END AS value_text FROM {f_latest_mark} WHERE audit_scope = 'packet'
 UNION ALL SELECT holding_id, 'stated_basis', NULL, CASE WHEN max(basis) IS NULL THEN 'not_stated' ELSE 'cited' END, max(basis) FROM {f_latest_mark} WHERE audit_scope = 'packet' GROUP BY holding_id""")
def cit_18_dated(fr):
    """One document gives a claim for each date it states a value at; a date stated twice is refused for itself alone."""
    return extraction.extract(value_letters(fr), LETTER).select("claim_id", "field_name", "claim_key", "outcome", "value_text")


@query("cit_21", f"SELECT f.claim_id, f.field_name, f.span_start, f.span_end, {RESOLVES} AS verified FROM {{f_fact}} AS f JOIN {{f_statement}} AS s ON s.claim_id = f.claim_id")
def cit_21(fr):
    return bound(fr).select("claim_id", "field_name", "span_start", "span_end", (~F.array_contains("violations", "span_does_not_resolve")).alias("verified"))


@query("cit_22", """SELECT claim_id, contains(body, strftime(issued_date, '%B %-d, %Y')) OR contains(body, strftime(issued_date, '%m/%d/%Y')) AS stated, dayname(issued_date) AS weekday FROM (
 SELECT claim_id, issued_date, 'Dated ' || CASE part_key % 4 WHEN 0 THEN strftime(issued_date, '%B %-d, %Y') WHEN 1 THEN strftime(issued_date, '%m/%d/%Y') WHEN 2 THEN strftime(issued_date + INTERVAL 1 YEAR, '%m/%d/%Y') ELSE CAST(issued_date AS VARCHAR) END AS body FROM {f_claim})""")
def cit_22(fr):
    p, day = F.col("part_key") % 4, F.col("issued_date")
    long, short = citing.spelled_dates(day)
    body = F.concat(F.lit("Dated "), F.when(p == 0, long).when(p == 1, short).when(p == 2, F.date_format(F.add_months(day, 12), "MM/dd/yyyy")).otherwise(day.cast("string")))
    return fr["f_claim"].select("claim_id", citing.states_day(body, day).alias("stated"), F.date_format(day, "EEEE").alias("weekday"))


@query("cit_23", """SELECT claim_id, 'series_' || priced_class || '1' AS named, declared FROM (SELECT claim_id, priced_class, CASE WHEN part_key % 19 = 0 THEN 'series_z9' ELSE 'series_' || priced_class || '1' END AS declared FROM {f_claim} WHERE priced_class IS NOT NULL) WHERE declared <> 'series_' || priced_class || '1'""")
def cit_23(fr):
    named = S.class_slug(F.concat(F.upper("priced_class"), F.lit("-1")))
    declared = F.when(F.col("part_key") % 19 == 0, "series_z9").otherwise(F.concat(F.lit("series_"), "priced_class", F.lit("1")))
    return fr["f_claim"].filter("priced_class IS NOT NULL").select("claim_id", named.alias("named"), declared.alias("declared")).filter("named <> declared")


SCALED_RE, STEP_RE, FORMS = guard.SCALED, "(?i)" + guard.STEP_DONE, {v: f.replace("(?<!in)", "") for v, f in guard.VERDICT_FORMS.items()}
OWN = "contains(lower(restatement), lower(verdict_label)) OR " + " OR ".join(f"(verdict = '{v}' AND regexp_matches(restatement, '(?i){f}'))" for v, f in FORMS.items())
OTHER = " OR ".join(f"(verdict <> '{v}' AND regexp_matches(restatement, '(?i){f}'))" for v, f in FORMS.items())
SCALE = lambda c: f"[replace(lower(x), ' ', '') for x in regexp_extract_all({c}, '{SCALED_RE}')]"
G1 = "CASE WHEN NOT regexp_matches(restatement, '\\S') THEN 'returned_nothing' WHEN length(restatement) > 1400 THEN 'over_the_cap' END"
G2 = f"len(list_filter({SCALE('restatement')}, lambda q: NOT list_contains({SCALE('payload')}, q))) > 0"
G3 = f"len(list_filter({FIGURES_SQL.replace('{x}', 'restatement')}, lambda q: NOT list_contains({FIGURES_SQL.replace('{x}', 'payload')}, q))) > 0"
G4 = f"(outstanding AND regexp_matches(restatement, '{STEP_RE}') AND NOT regexp_matches(restatement, '(?i)(?:\\bno\\b[^.]{{0,30}}|\\b(?:not|yet)\\b[^.]{{0,29}}|\\bnone\\b[^.]{{0,28}}|\\bnever\\b[^.]{{0,27}}|\\bnobody\\b[^.]{{0,26}}|\\b(?:nothing|neither)\\b[^.]{{0,25}}){STEP_RE[4:]}'))"
G5 = f"CASE WHEN NOT ({OWN}) THEN 'verdict_not_named' WHEN {OTHER} THEN 'another_verdict_named' END"


@query("grd_01", f"SELECT assessment_id, {G1} AS refusal FROM {{f_restatement}}")
def grd_01(fr):
    return fr["f_restatement"].select("assessment_id", guard.empty_or_long(F.col("restatement")).alias("refusal"))


@query("grd_02", f"SELECT assessment_id, {G2} AS invented_scale FROM {{f_restatement}}")
def grd_02(fr):
    return fr["f_restatement"].select("assessment_id", (F.size(guard.invented_scale(F.col("restatement"), F.col("payload"))) > 0).alias("invented_scale"))


@query("grd_03", f"SELECT assessment_id, {G3} AS invented_figure FROM {{f_restatement}}")
def grd_03(fr):
    return fr["f_restatement"].select("assessment_id", (F.size(guard.invented_figures(F.col("restatement"), F.col("payload"))) > 0).alias("invented_figure"))


@query("grd_04", f"SELECT assessment_id, {G4} AS told_as_done FROM {{f_restatement}}")
def grd_04(fr):
    return fr["f_restatement"].select("assessment_id", guard.step_told_as_done(F.col("restatement"), F.col("outstanding")).alias("told_as_done"))


@query("grd_05", f"SELECT assessment_id, {G5} AS problem FROM {{f_restatement}}")
def grd_05(fr):
    return fr["f_restatement"].select("assessment_id", guard.verdict_problem(F.col("restatement"), F.col("verdict"), F.col("verdict_label")).alias("problem"))


@query("grd_06", f"""SELECT assessment_id, refusal, refusal IS NULL AS accepted FROM (SELECT assessment_id, coalesce({G1}, CASE WHEN {G2} THEN 'magnitude_not_in_record' END, CASE WHEN {G3} THEN 'figure_not_in_record' END, CASE WHEN {G4} THEN 'outstanding_step_told_as_done' END, {G5}) AS refusal FROM {{f_restatement}})""")
def grd_06(fr):
    return guard.judge(fr["f_restatement"], label="verdict_label").select("assessment_id", "refusal", "accepted")
