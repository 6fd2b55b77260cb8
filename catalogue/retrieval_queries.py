"""RET, WIN-10/14 and SET-07: passages ranked for every case and measured against the ledger's own reliance."""

import datetime

from pyspark.sql import functions as F

from attestor import model
from attestor.operators import retrieval
from attestor.sources.ledger import from_derived
from catalogue import LIBRARY, query

# The test documents are invented prose, so the test queries use its words.
TEST_QUERIES = (("R1", "The hean thand reedings and onth"), ("R2", "ouen of shanti que enaux"), ("R4", "wher thest erblely la"))
LIBRARY["o_query"] = r"""
SELECT requirement, list_sort(list_distinct([CASE WHEN length(w) > 5 THEN regexp_replace(w, '(ings|ing|edly|ed|es|s|ly)$', '') ELSE w END for w in regexp_extract_all(lower(query), '([0-9A-Za-z][0-9A-Za-z''’-]*)')
 if not list_contains(['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with','per'], w)])) AS terms
FROM (VALUES ('R1', 'The hean thand reedings and onth'), ('R2', 'ouen of shanti que enaux'), ('R4', 'wher thest erblely la')) AS q(requirement, query)"""
LIBRARY["o_line"] = r"""
SELECT document_no, document_id, canonical_text, CAST(generate_subscripts(string_split(canonical_text, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(canonical_text, chr(10))) AS line FROM {f_document}"""
LIBRARY["o_hit"] = r"""
SELECT l.document_no, l.document_id, q.requirement, l.line_no, t.term, CAST(len([w for w in l.ws if starts_with(w, t.term)]) AS INT) AS n
FROM (SELECT document_no, document_id, line_no, regexp_extract_all(lower(line), '([0-9A-Za-z][0-9A-Za-z''’-]*)') AS ws FROM {o_line}) AS l CROSS JOIN {o_query} AS q, (SELECT unnest(q.terms) AS term) AS t"""
LIBRARY["o_textrank"] = """
SELECT document_no, document_id, requirement, CAST(round(sum(w), 6) AS DECIMAL(18,6)) AS text_rank FROM (SELECT document_no, document_id, requirement, term, list_sum([1.0::DOUBLE / (i * i) for i in range(1, CAST(sum(n) AS BIGINT) + 1)]) AS w FROM {o_hit} GROUP BY 1, 2, 3, 4 HAVING sum(n) > 0) GROUP BY 1, 2, 3"""
LIBRARY["o_best"] = """
SELECT document_no, requirement, line_no, matched FROM (SELECT document_no, requirement, line_no, count(*) AS c, list(term ORDER BY term) AS matched, row_number() OVER (PARTITION BY document_no, requirement ORDER BY count(*) DESC, line_no) AS rn
 FROM {o_hit} WHERE n > 0 GROUP BY 1, 2, 3) WHERE rn = 1"""
LIBRARY["o_passage"] = r"""
SELECT document_no, document_id, requirement, text_rank, line_no, matched, CAST(low + head + lead AS INT) AS span_start, CAST(low + head + lead + length(quote) AS INT) AS span_end, quote, canonical_text FROM (
SELECT *, length(win) - length(regexp_replace(win, '^\s+', '')) AS lead, regexp_replace(regexp_replace(win, '^\s+', ''), '\s+$', '') AS quote FROM (
SELECT *, substr(body, CAST(head + 1 AS INT), CAST(tail - head AS INT)) AS win FROM (
SELECT *, CASE WHEN length(body) > 400 THEN length(regexp_replace(substr(body, 1, CAST(cut AS INT)), '\S+$', '')) ELSE 0 END AS head, CASE WHEN length(body) > 400 THEN stop + length(regexp_extract(substr(body, CAST(stop + 1 AS INT)), '^(\S*)', 1)) ELSE length(body) END AS tail FROM (
SELECT *, least(length(body), cut + 400) AS stop FROM (
SELECT *, greatest(0, length(regexp_extract(lower(body), '^((?:.*?[^0-9a-z''’-])??)(?:' || array_to_string(matched, '|') || ')', 1)) - 200) AS cut FROM (
SELECT r.*, b.line_no, b.matched, l.canonical_text, regexp_replace(regexp_replace(l.line, '^\s+', ''), '\s+$', '') AS body,
 CASE WHEN b.line_no > 0 THEN length(array_to_string(string_split(l.canonical_text, chr(10))[1:b.line_no], chr(10))) + 1 ELSE 0 END + length(l.line) - length(regexp_replace(l.line, '^\s+', '')) AS low
FROM {o_textrank} AS r JOIN {o_best} AS b ON b.document_no = r.document_no AND b.requirement = r.requirement JOIN {o_line} AS l ON l.document_no = r.document_no AND l.line_no = b.line_no))))))
WHERE length(body) > 0"""
LIBRARY["o_gold"] = """
SELECT DISTINCT r.holding_id, r.requirement, d.period_id, d.period_date, c.document_no FROM {f_claim_requirement} AS r JOIN {f_claim} AS c ON c.claim_id = r.claim_id JOIN {o_date} AS d ON d.fund_id = c.fund_id
 AND c.applicable_from <= d.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= d.period_date)"""


def ranked_sql(case: str, join: str, window: bool = True) -> str:
    within = "AND c.applicable_from <= g.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= g.period_date)" if window else ""
    return f"""
SELECT * FROM (SELECT g.*, c.claim_id, c.document_no, p.document_id, p.span_start, p.text_rank, row_number() OVER (PARTITION BY {case} ORDER BY coalesce(f.preference, 10), abs(date_diff('day', c.issued_date, g.period_date)), p.text_rank DESC, p.document_id, p.span_start, c.claim_id) AS place
FROM (SELECT DISTINCT {join} FROM {{o_gold}}) AS g JOIN {{f_claim}} AS c ON {'c.holding_id = g.holding_id' if 'holding_id' in join else 'true'} {within}
JOIN {{o_passage}} AS p ON p.document_no = c.document_no AND p.requirement = g.requirement LEFT JOIN {{d_preference}} AS f ON f.source_class = c.source_class AND f.execution_status = c.execution_status) WHERE place <= 5"""


LIBRARY["o_top"] = ranked_sql("g.holding_id, g.requirement, g.period_id", "holding_id, requirement, period_id, period_date")
LIBRARY["o_top_open"] = ranked_sql("g.holding_id, g.requirement, g.period_id", "holding_id, requirement, period_id, period_date", window=False)
LIBRARY["o_top_blind"] = ranked_sql("g.requirement, g.period_date", "requirement, period_date")


def case_sql(top: str, keys: str) -> str:
    on = " AND ".join(f"t.{k} = g.{k}" for k in keys.split(", "))
    return f"""
SELECT g.holding_id, g.requirement, g.period_id, count(*) AS relevant, count(t.place) AS found, min(t.place) AS best_place, coalesce(max(n.retrieved), 0) AS retrieved FROM {{o_gold}} AS g
LEFT JOIN (SELECT {keys}, document_no, min(place) AS place FROM {{{top}}} GROUP BY ALL) AS t ON {on} AND t.document_no = g.document_no
LEFT JOIN (SELECT {keys}, count(DISTINCT document_no) AS retrieved FROM {{{top}}} GROUP BY ALL) AS n ON {on.replace('t.', 'n.')} GROUP BY 1, 2, 3"""


LIBRARY["o_case"] = case_sql("o_top", "holding_id, requirement, period_id")
LIBRARY["o_case_open"] = case_sql("o_top_open", "holding_id, requirement, period_id")
LIBRARY["o_case_blind"] = case_sql("o_top_blind", "requirement, period_date")
RECALL = "SELECT count(*) AS cases, count(*) FILTER (best_place <= 1) AS any_at_1, count(*) FILTER (best_place <= 3) AS any_at_3, count(*) FILTER (best_place <= 5) AS any_at_5, count(*) FILTER (found = relevant) AS all_relevant, CAST(sum(retrieved) AS BIGINT) AS candidates FROM {t}"
CASE = ["holding_id", "requirement", "period_id"]


def queries_frame(fr):
    return fr.spark.createDataFrame(list(TEST_QUERIES), "requirement string, query string")


def index(fr):
    return retrieval.open_index(fr.spark, fr.written("index", lambda path: retrieval.build_index(fr["f_document"], path)))


def matched(fr):
    return retrieval.matched_documents(index(fr), queries_frame(fr))


def found(fr):
    return retrieval.passages(matched(fr), fr["f_document"])


def top(fr, **options):
    return retrieval.ranked(from_derived(fr), matched(fr), **options)


@query("ret_01", "SELECT DISTINCT document_id, requirement FROM {o_hit} WHERE n > 0")
def ret_01(fr):
    return matched(fr).select("document_id", "requirement")


@query("ret_02", "SELECT document_id, requirement, text_rank FROM {o_textrank}", text="text_rank")
def ret_02(fr):
    return matched(fr).select("document_id", "requirement", "text_rank")


@query("ret_03", "SELECT c.claim_id, coalesce(p.preference, 10) AS preference FROM {f_claim} AS c LEFT JOIN {d_preference} AS p ON p.source_class = c.source_class AND p.execution_status = c.execution_status")
def ret_03(fr):
    preferred = F.broadcast(model.preference(fr.spark))
    return fr["f_claim"].join(preferred, ["source_class", "execution_status"], "left").select("claim_id", F.coalesce("preference", F.lit(len(model.PREFERENCE))).alias("preference"))


@query("ret_04", "SELECT document_no, requirement, line_no, array_to_string(matched, ',') AS matched FROM {o_best}")
def ret_04(fr):
    return matched(fr).select("document_no", "requirement", "line_no", F.concat_ws(",", "matched").alias("matched"))


@query("ret_05", "SELECT document_id, requirement, length(quote) AS chars, quote FROM {o_passage}")
def ret_05(fr):
    return found(fr).select("document_id", "requirement", F.length("quote").alias("chars"), "quote")


@query("ret_06", "SELECT document_id, requirement, span_start, span_end, 1 AS page, CAST((length(substr(canonical_text, 1, span_end - 1)) - length(replace(substr(canonical_text, 1, span_end - 1), quote, ''))) // length(quote) AS INT) AS occurrence FROM {o_passage}")
def ret_06(fr):
    return found(fr).select("document_id", "requirement", "span_start", "span_end", "page", "occurrence")


@query("ret_07", "SELECT holding_id, requirement, period_id, claim_id, document_id, span_start, place FROM {o_top}")
def ret_07(fr):
    return retrieval.quoted(top(fr), fr["f_document"]).select("holding_id", "requirement", "period_id", "claim_id", "document_id", "span_start", F.col("place").cast("bigint").alias("place"))


@query("win_10", "SELECT requirement, period_date, claim_id, document_id, place FROM {o_top_blind}", text="period_date")
def win_10(fr):
    return top(fr, entity_scoped=False).select("requirement", "period_date", "claim_id", "document_id", F.col("place").cast("bigint").alias("place"))


@query("ret_08", "SELECT conv_id, turn, len([w for w in regexp_extract_all(lower(text), '([0-9A-Za-z][0-9A-Za-z''’-]*)') if w not in ('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with','per')]) = 0 AS refused FROM conversations")
def ret_08(fr):
    asked = fr["conversations"].select("conv_id", "turn", F.col("text").alias("query"))
    return retrieval.query_terms(asked).select("conv_id", "turn", F.col("refusal").isNotNull().alias("refused"))


@query("ret_09", "SELECT holding_id, requirement, period_id, count(*) AS documents FROM {o_gold} GROUP BY 1, 2, 3")
def ret_09(fr):
    return retrieval.gold_cases(from_derived(fr)).groupBy(*CASE).agg(F.count("*").alias("documents"))


@query("set_07", "SELECT holding_id, requirement, period_id, found > 0 AS any_relevant, found = relevant AS all_relevant, retrieved FROM {o_case}")
def set_07(fr):
    cases = retrieval.recall_per_case(from_derived(fr), top(fr), CASE)
    return cases.select(*CASE, (F.col("found") > 0).alias("any_relevant"), (F.col("found") == F.col("relevant")).alias("all_relevant"), "retrieved")


@query("ret_10", RECALL.replace("{t}", "{o_case}"))
def ret_10(fr):
    return retrieval.recall(retrieval.recall_per_case(from_derived(fr), top(fr), CASE))


@query("ret_10_open", RECALL.replace("{t}", "{o_case_open}"))
def ret_10_open(fr):
    return retrieval.recall(retrieval.recall_per_case(from_derived(fr), top(fr, apply_window=False), CASE))


@query("ret_10_blind", RECALL.replace("{t}", "{o_case_blind}"))
def ret_10_blind(fr):
    return retrieval.recall(retrieval.recall_per_case(from_derived(fr), top(fr, entity_scoped=False), ["requirement", "period_date"]))


@query("win_14", "SELECT requirement, count(*) FILTER (best_place <= 1) AS at_1, count(*) FILTER (best_place <= 3) AS at_3, count(*) FILTER (best_place <= 5) AS at_5 FROM {o_case} GROUP BY 1")
def win_14(fr):
    cases = retrieval.recall_per_case(from_derived(fr), top(fr), CASE)
    return cases.groupBy("requirement").agg(*[F.count_if(F.col("best_place") <= k).alias(f"at_{k}") for k in (1, 3, 5)])


@query("ret_11", "SELECT holding_id, requirement, period_id, relevant FROM {o_case} WHERE found = 0")
def ret_11(fr):
    return retrieval.recall_per_case(from_derived(fr), top(fr), CASE).filter("found = 0").select(*CASE, "relevant")


#: Requests of every holding with an odd number, one that is of stop words, one that no text answers, and one of a holding without claims.
LIBRARY["o_ask"] = """
SELECT holding_id || '/' || q.requirement AS request_id, holding_id, DATE '1999-12-31' AS period_date, q.requirement,
 CASE WHEN cust_key % 20 = 7 THEN q.query WHEN cust_key % 10 = 3 THEN 'there is the' WHEN cust_key % 10 = 5 THEN 'zzzzunheard' ELSE q.query END AS query
FROM {f_holding} CROSS JOIN (VALUES ('R1', 'The hean thand reedings and onth'), ('R2', 'ouen of shanti que enaux'), ('R4', 'wher thest erblely la')) AS q(requirement, query) WHERE cust_key % 2 = 1"""
LIBRARY["o_answer"] = """
SELECT g.request_id, c.claim_id, p.document_id, p.quote, p.span_start, row_number() OVER (PARTITION BY g.request_id ORDER BY coalesce(f.preference, 10), abs(date_diff('day', c.issued_date, g.period_date)), p.text_rank DESC, p.document_id, p.span_start, c.claim_id) AS place
 FROM {o_ask} AS g JOIN {f_claim} AS c ON c.holding_id = g.holding_id AND c.applicable_from <= g.period_date AND (c.applicable_to IS NULL OR c.applicable_to >= g.period_date)
 JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id AND r.requirement = g.requirement JOIN {o_passage} AS p ON p.document_no = c.document_no AND p.requirement = g.requirement
 LEFT JOIN {d_preference} AS f ON f.source_class = c.source_class AND f.execution_status = c.execution_status WHERE g.query NOT IN ('there is the', 'zzzzunheard') QUALIFY place <= 5"""


def requests_frame(fr):
    key = F.col("cust_key")
    asked = F.when(key % 20 == 7, F.col("query")).when(key % 10 == 3, "there is the").when(key % 10 == 5, "zzzzunheard").otherwise(F.col("query"))
    return fr["f_holding"].filter(key % 2 == 1).crossJoin(F.broadcast(queries_frame(fr))).select(
        F.concat_ws("/", "holding_id", "requirement").alias("request_id"), "holding_id", F.lit(datetime.date(1999, 12, 31)).alias("period_date"), "requirement", asked.alias("query"))


@query("ret_12", "SELECT request_id, claim_id, document_id, quote, span_start, place FROM {o_answer}")
def ret_12(fr):
    _, answers = retrieval.search(from_derived(fr), index(fr), fr["f_document"], requests_frame(fr))
    return answers.select("request_id", "claim_id", "document_id", "quote", "span_start", F.col("place").cast("bigint").alias("place"))


@query("ret_12_outcome", """SELECT g.request_id, CASE WHEN NOT EXISTS (SELECT 1 FROM {f_claim} AS c WHERE c.holding_id = g.holding_id) THEN 'unknown_holding' WHEN g.query = 'there is the' THEN 'query_has_no_search_terms' WHEN count(a.claim_id) = 0 THEN 'none_matched' ELSE 'found' END AS outcome, count(a.claim_id) AS passages
 FROM {o_ask} AS g LEFT JOIN {o_answer} AS a ON a.request_id = g.request_id GROUP BY g.request_id, g.holding_id, g.query""")
def ret_12_outcome(fr):
    outcomes, _ = retrieval.search(from_derived(fr), index(fr), fr["f_document"], requests_frame(fr))
    return outcomes
