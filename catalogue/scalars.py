"""FN: scalar expressions over whole frames."""

from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from catalogue import LIBRARY, query

CELL = r"""TRY_CAST(CASE WHEN {c} LIKE '(%' AND {c} LIKE '%)' THEN '-' || substr({c}, 2, length({c}) - 2) ELSE {c} END AS DECIMAL(38,6))"""


def cell_number(column: str) -> str:
    return CELL.replace("{c}", f"replace(replace(trim({column}), ',', ''), '$', '')")


LIBRARY["o_grid_long"] = """
SELECT sheet, company, cost_cell, replace(period_column, 'p_', '') AS label, cell FROM (
  UNPIVOT (SELECT * FROM {f_grid}) ON COLUMNS('^p_') INTO NAME period_column VALUE cell)"""

LIBRARY["o_rows"] = """
SELECT sheet_no, title, row_no, c0, c1, c3, c4, c5, trim(c5) AS t, trim(split_part(title, ' (', 1)) AS company FROM {f_breakdown}"""

RANGE_SQL = r"""CASE WHEN regexp_full_match({t}, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime({t}, '%m/%d/%Y') AS DATE)
 WHEN regexp_full_match({t}, '\d{1,2}/\d{4}') THEN CAST(try_strptime('1/' || {t}, '%d/%m/%Y') AS DATE){last1}
 WHEN len(regexp_extract_all({t}, '\b((?:19|20)\d{2})\b')) > 0 THEN make_date(CAST({pick}(regexp_extract_all({t}, '\b((?:19|20)\d{2})\b')) AS INT), {md}) END"""


def range_sql(t: str, side: str) -> str:
    if side == "lo":
        return RANGE_SQL.replace("{t}", t).replace("{last1}", "").replace("{pick}", "list_min").replace("{md}", "1, 1")
    inner = RANGE_SQL.replace("{t}", t).replace("{pick}", "list_max").replace("{md}", "12, 31")
    return inner.replace("CAST(try_strptime('1/' || " + t + ", '%d/%m/%Y') AS DATE){last1}",
                         "last_day(CAST(try_strptime('1/' || " + t + ", '%d/%m/%Y') AS DATE))")


FUND_SQL = r"""CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL
 WHEN regexp_matches(trim({x}), '(?i)Fund\s+(?:[IVXLCDM]+|\d+)\s*(?:[/&,]|\band\b)\s*(?:Fund\s+)?(?:[IVXLCDM]+|\d+)(?:$|[^\w''])') THEN trim({x})
 WHEN regexp_matches(trim({x}), '(?i)^Fund\s+([IVXLCDM]+|\d+)(?:$|[^\w''])') THEN 'Fund ' || upper(regexp_extract(trim({x}), '(?i)^Fund\s+([IVXLCDM]+|\d+)', 1))
 ELSE trim({x}) END"""
END_SQL = r"""CASE WHEN regexp_full_match(upper(trim({x})), 'FY\d{4}') THEN make_date(CAST(substr(upper(trim({x})), 3) AS INT), 12, 31)
 WHEN regexp_full_match(upper(trim({x})), '\d{2}Q[1-4]') THEN last_day(make_date(2000 + CAST(substr(trim({x}), 1, 2) AS INT), 3 * CAST(substr(trim({x}), 4, 1) AS INT), 1)) END"""


@query("fn_01", f"SELECT sheet, company, label, cell, {cell_number('cell')} AS amount FROM {{o_grid_long}}", text="amount")
def fn_01(fr):
    grid = fr["f_grid"]
    periods = [c for c in grid.columns if c.startswith("p_")]
    long = grid.unpivot(["sheet", "company"], periods, "label", "cell").filter("cell IS NOT NULL")
    return long.select("sheet", "company", F.replace("label", F.lit("p_"), F.lit("")).alias("label"), "cell",
                       S.number_from_cell(F.col("cell")).alias("amount"))


@query("fn_02", f"SELECT title, row_no, c5, {range_sql('t', 'lo')} AS lo, {range_sql('t', 'hi')} AS hi FROM {{o_rows}} WHERE c5 IS NOT NULL", text="lo hi")
def fn_02(fr):
    return fr["f_breakdown"].filter("c5 IS NOT NULL").select("title", "row_no", "c5", S.day_range(F.col("c5")).alias("r")).select(
        "title", "row_no", "c5", "r.lo", "r.hi")


@query("fn_03", r"""SELECT title, row_no, CASE WHEN regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(t, '%m/%d/%Y') AS DATE) END AS day
FROM {o_rows} WHERE c5 IS NOT NULL""", text="day")
def fn_03(fr):
    return fr["f_breakdown"].filter("c5 IS NOT NULL").select("title", "row_no", S.exact_day(F.col("c5")).alias("day"))


@query("fn_04", "SELECT sheet_no, title, trim(split_part(title, ' (', 1)) AS company_key FROM {f_sheet}")
def fn_04(fr):
    return fr["f_sheet"].select("sheet_no", "title", S.company_key(F.col("title")).alias("company_key"))


@query("fn_05", f"SELECT label_key, {FUND_SQL.replace('{x}', 'fund_text')} AS fund FROM {{f_label}}")
def fn_05(fr):
    return fr["f_label"].select("label_key", S.fund_key(F.col("fund_text")).alias("fund"))


@query("fn_06", f"SELECT label_key, period_text, {END_SQL.replace('{x}', 'period_text')} AS period_end FROM {{f_label}}", text="period_end")
def fn_06(fr):
    return fr["f_label"].select("label_key", "period_text", S.period_end(F.col("period_text")).alias("period_end"))


# Packet labels of two houses, as a caller would hand them in.
LISTED = {"Fund II": ("23Q4", "24Q4", "25Q4"), "Fund I": ("FY2023", "FY2024", "FY2025")}


@query("fn_07", f"""SELECT label_key, fund, label, CASE WHEN (fund = 'Fund II' AND label IN ('23Q4', '24Q4', '25Q4'))
 OR (fund = 'Fund I' AND label IN ('FY2023', 'FY2024', 'FY2025')) THEN 'packet' ELSE 'lineage_only' END AS scope FROM (
 SELECT label_key, {FUND_SQL.replace('{x}', 'fund_text')} AS fund, CASE WHEN label_key % 2 = 0 THEN '25Q4' ELSE trim(period_text) END AS label FROM {{f_label}})""")
def fn_07(fr):
    label = F.when(F.col("label_key") % 2 == 0, "25Q4").otherwise(F.trim("period_text"))
    return fr["f_label"].select("label_key", S.fund_key(F.col("fund_text")).alias("fund"), label.alias("label")).withColumn(
        "scope", S.period_scope(F.col("fund"), F.col("label"), LISTED))


@query("fn_08", """SELECT lot_id, gap, cost_amount, gap <> 0 AND abs(gap) >= least(abs(cost_amount) * 0.001, 1000) AS material FROM (
 SELECT lot_id, cost_amount, CAST((order_key % 9 - 4) * 0.3 AS DECIMAL(24,4)) AS gap FROM {f_lot})""", text="gap cost_amount")
def fn_08(fr):
    gap = ((F.col("order_key") % 9 - 4) * F.lit("0.3").cast("decimal(2,1)")).cast("decimal(24,4)")
    return fr["f_lot"].select("lot_id", gap.alias("gap"), "cost_amount").withColumn(
        "material", S.is_material(F.col("gap"), F.col("cost_amount")))


@query("fn_09", r"""SELECT title, row_no, c0, CASE WHEN regexp_matches(trim(c0), '(?i)^(exit|realis|realiz|distrib)') THEN 'exit'
 WHEN regexp_matches(c0, '(?i)\bfund\b') THEN 'investment' ELSE 'unrecognised' END AS row_kind FROM {f_breakdown}""")
def fn_09(fr):
    return fr["f_breakdown"].select("title", "row_no", "c0", S.row_kind(F.col("c0")).alias("row_kind"))


@query("fn_10", "SELECT lot_id, CAST(CAST(shares AS DECIMAL(18,6)) * CAST(entry_pps AS DECIMAL(18,6)) AS DECIMAL(37,12)) AS implied_cost FROM {f_lot}", text="implied_cost")
def fn_10(fr):
    return fr["f_lot"].select("lot_id", S.implied_cost(F.col("entry_pps"), F.col("shares")).alias("implied_cost"))


NUMERAL_SQL = r"""CASE WHEN regexp_full_match({x}, '[ \t\n\r\f\v]*\(?[ \t\n\r\f\v]*-?[ \t\n\r\f\v]*\$?[ \t\n\r\f\v]*(?:0|[1-9][0-9]{0,2}(?:,[0-9]{3})+|[1-9][0-9]*)(?:\.[0-9]+)?[ \t\n\r\f\v]*%?[ \t\n\r\f\v]*\)?[ \t\n\r\f\v]*')
 THEN CASE WHEN ltrim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))[1] IN ('(', '-') THEN -1 ELSE 1 END
      * CASE WHEN NOT regexp_matches({x}, '\.[0-9]{6}[0-9]*[1-9]') THEN TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DECIMAL(30,6)) END END"""
TOKENS_SQL = r"""CASE WHEN {v} = '' THEN 0 ELSE len([i for i in range(1, length({q}) + 1) if substr({q}, i, length({v})) = {v}
 and not (i > 1 and regexp_matches(substr({q}, i - 1, 1), '[0-9,.\-]'))
 and not regexp_matches(substr({q}, i + length({v}), 1), '[0-9,.]')
 and not regexp_matches(substr({q}, i + length({v}), 2), '^[eE][0-9+\-]')]) END"""


def tokens_sql(q: str, v: str) -> str:
    return TOKENS_SQL.replace("{q}", q).replace("{v}", v)


@query("fn_11", f"SELECT cite_key, value_text, CAST({NUMERAL_SQL.replace('{x}', 'value_text')} AS DECIMAL(38,6)) AS number FROM {{f_cite}}", text="number")
def fn_11(fr):
    return fr["f_cite"].select("cite_key", "value_text", S.cited_numeral(F.col("value_text")).alias("number"))


@query("fn_12", f"SELECT cite_key, CAST({tokens_sql('quote', 'value_text')} AS INT) AS hits FROM {{f_cite}}")
def fn_12(fr):
    return fr["f_cite"].select("cite_key", S.value_token_occurrences(F.col("quote"), F.col("value_text")).alias("hits"))


@query("fn_13", f"SELECT cite_key, ({tokens_sql('quote', 'value_text')}) = 1 AS supported FROM {{f_cite}}")
def fn_13(fr):
    return fr["f_cite"].select("cite_key", S.supports_value(F.col("quote"), F.col("value_text")).alias("supported"))


WORD = "split_part(replace(canonical_text, chr(10), ' '), ' ', 2)"


@query("fn_14", f"""SELECT document_id, quote, CAST(hits AS INT) AS hits, CASE WHEN length(quote) = 0 THEN 'empty_quote' WHEN hits = 0 THEN 'absent' WHEN hits > 1 THEN 'ambiguous' ELSE 'found' END AS state,
 CASE WHEN hits = 1 THEN CAST(instr(canonical_text, quote) - 1 AS INT) END AS span_start,
 CASE WHEN hits = 1 THEN CAST(instr(canonical_text, quote) - 1 + length(quote) AS INT) END AS span_end,
 CASE WHEN hits >= 2 THEN CAST(length(string_split(canonical_text, quote)[1]) + length(quote) + length(string_split(canonical_text, quote)[2]) AS INT) END AS second_start
FROM (SELECT *, CASE WHEN length(quote) = 0 THEN 0 ELSE len(string_split(canonical_text, quote)) - 1 END AS hits
 FROM (SELECT document_id, canonical_text, {WORD} AS quote FROM {{f_document}}))""")
def fn_14(fr):
    from attestor.operators import citing
    docs = fr["f_document"].withColumn("quote", F.split_part(F.replace("canonical_text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(2)))
    return citing.locate(docs, "canonical_text", "quote").withColumn(
        "second_start", citing.nth_start(F.col("canonical_text"), F.col("quote"), F.col("hits"), 2)
    ).select("document_id", "quote", "hits", "state", "span_start", "span_end", "second_start")


@query("fn_15", r"""SELECT claim_id, len(m) AS hits, CASE WHEN len(m) = 1 THEN regexp_extract(m[1], 'fund shares is ([0-9]+)', 1) END AS value,
 CASE WHEN len(m) = 1 THEN CAST(instr(canonical_text, m[1]) - 1 AS INT) END AS span_start
 FROM (SELECT claim_id, canonical_text, regexp_extract_all(canonical_text, 'fund shares is ([0-9]+)') AS m FROM {f_statement})""")
def fn_15(fr):
    from attestor.operators import citing
    return citing.locate_pattern(fr["f_statement"], "canonical_text", r"fund shares is ([0-9]+)", 1).select("claim_id", "hits", "value", "span_start")


@query("fn_16", """SELECT f.claim_id, field_name, span_end <= length(canonical_text) AND substr(canonical_text, CAST(span_start AS INT) + 1, CAST(span_end - span_start AS INT)) = quote AS resolves
 FROM {f_fact} AS f JOIN {f_statement} AS s ON s.claim_id = f.claim_id""")
def fn_16(fr):
    joined = fr["f_fact"].join(fr["f_statement"].select("claim_id", "canonical_text"), "claim_id")
    return joined.select("claim_id", "field_name", S.span_resolves(F.col("canonical_text"), F.col("quote"), F.col("span_start"), F.col("span_end")).alias("resolves"))


@query("fn_17", "SELECT document_id, sha256(canonical_text) AS content_hash, sha256(extractor || chr(0) || canonical_text) AS text_hash FROM {f_document}")
def fn_17(fr):
    return fr["f_document"].select("document_id", S.content_hash(F.col("canonical_text")).alias("content_hash"),
                                   S.text_hash(F.col("extractor"), F.col("canonical_text")).alias("text_hash"))


LIBRARY["o_page"] = """
SELECT document_id, CAST(n AS INT) AS page_no, CAST(page_start AS INT) AS page_start, CAST(page_start + length(body) AS INT) AS page_end FROM (
 SELECT document_id, n, body, total, coalesce(sum(length(body) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start, cnt
 FROM (SELECT document_id, length(canonical_text) AS total, len(string_split(canonical_text, chr(12))) AS cnt, generate_subscripts(string_split(canonical_text, chr(12)), 1) AS n,
   unnest(string_split(canonical_text, chr(12))) AS body FROM {f_paged}) AS e) AS t
WHERE n < cnt OR length(body) > 0"""


@query("fn_18", "SELECT document_id, page_no, page_start, page_end FROM {o_page}")
def fn_18(fr):
    from attestor.operators import citing
    return citing.pages(fr["f_paged"])


@query("fn_19", """SELECT document_id, probe, (SELECT max(page_no) FROM {o_page} AS g WHERE g.document_id = p.document_id AND g.page_start <= p.probe AND p.probe < g.page_end) AS page_no
 FROM (SELECT document_id, CAST(document_no * 37 % (length(canonical_text) + 20) AS INT) AS probe FROM {f_paged}) AS p""")
def fn_19(fr):
    from attestor.operators import citing
    probes = fr["f_paged"].select("document_id", (F.col("document_no") * 37 % (F.length("canonical_text") + 20)).cast("int").alias("probe"))
    return citing.page_of(probes, citing.pages(fr["f_paged"]), "probe")


@query("fn_20", "SELECT lot_id, CAST(acquired_date - INTERVAL 12 MONTH AS DATE) AS year_before, CAST(acquired_date - INTERVAL 1 MONTH AS DATE) AS month_before FROM {f_lot}", text="year_before month_before")
def fn_20(fr):
    return fr["f_lot"].select("lot_id", S.months_back(F.col("acquired_date"), 12).alias("year_before"), S.months_back(F.col("acquired_date"), 1).alias("month_before"))


@query("fn_21", """SELECT claim_id, price, CAST(price AS DECIMAL(38,1)) = price AS fits, CASE WHEN CAST(price AS DECIMAL(38,1)) = price THEN CAST(price AS DECIMAL(38,1)) END AS accepted
 FROM (SELECT claim_id, price_per_share AS price FROM {f_claim} WHERE price_per_share IS NOT NULL)""", text="price accepted")
def fn_21(fr):
    priced = fr["f_claim"].filter("price_per_share IS NOT NULL").select("claim_id", F.col("price_per_share").alias("price"))
    return priced.withColumn("fits", S.fits_scale(F.col("price"), 1)).withColumn(
        "accepted", F.when(F.col("fits"), F.col("price").cast("decimal(38,1)")))


@query("fn_22", """SELECT lot_id, unit, CASE WHEN unit = 0 THEN false ELSE
 stated = (CASE WHEN v % (2 * unit) = unit / 2 OR v % (2 * unit) = unit / 2 + unit THEN round(v / (2 * unit)) * 2 ELSE round(v / unit) END) * unit END AS rounds
 FROM (SELECT lot_id, unit, CAST(shares AS BIGINT) * 5 AS v, CAST(floor(shares * 5 / CASE unit WHEN 0 THEN 1 ELSE unit END) AS BIGINT) * unit AS stated
  FROM (SELECT lot_id, shares, CASE order_key % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 0 END AS unit FROM {f_lot} WHERE shares IS NOT NULL))""")
def fn_22(fr):
    unit = F.when(F.col("order_key") % 3 == 0, 10).when(F.col("order_key") % 3 == 1, 100).otherwise(0)
    v = (F.col("shares") * 5).cast("decimal(20,0)")
    lots = fr["f_lot"].filter("shares IS NOT NULL").select("lot_id", unit.alias("unit"), v.alias("v"))
    safe = F.when(F.col("unit") == 0, 1).otherwise(F.col("unit"))
    return lots.select("lot_id", "unit", S.rounds_to(F.col("v"), F.floor(F.col("v") / safe) * F.col("unit"), F.col("unit")).alias("rounds"))


@query("fn_23", r"""SELECT lot_id, CASE WHEN contains(s, '.') THEN regexp_replace(regexp_replace(s, '0+$', ''), '\.$', '') ELSE s END AS plain,
 format('{:,.2f}', CAST(cost_amount AS DOUBLE)) || ' USD' AS money FROM (SELECT lot_id, cost_amount, CAST(entry_pps AS VARCHAR) AS s FROM {f_lot})""")
def fn_23(fr):
    return fr["f_lot"].select("lot_id", S.plain_figure(F.col("entry_pps")).alias("plain"), S.money_text(F.col("cost_amount"), F.lit("USD")).alias("money"))


FIGURES_SQL = r"list_distinct([replace(rtrim(x, '.,'), ',', '') for x in regexp_extract_all({x}, '\d[\d,.]*') if rtrim(x, '.,') <> ''])"


@query("fn_24", f"SELECT document_id, array_to_string(list_sort({FIGURES_SQL.replace('{x}', 'canonical_text')}), ' ') AS figures FROM {{f_document}}")
def fn_24(fr):
    return fr["f_document"].select("document_id", F.concat_ws(" ", F.array_sort(S.figure_tokens(F.col("canonical_text")))).alias("figures"))


@query("fn_25", r"""SELECT title, row_no, c0, CASE WHEN y <> '' THEN CAST(y AS INT) WHEN b <> '' THEN CAST(b AS INT) END AS year, CASE WHEN y <> '' THEN m END AS month,
 CASE WHEN s <> '' THEN 'series_' || lower(replace(s, '-', '')) END AS class_slug FROM (
 SELECT title, row_no, c0, CASE WHEN m BETWEEN 1 AND 12 THEN y0 ELSE '' END AS y, m, b, s FROM (SELECT title, row_no, c0,
  regexp_extract(c0, '(?i)(?:(January|February|March|April|May|June|July|August|September|October|November|December)|(\d{1,2}))[\s./]*(\d{4})', 3) AS y0,
  coalesce(TRY_CAST(regexp_extract(c0, '(?i)(?:(January|February|March|April|May|June|July|August|September|October|November|December)|(\d{1,2}))[\s./]*(\d{4})', 2) AS INT), 0) AS m,
  regexp_extract(c0, '\b((?:19|20)\d{2})\b', 1) AS b, regexp_extract(c0, '\bSeries\s+([A-Z](?:-\d+)?)\b', 1) AS s FROM {f_breakdown} WHERE c1 IS NULL))""")
def fn_25(fr):
    series = F.regexp_extract("c0", r"\bSeries\s+([A-Z](?:-\d+)?)\b", 1)
    return fr["f_breakdown"].filter("c1 IS NULL").select("title", "row_no", "c0", S.dated(F.col("c0")).alias("d"),
                                                         F.when(series != "", S.class_slug(series)).alias("class_slug")).select(
        "title", "row_no", "c0", "d.year", "d.month", "class_slug")


@query("fn_26", r"""SELECT document_id, CAST(generate_subscripts(parts, 1) AS INT) AS sentence_no, unnest(parts) AS sentence FROM (
 SELECT document_id, string_split(regexp_replace(trim(regexp_replace(canonical_text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.;]) ([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM {f_document})""")
def fn_26(fr):
    return fr["f_document"].select("document_id", F.posexplode(S.sentences(F.col("canonical_text"))).alias("n", "sentence")).select(
        "document_id", (F.col("n") + 1).alias("sentence_no"), "sentence")


@query("fn_27", "SELECT claim_id, greatest(issued_date, coalesce(received_date, issued_date)) AS effective_date FROM {f_claim}", text="effective_date")
def fn_27(fr):
    return fr["f_claim"].select("claim_id", S.effective_date(F.col("issued_date"), F.col("received_date")).alias("effective_date"))


LIBRARY["o_stated_value"] = """
SELECT claim_id, count(*) AS declared, CASE WHEN count(*) = 1 THEN max(value_numeric) END AS stated_value FROM {f_fact}
WHERE field_name IN ('concluded_fair_value_usd', 'usd_carrying_value', 'net_asset_value', 'fund_holding_value') GROUP BY claim_id"""


@query("fn_28", "SELECT c.claim_id, coalesce(declared, 0) AS declared, stated_value FROM {f_claim} AS c LEFT JOIN {o_stated_value} AS v ON v.claim_id = c.claim_id", text="stated_value")
def fn_28(fr):
    from attestor.operators import validators
    values = validators.stated_values(fr["f_fact"])
    return fr["f_claim"].select("claim_id").join(values, "claim_id", "left").withColumn("declared", F.coalesce("declared", F.lit(0)))


def _values(rows, names) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({names}))"


LIBRARY["d_field"] = "SELECT * FROM " + _values([(f, ",".join(sorted(r))) for f, r in model.FIELD_REQUESTS.items()], "field_name, requirements")
LIBRARY["d_lead"] = "SELECT * FROM " + _values([(r, f, n) for r, fs in model.LEAD_FIELDS.items() for n, f in enumerate(fs)], "requirement, field_name, lead_position")
LIBRARY["d_matrix"] = "SELECT * FROM " + _values(model.MATRIX, "requirement, source_class, execution_status, position_type, verdict, reason_code, next_action, priceless_verdict, priceless_reason")
LIBRARY["d_gap"] = "SELECT * FROM " + _values(model.GAP_VERDICTS, "kind, verdict, reason_code, next_action")
LIBRARY["d_preference"] = "SELECT * FROM " + _values([(c, e, n) for n, (c, e) in enumerate(model.PREFERENCE)], "source_class, execution_status, preference")


@query("fn_29", """SELECT x.field_name, d.field_name IS NOT NULL AS declared, d.requirements, facts FROM (
 SELECT CASE WHEN part_key % 41 = 0 THEN 'unknown_field' ELSE field_name END AS field_name, count(*) AS facts FROM {f_fact} GROUP BY 1) AS x LEFT JOIN {d_field} AS d ON d.field_name = x.field_name""")
def fn_29(fr):
    from attestor.operators import citing
    named = fr["f_fact"].withColumn("field_name", F.when(F.col("part_key") % 41 == 0, "unknown_field").otherwise(F.col("field_name")))
    counted = named.groupBy("field_name").agg(F.count("*").alias("facts"))
    return citing.with_requests(counted).select("field_name", "declared", F.when(F.col("declared"), F.concat_ws(",", "requirements")).alias("requirements"), "facts")


@query("fn_30", """SELECT f.field_name, r.requirement, CAST(coalesce(l.lead_position, n.size) AS INT) AS answer_rank, count(*) AS facts FROM {f_fact} AS f
 JOIN {d_field} AS d ON d.field_name = f.field_name JOIN (SELECT requirement, count(*) AS size FROM {d_lead} GROUP BY 1) AS n ON contains(d.requirements, n.requirement)
 JOIN (SELECT DISTINCT requirement FROM {d_lead}) AS r ON r.requirement = n.requirement
 LEFT JOIN {d_lead} AS l ON l.requirement = r.requirement AND l.field_name = f.field_name GROUP BY ALL""")
def fn_30(fr):
    from attestor.operators import citing
    counted = fr["f_fact"].groupBy("field_name").agg(F.count("*").alias("facts"))
    return citing.answer_ranks(counted).select("field_name", "requirement", "answer_rank", "facts")


@query("fn_31", """SELECT mark_id, sha256('{"amount":"' || CAST(reported_amount AS VARCHAR) || '","currency":"' || reported_currency || '","holding":"' || holding_id || '"}') AS digest FROM {f_mark}""")
def fn_31(fr):
    return fr["f_mark"].select("mark_id", S.record_digest(F.col("reported_amount").cast("string").alias("amount"), F.col("reported_currency").alias("currency"),
                                                          F.col("holding_id").alias("holding")).alias("digest"))


GLOSSARY = (("R1", "existence and cost"), ("R2", "fair value support"))


@query("fn_32", """SELECT r.requirement, coalesce(g.meaning, 'Nobody has said what this code means.') AS meaning, count(*) AS uses FROM {f_claim_requirement} AS r
 LEFT JOIN (SELECT * FROM (VALUES ('R1', 'existence and cost'), ('R2', 'fair value support')) AS t(code, meaning)) AS g ON g.code = r.requirement GROUP BY ALL""")
def fn_32(fr):
    from attestor.operators import citing
    codes = fr["f_claim_requirement"].groupBy("requirement").agg(F.count("*").alias("uses"))
    return citing.glossed(codes, "requirement", GLOSSARY).select("requirement", "meaning", "uses")


@query("fn_33", """SELECT reason, CASE WHEN reason LIKE 'NO_PRICE_FOR_CLASS:%' OR reason IN ('NO_APPLICABLE_EVIDENCE', 'NO_PRICE_IN_EVIDENCE') THEN 'unconfirmable'
 WHEN reason IN ('COMPONENT_WITHOUT_SHARE_COUNT', 'NO_VALUE_FIELD_CITED') THEN 'blocked_incomplete' END AS outcome, count(*) AS lots FROM (
 SELECT CASE order_key % 6 WHEN 0 THEN 'NO_APPLICABLE_EVIDENCE' WHEN 1 THEN 'NO_PRICE_IN_EVIDENCE' WHEN 2 THEN 'COMPONENT_WITHOUT_SHARE_COUNT' WHEN 3 THEN 'NO_VALUE_FIELD_CITED'
  WHEN 4 THEN 'NO_PRICE_FOR_CLASS:' || security_class ELSE 'SOMETHING_NEW' END AS reason FROM {f_lot}) GROUP BY ALL""")
def fn_33(fr):
    k = F.col("order_key") % 6
    reason = (F.when(k == 0, "NO_APPLICABLE_EVIDENCE").when(k == 1, "NO_PRICE_IN_EVIDENCE").when(k == 2, "COMPONENT_WITHOUT_SHARE_COUNT")
              .when(k == 3, "NO_VALUE_FIELD_CITED").when(k == 4, F.concat(F.lit("NO_PRICE_FOR_CLASS:"), "security_class")).otherwise("SOMETHING_NEW"))
    return fr["f_lot"].select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("lots")).withColumn("outcome", S.refusal_outcome(F.col("reason")))


@query("fn_34", """SELECT h.holding_id, g.kind, d.verdict, d.reason_code, 'NO_APPLICABLE_SUPPORT_' || upper(coalesce(g.kind, 'none')) AS prefixed, d.next_action
 FROM {f_holding} AS h LEFT JOIN {f_gap} AS g ON g.holding_id = h.holding_id JOIN {d_gap} AS d ON d.kind = coalesce(g.kind, 'none')""")
def fn_34(fr):
    kind = F.col("kind")
    return fr["f_holding"].select("holding_id").join(fr["f_gap"].select("holding_id", "kind"), "holding_id", "left").select(
        "holding_id", "kind", S.gap_verdict(kind).alias("verdict"), S.gap_reason(kind).alias("reason_code"),
        S.gap_reason(kind, "NO_APPLICABLE_SUPPORT").alias("prefixed"), S.gap_action(kind).alias("next_action"))


@query("fn_35", """SELECT lot_id, CASE WHEN recomputed IS NULL THEN 'NO_RECOMPUTATION' WHEN concluded = recomputed THEN 'EXACT'
 WHEN len([e for e in range(0, 12) if power(10, e) <= abs(concluded) * 0.001 and round_even(CAST(recomputed AS DOUBLE) / power(10, e), 0) * power(10, e) = CAST(concluded AS DOUBLE)]) > 0 THEN 'ROUNDING_VARIANCE'
 ELSE 'UNRECOGNISED_VARIANCE_REVIEW_REQUIRED' END AS classification FROM (
 SELECT lot_id, CAST(CASE order_key % 3 WHEN 0 THEN cost_amount WHEN 1 THEN floor(cost_amount) ELSE cost_amount + 3 END AS DECIMAL(24,4)) AS concluded,
  CASE WHEN order_key % 5 <> 4 THEN cost_amount END AS recomputed FROM {f_lot})""")
def fn_35(fr):
    k = F.col("order_key")
    concluded = F.when(k % 3 == 0, F.col("cost_amount")).when(k % 3 == 1, F.floor("cost_amount").cast("decimal(24,4)")).otherwise((F.col("cost_amount") + 3).cast("decimal(24,4)"))
    return fr["f_lot"].select("lot_id", concluded.alias("concluded"), F.when(k % 5 != 4, F.col("cost_amount")).alias("recomputed")).select(
        "lot_id", S.variance_class(F.col("concluded"), F.col("recomputed")).alias("classification"))


@query("fn_36", "SELECT document_id, sha256('prompt-v1' || chr(0) || extractor || chr(0) || sha256(canonical_text)) AS fingerprint FROM {f_document}")
def fn_36(fr):
    return fr["f_document"].select("document_id", S.fingerprint(F.lit("prompt-v1"), F.col("extractor"), S.content_hash(F.col("canonical_text"))).alias("fingerprint"))


@query("fn_37", """SELECT key, count(DISTINCT reported_currency) AS currencies, CASE WHEN count(DISTINCT reported_currency) = 1 THEN CAST(sum(reported_amount) AS DECIMAL(34,4)) END AS total,
 bool_and(reported_amount = CAST(reported_amount AS DECIMAL(38,4))) AS at_scale FROM (SELECT *, fund_id AS key FROM {f_mark} UNION ALL SELECT *, holding_id AS key FROM {f_mark}) GROUP BY key""", text="total")
def fn_37(fr):
    from attestor.operators import totals
    marks = fr["f_mark"].withColumn("key", F.explode(F.array("fund_id", "holding_id")))
    return totals.same_currency_sum(marks, ["key"], "reported_amount", "reported_currency")


@query("fn_38", r"""SELECT title, row_no, TRY_CAST(replace(replace(trim(c4), ',', ''), '$', '') AS DECIMAL(38,6)) AS figure,
 CASE WHEN TRY_CAST(replace(replace(trim(c4), ',', ''), '$', '') AS DECIMAL(38,6)) = floor(TRY_CAST(replace(replace(trim(c4), ',', ''), '$', '') AS DECIMAL(38,6))) THEN TRY_CAST(replace(replace(trim(c4), ',', ''), '$', '') AS BIGINT) END AS whole,
 CASE WHEN regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(t, '%m/%d/%Y') AS DATE) END AS day FROM {o_rows} WHERE c1 IS NULL""", text="figure day")
def fn_38(fr):
    from attestor.operators import mapping
    return mapping.typed_note_cells(fr["f_breakdown"].filter("c1 IS NULL")).select("title", "row_no", "figure", "whole", "day")
