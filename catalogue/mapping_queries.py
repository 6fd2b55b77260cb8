"""MAP: workbook rows classified and mapped to ledger rows, with every refusal and assumption kept."""

from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import joins, mapping
from attestor.sources import workbook
from catalogue import LIBRARY, query
from catalogue.reconciliation import PACKET, books, scope
from catalogue.scalars import END_SQL

OVERRIDES = (("Customer#000000001", "series_b"), ("Customer#000000002", "series_a1"))


def sheets(fr):
    return fr.kept("sheet_funds", lambda: workbook.sheet_funds(fr["f_sheet"]))


def note_rows(fr):
    return workbook.notes(sheets(fr), fr["f_breakdown"])


def types(fr):
    return mapping.position_types(note_rows(fr), joins.tranches(fr), sheets(fr))


def overrides(fr):
    return fr.spark.createDataFrame(list(OVERRIDES), "company string, document_class string")


def classes(fr):
    return mapping.security_classes(joins.tranches(fr), note_rows(fr), types(fr), overrides(fr))


LIBRARY["o_note"] = "SELECT sheet_no, title, row_no, trim(c0) AS text, c3, c4, c5 FROM {f_breakdown} WHERE c1 IS NULL AND trim(c0) <> ''"
LIBRARY["o_signal"] = r"""
SELECT sheet_no, arg_min(line, part * 1000000000 + row_no) FILTER (regexp_matches(line, '(?i)indirect (?:fund|exposure)|feeder')) AS a, arg_min(line, part * 1000000000 + row_no) FILTER (regexp_matches(line, '(?i)de-spac|public listing|quoted closing price')) AS b,
 arg_min(line, part * 1000000000 + row_no) FILTER (regexp_matches(line, '\b[A-Z]{3}-denominated\b') AND NOT regexp_matches(line, '\bUSD-denominated\b')) AS c
FROM (SELECT sheet_no, 0 AS part, row_no, text AS line FROM {o_note} UNION ALL SELECT sheet_no, 1, row_no, c0 FROM {f_breakdown} WHERE c1 IS NOT NULL) GROUP BY 1"""
LIBRARY["o_type"] = """
SELECT s.sheet_no, s.title, f.fund_label AS fund, CASE WHEN n > 1 THEN NULL WHEN a IS NOT NULL THEN 'indirect_feeder' WHEN b IS NOT NULL THEN 'public_listed' WHEN c IS NOT NULL THEN 'fx_denominated_interest' ELSE 'direct_equity' END AS position_type,
 CASE WHEN n = 1 THEN coalesce(a, b, c) WHEN n = 0 THEN 'no line names a feeder, a listing or a foreign denomination' END AS source_text, n
FROM {f_sheet} AS s JOIN {f_fund} AS f ON f.fund_id = 'fund_' || CAST(s.sheet_no // 100000000 AS VARCHAR) LEFT JOIN (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n FROM {o_signal}) AS g ON g.sheet_no = s.sheet_no WHERE s.title NOT LIKE '%>>'"""


@query("map_01", "SELECT sheet_no, fund, position_type, source_text, n > 1 AS refused FROM {o_type}")
def map_01(fr):
    return types(fr).select("sheet_no", "fund", "position_type", "source_text", F.col("refusal").isNotNull().alias("refused"))


LIBRARY["o_named"] = r"""
SELECT sheet_no, CAST(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1) AS INT) AS year, CASE WHEN CAST(regexp_extract(text, '(\d{1,2})[\s./]*(\d{4})', 1) || '0' AS INT) BETWEEN 10 AND 120 THEN TRY_CAST(regexp_extract(text, '(\d{1,2})[\s./]*(\d{4})', 1) AS INT) END AS month,
 'series_' || lower(replace(regexp_extract(text, '\bSeries\s+([A-Z](?:-\d+)?)\b', 1), '-', '')) AS slug FROM {o_note} WHERE regexp_matches(text, '\bSeries\s+([A-Z](?:-\d+)?)\b') AND NOT regexp_matches(text, '(?i)^(supporting documentation|case study material)')"""
LIBRARY["o_class"] = r"""
SELECT b.sheet_no, b.row_no, b.company, CASE WHEN regexp_matches(b.c0, '(?i)conv\.?\s*note|convertible note') THEN 'conv_note' WHEN regexp_matches(b.c0, '(?i)indirect fund') THEN 'lp_interest' WHEN b.company = 'Customer#000000001' THEN 'series_b' WHEN b.company = 'Customer#000000002' THEN 'series_a1'
 WHEN m.n = 1 THEN m.slug WHEN m.n IS NULL AND y.n = 1 THEN y.slug WHEN i.fund_interest THEN 'fund_interest' WHEN i.lp THEN 'lp_interest' WHEN t.position_type = 'public_listed' THEN 'common' ELSE 'unstated' END AS security_class
FROM (SELECT r.*, t.lo FROM {o_rows} AS r JOIN {o_tranche} AS t ON t.title = r.title AND t.row_no = r.row_no AND t.is_investment) AS b
LEFT JOIN (SELECT sheet_no, year, month, count(*) AS n, min(slug) AS slug FROM {o_named} WHERE month IS NOT NULL GROUP BY 1, 2, 3) AS m ON m.sheet_no = b.sheet_no AND m.year = year(b.lo) AND m.month = month(b.lo)
LEFT JOIN (SELECT sheet_no, year, count(*) AS n, min(slug) AS slug FROM {o_named} GROUP BY 1, 2) AS y ON y.sheet_no = b.sheet_no AND y.year = year(b.lo)
LEFT JOIN (SELECT sheet_no, bool_or(regexp_matches(text, '(?i)\b[A-Z]{3}-denominated fund interest')) AS fund_interest, bool_or(regexp_matches(text, '(?i)capital account statement|feeder')) AS lp FROM {o_note} WHERE NOT regexp_matches(text, '(?i)^(supporting documentation|case study material)') GROUP BY 1) AS i ON i.sheet_no = b.sheet_no
LEFT JOIN {o_type} AS t ON t.sheet_no = b.sheet_no"""


@query("map_02", "SELECT sheet_no, row_no, security_class FROM {o_class}")
def map_02(fr):
    return classes(fr).select("sheet_no", "row_no", "security_class")


LIBRARY["o_recap"] = r"""
SELECT r.sheet_no, r.shares, r.price, r.day, y.slug, CASE WHEN r.shares IS NULL OR r.price IS NULL OR r.day IS NULL THEN 'lacks ' || concat_ws(',', CASE WHEN r.shares IS NULL THEN 'shares' END, CASE WHEN r.price IS NULL THEN 'price' END, CASE WHEN r.day IS NULL THEN 'date' END) WHEN y.n IS DISTINCT FROM 1 THEN 'no line names the class converted into' END AS refusal
FROM (SELECT sheet_no, TRY_CAST(c4 AS DECIMAL(18,0)) AS shares, TRY_CAST(c3 AS DECIMAL(34,6)) AS price, CAST(try_strptime(c5, '%m/%d/%Y') AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY sheet_no ORDER BY row_no) AS rn FROM {o_note} WHERE regexp_matches(text, '(?i)post-recap|recapitali[sz]ation|conversion')) WHERE rn = 1) AS r
LEFT JOIN (SELECT sheet_no, year, count(*) AS n, min(slug) AS slug FROM {o_named} GROUP BY 1, 2) AS y ON y.sheet_no = r.sheet_no AND y.year = year(r.day)"""


@query("map_03", "SELECT sheet_no, shares, price AS price_per_share, day AS effective_date, slug AS to_security_class, refusal FROM {o_recap}", text="shares price_per_share effective_date")
def map_03(fr):
    return mapping.recapitalisations(note_rows(fr)).select("sheet_no", "shares", "price_per_share", "effective_date", "to_security_class", "refusal")


@query("map_04", f"SELECT sheet, label, {END_SQL.replace('{x}', 'label')} AS period_date, {scope('sheet', 'label')} AS audit_scope, CASE WHEN ({END_SQL.replace('{x}', 'label')}) IS NULL THEN 'label cannot be dated' END AS refusal FROM {{o_label}}", text="period_date")
def map_04(fr):
    return mapping.periods(books(fr).labels, PACKET).select("sheet", "label", "period_date", "audit_scope", "refusal")


@query("map_05", "SELECT fund, trim(split_part(title, ' (', 1)) AS company, position_type, 'USD' AS currency, 1 + CASE WHEN n = 0 THEN 1 ELSE 0 END AS assumed FROM {o_type} WHERE n <= 1 OR n IS NULL")
def map_05(fr):
    rows, assumed = mapping.holdings(types(fr))
    counted = assumed.groupBy("fund", "company").agg(F.count("*").alias("assumed"))
    return rows.join(counted, ["fund", "company"]).select("fund", "company", "position_type", "currency", "assumed")


LIBRARY["o_held_at"] = """
SELECT t.fund, t.company, d.measured, CASE WHEN bool_or(is_exit AND by_then IS NULL) THEN NULL WHEN NOT bool_or(NOT is_exit AND coalesce(by_then, false)) THEN CASE WHEN bool_or(NOT is_exit AND by_then IS NULL) THEN NULL ELSE false END
 WHEN NOT bool_or(is_exit AND coalesce(by_then, false)) THEN true WHEN bool_or(by_then AND share_count IS NULL) THEN NULL ELSE coalesce(sum(share_count) FILTER (is_exit AND by_then), 0) < coalesce(sum(share_count) FILTER (NOT is_exit AND by_then), 0) END AS held
FROM (SELECT t.*, d.measured, CASE WHEN t.hi <= d.measured THEN true WHEN t.lo > d.measured THEN false END AS by_then FROM {o_tranche} AS t CROSS JOIN (SELECT DISTINCT measured FROM {o_cell} WHERE measured IS NOT NULL) AS d) AS t, (SELECT 1) AS one, (SELECT t.measured) AS d GROUP BY ALL"""
LIBRARY["o_mark_row"] = """
SELECT m.fund, m.company, m.row_label, m.label, m.measured, m.amount, h.held, CASE WHEN m.amount IS NULL THEN 'not a figure: ' || m.cell END AS refusal FROM {o_cell} AS m LEFT JOIN {o_held_at} AS h ON h.fund = m.fund AND h.company = m.company AND h.measured = m.measured WHERE m.measured IS NOT NULL AND m.cell IS NOT NULL"""


def mark_rows(fr):
    cells = books(fr).cells
    asked = cells.select("fund", F.col("key").alias("company"), S.period_end(F.col("label")).alias("measured")).filter("measured IS NOT NULL").distinct()
    figures = joins.running_at(joins.tranches(fr), ["fund", "company"], asked, "measured")
    return mapping.mark_rows(cells, joins.position_held(figures, ["fund", "company", "measured"]))


@query("map_06", "SELECT fund, company, label, amount, held, refusal FROM {o_mark_row}", text="amount")
def map_06(fr):
    return mark_rows(fr).select("fund", F.col("key").alias("company"), "label", "amount", "held", "refusal")


INSIDE = "EXISTS (SELECT 1 FROM {o_date} AS d JOIN {f_fund} AS f ON f.fund_id = d.fund_id WHERE f.fund_label = t.fund AND t.lo <= d.period_date AND d.period_date < t.hi)"
LIBRARY["o_day"] = f"""
SELECT *, CASE WHEN refusal IS NULL THEN lo END AS acquired_date FROM (SELECT t.*, b.sheet_no, CASE WHEN lo IS NULL THEN 'the date cell names no date' WHEN lo <> hi AND ({INSIDE}) THEN 'a measurement date falls inside the range' END AS refusal
 FROM {{o_tranche}} AS t JOIN {{f_breakdown}} AS b ON b.title = t.title AND b.row_no = t.row_no WHERE is_investment)"""
LIBRARY["o_sold"] = """
SELECT fund, company, CASE WHEN n = 1 AND sold >= bought AND bought > 0 THEN day END AS realized_date FROM (SELECT fund, company, count(*) FILTER (is_exit) AS n, coalesce(sum(share_count) FILTER (is_exit), 0) AS sold, coalesce(sum(share_count) FILTER (is_investment), 0) AS bought,
 max(CASE WHEN is_exit AND lo = hi THEN lo END) AS day FROM {o_tranche} GROUP BY 1, 2) WHERE n > 0"""
LIBRARY["o_mapped_lot"] = """
SELECT d.sheet_no, d.fund, d.company, d.row_no, d.lot_no, c.security_class, d.share_count AS shares, d.investment AS cost_amount, d.acquired_date, s.realized_date FROM (SELECT *, row_number() OVER (PARTITION BY fund, company ORDER BY row_no) AS lot_no FROM {o_day}) AS d
LEFT JOIN {o_class} AS c ON c.sheet_no = d.sheet_no AND c.row_no = d.row_no LEFT JOIN {o_sold} AS s ON s.fund = d.fund AND s.company = d.company WHERE d.acquired_date IS NOT NULL"""


def lot_rows(fr):
    return mapping.lots(joins.tranches(fr), classes(fr), joins.packet_dates(fr))


@query("map_07", "SELECT sheet_no, row_no, lot_no, security_class, shares, cost_amount, acquired_date, realized_date FROM {o_mapped_lot}", text="shares cost_amount acquired_date realized_date")
def map_07(fr):
    return lot_rows(fr).select("sheet_no", "row_no", F.col("lot_no").cast("bigint").alias("lot_no"), "security_class", "shares", "cost_amount", "acquired_date", "realized_date")


@query("map_08", "SELECT fund, company, realized_date, CASE WHEN realized_date IS NULL THEN 'no allocation method is stated' END AS refusal FROM {o_sold}", text="realized_date")
def map_08(fr):
    return mapping.realised_dates(joins.tranches(fr))


@query("map_09", """SELECT r.sheet_no, CASE WHEN coalesce(h.n, 0) = 1 THEN h.lot_no END AS lot_no, r.day AS effective_date, r.slug AS to_security_class, r.shares AS to_shares, CASE WHEN coalesce(h.n, 0) <> 1 THEN coalesce(h.n, 0) || ' share-bearing lots, no allocation stated' END AS refusal
 FROM {o_recap} AS r LEFT JOIN (SELECT sheet_no, count(*) AS n, min(lot_no) AS lot_no FROM {o_mapped_lot} WHERE shares IS NOT NULL AND shares <> 0 GROUP BY 1) AS h ON h.sheet_no = r.sheet_no WHERE r.refusal IS NULL""", text="effective_date to_shares")
def map_09(fr):
    return mapping.conversions(lot_rows(fr), mapping.recapitalisations(note_rows(fr))).select(
        "sheet_no", F.col("lot_no").cast("bigint").alias("lot_no"), "effective_date", "to_security_class", "to_shares", "refusal")


@query("map_10", "SELECT sheet_no, row_no, acquired_date, refusal AS date_refusal FROM {o_day}", text="acquired_date")
def map_10(fr):
    return mapping.acquisition_days(joins.tranches(fr).filter("is_investment"), joins.packet_dates(fr)).select("sheet_no", "row_no", "acquired_date", "date_refusal")


@query("map_11", f"""SELECT m.fund, m.label, count(*) AS lines, count(*) FILTER (t.company IS NULL) AS orphans, count(*) FILTER (m.held) AS held FROM {{o_mark_row}} AS m
 LEFT JOIN (SELECT fund, trim(split_part(title, ' (', 1)) AS company FROM {{o_type}} WHERE n <= 1 OR n IS NULL) AS t ON t.fund = m.fund AND t.company = m.company WHERE m.refusal IS NULL AND {scope('m.fund', 'm.label')} = 'packet' GROUP BY 1, 2""")
def map_11(fr):
    rows, _ = mapping.holdings(types(fr))
    lines = mapping.packet_lines(mark_rows(fr), rows, mapping.periods(books(fr).labels, PACKET))
    return lines.groupBy("fund", "label").agg(F.count("*").alias("lines"), F.count_if(F.col("refusal").isNotNull()).alias("orphans"), F.count_if("held").alias("held"))
