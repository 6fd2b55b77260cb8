"""REC, SRC readers of workbooks, and the findings they share."""

from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import joins, reconcile
from attestor.sources import workbook
from attestor.sources.derived import GRID_PERIODS
from catalogue import LIBRARY, query
from catalogue.scalars import END_SQL, cell_number

PACKET = {"Fund I": ("FY1999", "FY2000", "FY2001"), "Fund II": ("FY1999", "FY2000", "FY2001")}
SCOPE = "CASE WHEN {f} IN ('Fund I', 'Fund II') AND {l} IN ('FY1999', 'FY2000', 'FY2001') THEN 'packet' ELSE 'lineage_only' END"


def scope(f: str, l: str) -> str:
    return SCOPE.replace("{f}", f).replace("{l}", l)


def books(fr) -> reconcile.Workbooks:
    return reconcile.from_frames(fr, PACKET)


def material(gap: str, ref: str) -> str:
    return f"({gap} <> 0 AND abs({gap}) >= least(abs({ref}) * 0.001, 1000))"


LIBRARY["o_cell"] = f"""
SELECT sheet AS fund, trim(split_part(company, ' (', 1)) AS company, company AS row_label, label, cell, {cell_number('cell')} AS amount, {cell_number('cost_cell')} AS tracker_cost, {END_SQL.replace('{x}', 'label')} AS measured FROM {{o_grid_long}} WHERE company <> 'TOTAL'"""
LIBRARY["o_stated"] = f"SELECT sheet, label, {cell_number('cell')} AS stated FROM {{o_grid_long}} WHERE company = 'TOTAL'"
LIBRARY["o_label"] = "SELECT sheet, label FROM (SELECT DISTINCT sheet FROM {f_grid}) CROSS JOIN (VALUES " + ", ".join(f"('{p}')" for p in GRID_PERIODS) + ") AS l(label)"
LIBRARY["o_known"] = "SELECT *, share_price IS NOT NULL AND share_count IS NOT NULL AS priced FROM {o_tranche} WHERE is_exit OR is_investment"
LIBRARY["o_td"] = """
SELECT t.*, m.row_label, m.label, m.measured, m.amount, m.tracker_cost, CASE WHEN t.hi <= m.measured THEN true WHEN t.lo > m.measured THEN false END AS by_then
FROM {o_known} AS t JOIN {o_cell} AS m ON m.fund = t.fund AND m.company = t.company WHERE m.amount IS NOT NULL AND m.measured IS NOT NULL"""
LIBRARY["o_pos"] = """
SELECT *, any_exit AND invariant AND held_shares - sold > 0 AS shortcut FROM (
SELECT fund, company, row_label, label, measured, amount, tracker_cost, bool_or(is_investment AND coalesce(by_then, false)) AS any_held, bool_or(is_investment AND by_then IS NULL) AS undecidable,
 bool_or(is_exit AND coalesce(by_then, true)) AS any_exit, bool_or(is_exit AND by_then IS NULL) AS exit_unknown, coalesce(sum(share_count) FILTER (is_exit AND coalesce(by_then, true)), 0) AS sold,
 coalesce(sum(investment) FILTER (is_investment AND by_then), 0) AS held_cost, coalesce(sum(investment) FILTER (is_investment), 0) AS lifetime, coalesce(sum(share_count) FILTER (is_investment AND by_then AND priced), 0) AS held_shares,
 coalesce(sum(investment) FILTER (is_investment AND by_then AND NOT priced), 0) AS bare, coalesce(sum(share_count) FILTER (is_investment AND by_then AND NOT priced), 0) AS dropped,
 count(DISTINCT share_price) FILTER (is_investment AND by_then AND priced) AS prices, max(share_price) FILTER (is_investment AND by_then AND priced) AS top,
 max(lo) FILTER (is_investment AND by_then AND priced) AS latest_lo, min(hi) FILTER (is_investment AND by_then AND priced) AS earliest_hi,
 coalesce(bool_or(is_investment AND by_then) AND NOT bool_or(is_investment AND by_then IS NULL) AND NOT bool_or(is_investment AND coalesce(by_then, false) AND NOT priced) AND count(DISTINCT share_price) FILTER (is_investment AND by_then AND priced) = 1, false) AS invariant
FROM {o_td} GROUP BY ALL)"""
LIBRARY["o_fact"] = """
SELECT *, CASE WHEN shortcut THEN (held_shares - sold) * top ELSE held_cost END AS cost, CASE WHEN shortcut THEN held_shares - sold ELSE held_shares END AS shares, CASE WHEN shortcut THEN 0 ELSE bare END AS unpriced, CASE WHEN shortcut THEN 0 ELSE dropped END AS dropped_shares,
 NOT shortcut AND prices > 1 AS repriced, any_held AND NOT undecidable AND NOT (any_exit AND NOT shortcut) AS usable FROM {o_pos}"""
LIBRARY["o_implied"] = f"""
SELECT fund, company, row_label, label, count(*) AS candidates, bool_and({material('gap', 'value')}) AS all_material, bool_or(gap = 0) AS reproduced, arg_max(struct_pack(value := value, price := share_price, txt := acquired_text, follows := follows), struct_pack(a := abs(gap), b := -row_no)) AS pick FROM (
 SELECT t.fund, t.company, t.row_label, t.label, t.row_no, t.share_price, t.acquired_text, t.lo > f.earliest_hi AS follows, CAST(f.shares * t.share_price + f.unpriced AS DECIMAL(34,6)) AS value, CAST(f.shares * t.share_price + f.unpriced - t.amount AS DECIMAL(34,6)) AS gap
 FROM {{o_td}} AS t JOIN {{o_fact}} AS f ON f.fund = t.fund AND f.company = t.company AND f.row_label = t.row_label AND f.label = t.label AND f.usable WHERE t.is_investment AND t.by_then AND t.priced AND t.hi >= f.latest_lo) GROUP BY ALL"""
LIBRARY["o_all"] = "SELECT f.*, i.candidates, i.all_material, i.reproduced, i.pick FROM {o_fact} AS f LEFT JOIN {o_implied} AS i USING (fund, company, row_label, label)"
LIBRARY["o_two_priced"] = "SELECT fund, company FROM {o_known} WHERE is_investment AND priced GROUP BY 1, 2 HAVING count(*) >= 2"


def money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


COMPOSITION = (
    f"concat_ws(', ', 'all ' || {money('shares')} || ' shares of the day, each at the ' || CASE WHEN pick.follows THEN 'later ' ELSE '' END || pick.txt || ' price paid, ' || CAST(CAST(pick.price AS DECIMAL(34,6)) AS VARCHAR),"
    f" CASE WHEN unpriced <> 0 THEN 'plus ' || {money('unpriced')} || ' of purchases without a price, left at what they cost' END) || ' is ' || {money('pick.value')}"
    " || CASE WHEN repriced OR candidates > 1 OR dropped_shares <> 0 THEN ' - a reading and no row, since ' || concat_ws('; and ', CASE WHEN repriced THEN 'one price stands for lots that cost differently, of whatever class' END,"
    f" CASE WHEN candidates > 1 THEN candidates || ' purchases could each be the last, and this is one' END, CASE WHEN dropped_shares <> 0 THEN {money('dropped_shares')} || ' shares without a price stay out' END) ELSE '' END")
NONE = "CAST(NULL AS VARCHAR)"

F_SQL = {
    "rec_01": f"""SELECT 'stated_total_disagrees_with_cells' AS kind, l.sheet || ' · ' || l.label AS subject, {scope('l.sheet', 'l.label')} AS scope, s.stated, coalesce(c.computed, 0) AS computed,
 'its cells add up to ' || {money('coalesce(c.computed, 0)')} || ' across ' || c.n || ' positions, yet the sheet says ' || {money('s.stated')} AS detail FROM {{o_label}} AS l JOIN {{o_stated}} AS s ON s.sheet = l.sheet AND s.label = l.label AND s.stated IS NOT NULL
 JOIN (SELECT fund, label, coalesce(sum(amount), 0) AS computed, count(amount) AS n FROM {{o_cell}} GROUP BY 1, 2) AS c ON c.fund = l.sheet AND c.label = l.label WHERE c.computed <> s.stated
 UNION ALL SELECT 'no_stated_total_to_check', l.sheet || ' · ' || l.label, NULL, NULL, NULL, 'positions are there, a stated total is not; nothing could be checked' FROM {{o_label}} AS l LEFT JOIN {{o_stated}} AS s ON s.sheet = l.sheet AND s.label = l.label WHERE s.stated IS NULL""",
    "rec_02": f"""SELECT 'cost_total_disagrees_with_cells' AS kind, t.sheet || ' · cost basis' AS subject, {NONE} AS scope, t.stated, c.computed, 'its cells add up to ' || {money('c.computed')} || ', yet the sheet says ' || {money('t.stated')} AS detail
 FROM (SELECT sheet, {cell_number('cost_cell')} AS stated FROM {{f_grid}} WHERE company = 'TOTAL') AS t JOIN (SELECT sheet, coalesce(sum({cell_number('cost_cell')}), 0) AS computed FROM {{f_grid}} WHERE company <> 'TOTAL' GROUP BY 1) AS c ON c.sheet = t.sheet WHERE t.stated <> c.computed""",
    "rec_03": f"""SELECT 'tranche_arithmetic_disagrees' AS kind, company || ' · ' || acquired_text AS subject, {NONE} AS scope, investment AS stated, CAST(share_price AS DECIMAL(18,6)) * CAST(share_count AS DECIMAL(18,6)) AS computed,
 {money('share_count')} || ' shares at ' || CAST(CAST(share_price AS DECIMAL(34,6)) AS VARCHAR) || ' is ' || {money('share_price * CAST(share_count AS DECIMAL(18,0))')} || ', yet the sheet says an investment of ' || {money('investment')} AS detail FROM {{o_tranche}} WHERE is_investment AND CAST(share_price AS DECIMAL(18,6)) * CAST(share_count AS DECIMAL(18,0)) <> investment""",
    "rec_04": f"""SELECT 'unrecognised_tranche_kind' AS kind, company || ' · ' || acquired_text AS subject, {NONE} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, 'row type ' || kind || ' is no purchase and no exit; its ' || {money('investment')} || ' counts in no total' AS detail
 FROM {{o_tranche}} WHERE NOT is_exit AND NOT is_investment""",
    "rec_05": f"""SELECT CASE WHEN c.computed IS NULL OR t.stated IS NULL THEN 'cost_basis_never_compared' ELSE 'cost_basis_disagrees_across_workbooks' END AS kind, CASE WHEN t.stated IS NULL THEN c.fund || ' · ' || c.company ELSE t.label END AS subject, {NONE} AS scope, t.stated, c.computed,
 CASE WHEN c.computed IS NULL THEN 'the tracker has ' || {money('t.stated')} || ', and the breakdown has no sheet under this name' WHEN t.stated IS NULL THEN 'the breakdown has ' || {money('c.computed')} || ', and the tracker has no cost for this name'
  ELSE 'the tracker has ' || {money('t.stated')} || '; its breakdown tranches add up to ' || {money('c.computed')} END AS detail
 FROM (SELECT sheet, company AS label, trim(split_part(company, ' (', 1)) AS company, {cell_number('cost_cell')} AS stated FROM {{f_grid}} WHERE company <> 'TOTAL' AND cost_cell IS NOT NULL) AS t FULL JOIN {{o_cost_breakdown}} AS c ON c.fund = t.sheet AND c.company = t.company WHERE c.computed IS DISTINCT FROM t.stated""",
    "rec_06": f"""SELECT 'purchase_date_unreadable' AS kind, company AS subject, {NONE} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, count(*) || ' priced purchase(s) have an unreadable date; their marks were not checked' AS detail FROM {{o_known}} JOIN {{o_two_priced}} USING (fund, company) WHERE is_investment AND priced AND lo IS NULL GROUP BY fund, company
 UNION ALL SELECT 'latest_purchase_is_ambiguous', company, NULL, NULL, NULL, 'which of ' || count(*) || ' purchases came last stays open, and their prices are ' || count(DISTINCT share_price) || ' prices' FROM (SELECT a.* FROM {{o_known}} AS a JOIN {{o_two_priced}} USING (fund, company) WHERE a.is_investment AND a.priced
  AND NOT EXISTS (SELECT 1 FROM {{o_known}} AS b WHERE b.is_investment AND b.priced AND b.fund = a.fund AND b.company = a.company AND b.row_no <> a.row_no AND b.lo > a.hi)) GROUP BY fund, company HAVING count(*) >= 2 AND count(DISTINCT share_price) >= 2""",
    "rec_07": f"""SELECT 'holding_at_date_undecidable' AS kind, company AS subject, {NONE} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, 'at ' || array_to_string(list_sort(list(DISTINCT label)), ', ') || ' one purchase date could fall on either side of the measured day, so it stays open if that lot counts' AS detail
 FROM {{o_pos}} WHERE undecidable GROUP BY fund, company""",
    "rec_08": f"""SELECT 'mark_never_compared' AS kind, m.row_label || ' · ' || m.label AS subject, {scope('m.fund', 'm.label')} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, 'the tracker has a figure, but ' || CASE WHEN EXISTS (SELECT 1 FROM {{o_tranche}} AS t WHERE t.fund = m.fund AND t.company = m.company AND NOT t.is_exit AND NOT t.is_investment)
  THEN 'the breakdown rows under this name are neither purchases nor exits' ELSE 'the breakdown has nothing under this name in the fund' END AS detail FROM {{o_cell}} AS m WHERE m.amount IS NOT NULL AND m.measured IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{o_known}} AS k WHERE k.fund = m.fund AND k.company = m.company)""",
    "rec_09": f"""SELECT 'realisation_not_allocated_to_lots' AS kind, company || ' · ' || label AS subject, {scope('fund', 'label')} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, 'an exit of ' || {money('sold')} || ' shares ' || CASE WHEN exit_unknown THEN 'may lie before or after the measured day' ELSE 'lies before the measured day' END
  || ', with no word in either workbook on the lots it used up' AS detail FROM {{o_pos}} WHERE any_exit AND (exit_unknown OR NOT invariant)""",
    "rec_10": f"""SELECT 'unrecognised_period_label' AS kind, company AS subject, {NONE} AS scope, CAST(NULL AS DECIMAL(34,6)) AS stated, CAST(NULL AS DECIMAL(34,6)) AS computed, 'period label(s) ' || array_to_string(list_sort(list(DISTINCT label)), ', ') || ' cannot be read as a date' AS detail
 FROM {{o_cell}} AS m WHERE amount IS NOT NULL AND measured IS NULL AND EXISTS (SELECT 1 FROM {{o_known}} AS k WHERE k.fund = m.fund AND k.company = m.company) GROUP BY fund, company""",
    "rec_11": f"""SELECT 'mark_at_cost_disagrees_with_purchase_prices' AS kind, company || ' · ' || label AS subject, {scope('fund', 'label')} AS scope, amount AS stated, pick.value AS computed, 'carried at ' || {money('amount')} || ', just the cost of the lots still held, whereas ' || {COMPOSITION} AS detail
 FROM {{o_all}} JOIN {{o_two_priced}} USING (fund, company) WHERE usable AND NOT {material('(amount - cost)', 'cost')} AND all_material""",
    "rec_12": f"""SELECT CASE WHEN candidates IS NOT NULL AND reproduced THEN 'mark_basis_assumes_an_unstated_treatment' ELSE 'mark_basis_not_in_workbooks' END AS kind, company || ' · ' || label AS subject, {scope('fund', 'label')} AS scope, amount AS stated, CASE WHEN candidates IS NULL THEN cost WHEN candidates = 1 THEN pick.value END AS computed,
 CASE WHEN candidates IS NULL THEN 'carried at ' || {money('amount')} || ' against ' || {money('cost')} || ' of cost, and not one lot gives price and count together' ELSE 'carried at ' || {money('amount')} || ', which the ' || {money('cost')} || ' not accounted for by the cost of lots still held. '
  || CASE WHEN tracker_cost IS NOT NULL AND cost = lifetime AND NOT {material('(amount - tracker_cost)', 'tracker_cost')} THEN 'The cost on the tracker is the same figure. ' ELSE '' END || CASE WHEN reproduced THEN 'The figure comes out of ' ELSE 'Prices paid give another figure: ' END || {COMPOSITION} END AS detail
 FROM {{o_all}} WHERE usable AND {material('(amount - cost)', 'cost')} AND (candidates IS NULL OR (candidates = 1 AND repriced) OR all_material)""",
}
TYPED = "SELECT kind, subject, scope, CAST(stated AS DECIMAL(34,6)) AS stated, CAST(computed AS DECIMAL(34,6)) AS computed, detail FROM ({body}) AS b"
for key, body in F_SQL.items():
    LIBRARY[f"o_{key}"] = TYPED.replace("{body}", body)
LIBRARY["o_findings"] = " UNION ALL ".join(f"SELECT * FROM {{o_{k}}}" for k in F_SQL)

CHECK_OF = {
    "rec_01": reconcile.stated_totals, "rec_02": reconcile.stated_cost_total, "rec_03": reconcile.tranche_arithmetic, "rec_04": reconcile.recognised_kinds,
    "rec_05": reconcile.cost_bases, "rec_06": reconcile.latest_purchase, "rec_07": reconcile.holding_dates, "rec_08": reconcile.unreached_marks,
    "rec_09": reconcile.realisations, "rec_10": reconcile.period_labels, "rec_11": reconcile.held_at_cost, "rec_12": reconcile.mark_basis,
}
for key, check in CHECK_OF.items():
    query(key, f"SELECT * FROM {{o_{key}}}", text="stated computed")(lambda fr, check=check: check(books(fr)))


@query("rec_01_contributors", "SELECT fund AS sheet, label, row_label AS company, amount FROM {o_cell} WHERE amount IS NOT NULL", text="amount")
def rec_01_contributors(fr):
    return reconcile.contributors(books(fr))


@query("rec_13", """SELECT fund, company, row_label, label, usable, any_exit AND NOT shortcut AS realised, CAST(cost AS DECIMAL(34,6)) AS cost, CAST(shares AS DECIMAL(34,6)) AS shares, CAST(unpriced AS DECIMAL(34,6)) AS unpriced_cost, repriced, coalesce(candidates, 0) AS candidates FROM {o_all}""", text="cost shares unpriced_cost")
def rec_13(fr):
    return books(fr).facts.select("fund", "company", "row_label", "label", "usable", "realised", "cost", "shares", "unpriced_cost", "repriced", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query("rec_14", f"SELECT fund, company, row_label, label, {COMPOSITION} AS composition FROM {{o_all}} WHERE candidates IS NOT NULL")
def rec_14(fr):
    return books(fr).facts.filter("candidates IS NOT NULL").select("fund", "company", "row_label", "label", reconcile.composition().alias("composition"))


@query("rec_15", "SELECT fund, company, label, measured, amount, tracker_cost FROM {o_cell} WHERE amount IS NOT NULL AND measured IS NOT NULL", text="measured amount tracker_cost")
def rec_15(fr):
    return books(fr).dated_marks.select("fund", "company", "label", "measured", "amount", "tracker_cost")


@query("rec_16", "SELECT kind, subject, CAST(computed - stated AS DECIMAL(35,6)) AS delta FROM {o_rec_05}", text="delta")
def rec_16(fr):
    return reconcile.with_delta(reconcile.cost_bases(books(fr))).select("kind", "subject", "delta")


@query("rec_17", "SELECT fund, company, count(*) AS recognised_rows, count(*) FILTER (is_investment AND priced) >= 2 AS comparable FROM {o_known} GROUP BY 1, 2")
def rec_17(fr):
    w = books(fr)
    rows = w.recognised.groupBy("fund", "company").agg(F.count("*").alias("recognised_rows"))
    return rows.join(w.comparable.withColumn("comparable", F.lit(True)), ["fund", "company"], "left").withColumn("comparable", F.coalesce("comparable", F.lit(False)))


@query("rec_18", "SELECT fund, company, label, count(*) FILTER (by_then) AS held, count(*) FILTER (by_then IS NULL) AS undecidable, count(DISTINCT row_label) AS labels FROM {o_td} WHERE is_investment GROUP BY 1, 2, 3")
def rec_18(fr):
    return books(fr).dated_rows.filter("is_investment").groupBy("fund", "company", "label").agg(
        F.count_if("by_then").alias("held"), F.count_if(F.col("by_then").isNull()).alias("undecidable"), F.countDistinct("row_label").alias("labels"))


@query("set_05", "SELECT kind, subject, scope, CAST(computed - stated AS DECIMAL(35,6)) AS delta FROM {o_findings}", text="delta")
def set_05(fr):
    return reconcile.all_findings(books(fr)).select("kind", "subject", "scope", "delta")


@query("agg_17", """SELECT s.scope, f.kind, coalesce(f.findings, 0) AS findings FROM (VALUES ('packet'), ('lineage_only'), ('unscoped')) AS s(scope) LEFT JOIN (SELECT coalesce(scope, 'unscoped') AS scope, kind, count(*) AS findings FROM {o_findings} GROUP BY 1, 2) AS f ON f.scope = s.scope""")
def agg_17(fr):
    return reconcile.buckets(reconcile.all_findings(books(fr)))


@query("src_02", f"SELECT sheet, company, label, {cell_number('cell')} AS amount, CASE WHEN {cell_number('cell')} IS NULL THEN nullif(cell, '') END AS note FROM {{o_grid_long}} WHERE company <> 'TOTAL'", text="amount")
def src_02(fr):
    return workbook.unpivot_grid(workbook.company_rows(fr["f_grid"])).filter("cell IS NOT NULL").select("sheet", "company", "label", "amount", "note")


@query("src_03", "SELECT sheet, label, stated FROM {o_stated} WHERE stated IS NOT NULL", text="stated")
def src_03(fr):
    return books(fr).stated


#: Two workbooks with the same sheet numbers; the second names other funds, and its first sheets stand before any divider.
LIBRARY["o_two_books"] = """
SELECT 'a' AS workbook, sheet_no, title FROM {f_sheet} UNION ALL SELECT 'b', sheet_no, CASE WHEN title LIKE '%>>' THEN 'Side ' || title ELSE title END FROM {f_sheet} WHERE sheet_no > 0"""


@query("src_04", """SELECT s.workbook, s.sheet_no, s.title, CASE WHEN s.workbook = 'a' THEN f.fund_label WHEN s.sheet_no >= 100000000 THEN 'Side ' || f.fund_label END AS fund FROM {o_two_books} AS s JOIN {f_fund} AS f ON f.fund_id = 'fund_' || CAST(s.sheet_no // 100000000 AS VARCHAR) WHERE s.title NOT LIKE '%>>'""")
def src_04(fr):
    other = fr["f_sheet"].filter("sheet_no > 0").withColumn("title", F.when(F.endswith("title", F.lit(">>")), F.concat(F.lit("Side "), "title")).otherwise(F.col("title")))
    both = fr["f_sheet"].withColumn("workbook", F.lit("a")).unionByName(other.withColumn("workbook", F.lit("b")))
    return workbook.sheet_funds(both, "workbook")


@query("src_05", "SELECT fund, company, title, row_no, kind, investment, share_price, share_count, lo, hi FROM {o_tranche}", text="investment share_price share_count lo hi")
def src_05(fr):
    return joins.tranches(fr).select("fund", "company", "title", "row_no", "kind", "investment", "share_price", "share_count", "lo", "hi")


@query("src_06", """SELECT s.fund_label AS fund, r.company, r.title AS source_sheet, r.row_no AS ordinal, trim(r.c0) AS text, concat_ws('|', r.c0, r.c1, b.c2, r.c3, r.c4, r.c5) AS cells FROM {o_rows} AS r JOIN {f_breakdown} AS b ON b.sheet_no = r.sheet_no AND b.row_no = r.row_no
 JOIN {f_fund} AS s ON s.fund_id = 'fund_' || CAST(r.sheet_no // 100000000 AS VARCHAR) WHERE r.c1 IS NULL AND trim(r.c0) <> ''""")
def src_06(fr):
    return workbook.notes(fr.kept("sheet_funds", lambda: workbook.sheet_funds(fr["f_sheet"])), fr["f_breakdown"]).select(
        "fund", "company", "source_sheet", "ordinal", "text", F.concat_ws("|", "cells").alias("cells"))
