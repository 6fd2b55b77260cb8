"""REQ: the five evidence requests and the verdict of a packet row."""

from pyspark.sql import functions as F

from attestor import model
from attestor.operators import rules
from attestor.sources.ledger import from_derived
from catalogue import query


def assessment(fr) -> rules.Assessment:
    return rules.Assessment(from_derived(fr), store=fr.store)


def listed(column: str):
    return F.concat_ws(",", column).alias(column)


@query("req_01", "SELECT holding_id, period_id, verdict, reasons, next_actions, lots FROM {o_r1}")
def req_01(fr):
    return assessment(fr).r1.select("holding_id", "period_id", "verdict", listed("reasons"), listed("next_actions"), "lots")


@query("req_02", "SELECT holding_id, period_id, verdict, reasons, next_actions, cross_class, pro_forma, subsequent FROM {o_r2}")
def req_02(fr):
    return assessment(fr).r2.select("holding_id", "period_id", "verdict", listed("reasons"), listed("next_actions"), "cross_class", "pro_forma", "subsequent")


@query("req_03", "SELECT holding_id, period_id, verdict, reasons, next_actions, note, stale_components FROM {o_r3}")
def req_03(fr):
    return assessment(fr).r3.select("holding_id", "period_id", "verdict", listed("reasons"), listed("next_actions"), "note", "stale_components")


@query("req_04", "SELECT holding_id, period_id, verdict, reasons, next_actions, realised_lots FROM {o_r4}")
def req_04(fr):
    return assessment(fr).r4.select("holding_id", "period_id", "verdict", listed("reasons"), listed("next_actions"), "realised_lots")


@query("req_05", "SELECT holding_id, period_id, 'R5' AS requirement, 'sufficient' AS verdict FROM {o_r2} WHERE pro_forma")
def req_05(fr):
    return assessment(fr).r5.select("holding_id", "period_id", "requirement", "verdict")


@query("req_06", """SELECT holding_id, period_id, held, r1, r2, r3, r4, r5, row_verdict, applicable_count, sufficient_count, fully_supported FROM {o_row}""")
def req_06(fr):
    return assessment(fr).rows.select("holding_id", "period_id", "held", "r1", "r2", "r3", "r4", "r5", "row_verdict",
                                      "applicable_count", "sufficient_count", "fully_supported")


@query("req_07", "SELECT holding_id, period_id, held, unsupported, unsupported = '' AS supported FROM {o_row}")
def req_07(fr):
    reasons = F.array_sort(F.transform(F.map_entries("unsupported_reasons"), lambda e: F.concat_ws(" ", e.key, e.value)))
    return assessment(fr).rows.select("holding_id", "period_id", "held", F.concat_ws(";", reasons).alias("unsupported"), "supported")


@query("req_08", """SELECT h.holding_id, count(c.component) AS components, count(c.component) = 0 AS missing FROM {f_holding} AS h LEFT JOIN {f_recorded_component} AS c ON c.holding_id = h.holding_id GROUP BY h.holding_id""")
def req_08(fr):
    counted = fr["f_recorded_component"].groupBy("holding_id").agg(F.count("*").alias("components"))
    return fr["f_holding"].select("holding_id").join(counted, "holding_id", "left").select(
        "holding_id", F.coalesce("components", F.lit(0)).alias("components"), F.col("components").isNull().alias("missing"))
