"""Packet rows, totals and report tables, all fund-dates in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import joins, totals, validators
from attestor.operators.rules import Assessment, codes
from attestor.sources import publish

KEY = ["holding_id", "period_id"]


def recomputations(assessment: Assessment) -> DataFrame:
    """VAL-13: one row per packet member, also where nothing could be recomputed."""
    checked = validators.mark_check(assessment).select(*KEY, "outcome", "reason", "derived", "difference", "parts", "evidence")
    rows = assessment.members.select(*KEY, "fund_id", "period_date", "held", "mark_id", F.col("reported_amount").cast(validators.MONEY).alias("reported"), "reported_currency")
    return rows.join(checked, KEY, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_applicable"))).withColumn(
        "reason", F.coalesce("reason", F.lit("NOT_HELD_AT_MEASUREMENT_DATE")))


def validated_amounts(assessment: Assessment) -> DataFrame:
    """VAL-18: validated and carried amounts stay apart; labels say what the value leans on."""
    derived = validators.derive_marks(assessment).select(*KEY, "derived", "reason")
    rows = assessment.rows.join(derived, KEY, "left")
    carried = F.col("reason") == "MANAGEMENT_CARRYING_VALUE"
    return (
        rows.withColumn("validated", F.when(~carried, F.col("derived"))).withColumn("carried", F.when(carried, F.col("derived")))
        .withColumn("matches", F.when(F.col("validated").isNotNull(), F.col("reported_amount").cast(validators.MONEY) == F.col("validated")))
        .withColumn("labels", codes(F.when(F.col("cross_class"), "cross_class_policy"), F.when(F.col("pro_forma"), "pro_forma"),
                                    F.when(F.col("subsequent"), "subsequent_evidence")))
    )


def approval_fingerprints(assessment: Assessment, policy_version: str) -> DataFrame:
    """VAL-19: what an approval rests on, by content: the latest mark, the evidence with all it states, the derived value,
    the verdicts, the policy decisions and the policy version."""
    content = ["claim_id", "requirement", "source_class", "execution_status", "verdict", "issued_date", "priced_class", "price_per_share"]
    lanes = [f"_lane_{n}" for n in range(4)]

    def printed(claims: DataFrame) -> DataFrame:
        # What a claim states for a request is the same at every date, so it is hashed once and the dates multiply numbers.
        hashed = claims.withColumn("_row", publish.row_hash(content))
        return hashed.select("fund_id", "holding_id", "issued_date", "applicable_from", "applicable_to", *[c for c in claims.columns if c in ("struck", "unlisted")],
                             *[lane.alias(n) for n, lane in zip(lanes, publish.hash_lanes("_row"), strict=True)])

    evidence = assessment.at_dates_relied(printed).select(*KEY, *lanes).groupBy(*KEY).agg(publish.lane_sum([F.col(n) for n in lanes]).alias("evidence"))
    policy = assessment.ledger.policy_decision.select(*KEY, publish.row_hash(["decision_id", "from_class", "to_class"]).alias("_row"))
    policy = policy.groupBy(*KEY).agg(publish.hash_sum("_row").alias("policy"))
    derived = validators.derive_marks(assessment).select(*KEY, "derived", F.col("reason").alias("derivation"))
    verdicts = assessment.rows.select(*KEY, "r1", "r2", "r3", "r4", "r5")
    marks = assessment.members.filter("mark_id IS NOT NULL").select(*KEY, "mark_id", "reported_amount", "reported_currency")
    parts = marks.join(evidence, KEY, "left").join(policy, KEY, "left").join(derived, KEY, "left").join(verdicts, KEY, "left").withColumn("policy_version", F.lit(policy_version))
    return parts.withColumn("fingerprint", publish.row_hash(sorted(c for c in parts.columns)))


def stale_approvals(approvals: DataFrame, prints: DataFrame) -> DataFrame:
    """An approval is current only while its recorded fingerprint equals the one computed now."""
    now = prints.select(*KEY, "fingerprint")
    return approvals.join(now, KEY, "left").withColumn("current", F.coalesce(F.col("recorded") == F.col("fingerprint"), F.lit(False)))


def valuation_approvals(assessment: Assessment) -> DataFrame:
    """Latest valuation decision per mark with the number of assessments it binds; approved needs at least one."""
    ledger = assessment.ledger
    bound = ledger.decision_evidence.groupBy("decision_id").agg(F.count("*").alias("bound"))
    latest = joins.latest_decisions(ledger).join(bound, "decision_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    return latest.withColumn("approved", (F.col("status") == "approved") & (F.col("bound") > 0)).withColumnRenamed("status", "decision_status")


def packet_rows(assessment: Assessment) -> DataFrame:
    """Members with verdicts, support, approval and the number of recorded gaps."""
    ledger = assessment.ledger
    gaps = ledger.gap.groupBy("holding_id").agg(F.count("*").alias("gaps"))
    names = ledger.holding.select("holding_id", "company_name", "position_type")
    rows = assessment.rows.join(names, "holding_id").join(valuation_approvals(assessment), "mark_id", "left").join(gaps, "holding_id", "left")
    return rows.withColumn("approved", F.coalesce("approved", F.lit(False))).withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def period_totals(assessment: Assessment, tracker_totals: DataFrame) -> DataFrame:
    """AGG-14: totals of each fund-date, the tracker's own figure beside it, and what blocks an approved total.

    Blockers are tested in order: unsupported, underivable, mismatched, unapproved.
    """
    rows = validated_amounts(assessment).join(valuation_approvals(assessment).select("mark_id", "approved"), "mark_id", "left").filter("held")
    zero = F.lit(0).cast("decimal(24,4)")
    amount = F.coalesce("reported_amount", zero)
    out = rows.groupBy("fund_id", "period_id").agg(
        F.count("*").alias("positions_held"), F.sum(amount).cast("decimal(34,4)").alias("reported_total"),
        F.sum(F.when(~F.col("fully_supported"), amount).otherwise(zero)).cast("decimal(34,4)").alias("unsupported_subtotal"),
        F.count_if(~F.col("fully_supported")).alias("unsupported_rows"),
        F.count_if(F.col("validated").isNull()).alias("underived_rows"),
        F.count_if(~F.coalesce("matches", F.lit(True))).alias("mismatched_rows"),
        F.count_if(~F.coalesce("approved", F.lit(False))).alias("unapproved_rows"),
        F.sum("validated").cast("decimal(38,6)").alias("validated_total"))
    blocked = (
        F.when(F.col("unsupported_rows") > 0, "unsupported_rows").when(F.col("underived_rows") > 0, "validated_amount_not_derivable")
        .when(F.col("mismatched_rows") > 0, "validated_reported_mismatch").when(F.col("unapproved_rows") > 0, "no_valuation_approval"))
    joined = out.join(tracker_totals, ["fund_id", "period_id"], "left").withColumn("blocked_by", blocked)
    return joined.withColumn("approved_total", F.when(F.col("blocked_by").isNull(), F.col("validated_total"))).withColumn(
        "delta", (F.col("reported_total") - F.col("tracker_total")).cast("decimal(35,4)")).drop("validated_total")


def scorecard(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """AGG-15: counts per listed fund-period; a period without positions keeps its line with null counts."""
    counted = rows.groupBy("fund_id", "period_id").agg(
        F.count("*").alias("positions"), F.count_if("supported").alias("fully_supported"), F.count_if(~F.col("supported")).alias("open_gap_positions"),
        F.count_if("pro_forma").alias("pro_forma_positions"), F.count_if("held").alias("held_at_date"), F.count_if(~F.col("held")).alias("not_held_at_date"))
    lines = periods.select("fund_id", "period_id", "label").join(counted, ["fund_id", "period_id"], "left")
    return lines.withColumn("absent_reason", F.when(F.col("positions").isNull(), "a listed fund-period without a single position"))


def packet_counts(rows: DataFrame) -> DataFrame:
    """AGG-16: the figures of the cover page, per fund-period."""
    return rows.groupBy("fund_id", "period_id").agg(
        F.count("*").alias("positions"), F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("unheld"),
        F.count_if(F.col("mark_id").isNotNull()).alias("marked"), F.count_if("supported").alias("supported"),
        F.count_if("approved").alias("approved"), F.sum("gaps").alias("gap_observations"))


def mark_state(rows_date: str = "period_date") -> Column:
    day = F.col(rows_date).cast("string")
    return (
        F.when(F.col("mark_id").isNotNull(), F.concat(F.lit("revision "), F.col("revision").cast("string"), F.lit(" (mark "), "mark_id", F.lit(")")))
        .when(~F.col("held"), F.concat(F.lit("unmarked, not held on "), day)).otherwise(F.concat(F.lit("unmarked on "), day)))


def support_text() -> Column:
    """What the support column says: supported, not supported with reasons, or not held with the request that applies."""
    entries = F.array_sort(F.transform(F.map_entries("unsupported_reasons"), lambda e: F.concat_ws(" ", e.key, e.value)))
    detail = F.concat_ws("; ", entries)
    unheld_na = ~F.col("held") & F.forall(F.map_entries("unsupported_reasons"), lambda e: (e.key == "R4") & (e.value == "not assessed"))
    return (
        F.when(F.col("supported"), "supported")
        .when(unheld_na, F.concat(F.lit("not held then: "), detail))
        .otherwise(F.concat(F.lit("not supported: "), detail)))


def approval_text() -> Column:
    stamp = F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(F.col("decision_id").isNull(), "nothing on record")
        .when(F.col("approved"), F.concat(F.lit("approved by "), "actor_id", F.lit(" on "), stamp))
        .otherwise(F.concat(F.lit("valuation "), "decision_status", F.lit(" (no approval)"))))


def holdings_table(assessment: Assessment) -> DataFrame:
    """PKT-02: one row per position; a missing mark stays blank and says why."""
    derived = recomputations(assessment).select(*KEY, F.col("reason").alias("derivation_reason"), F.when(F.col("derived").isNotNull(), "derivable").otherwise("not_derivable").alias("derivation_status"))
    rows = packet_rows(assessment).join(derived, KEY)
    return rows.select(
        "fund_id", "period_id", "company_name", "holding_id", "position_type", F.when(F.col("held"), "yes").otherwise("no").alias("held"),
        mark_state().alias("mark_state"), "reported_amount", "reported_currency", "derivation_status", "derivation_reason",
        support_text().alias("evidence_support"), *[c.lower() for c in model.REQUESTS], "gaps", approval_text().alias("valuation_approval"))


def reading_order(outcome: Column) -> Column:
    """WIN-12: declared order of outcomes, disagreements first."""
    out = F.lit(len(model.VALIDATOR_ORDER))
    for n, name in reversed(list(enumerate(model.VALIDATOR_ORDER))):
        out = F.when(outcome == name, n).otherwise(out)
    return out


def recomputation_table(assessment: Assessment) -> DataFrame:
    """PKT-03: derived beside reported with the parts of the figure; the position in reading order is a column to sort by."""
    parts = F.concat_ws(" + ", F.transform("parts", lambda p: F.concat(p.shares, F.lit(" "), p.held_class, F.lit(" x "), p.price)))
    names = assessment.ledger.holding.select("holding_id", "company_name")
    return recomputations(assessment).join(names, "holding_id").select(
        "fund_id", "period_id", reading_order(F.col("outcome")).alias("reading_order"), "company_name", "holding_id", "outcome", "reason", "derived", "reported",
        "difference", F.when(F.size("parts") > 0, parts).alias("per_class"), F.when(F.size("evidence") > 0, F.concat_ws(", ", "evidence")).alias("evidence"))


def requirements_table(assessment: Assessment) -> DataFrame:
    """PKT-04: every member against all five requests; what does not arise is said, not left out."""
    from attestor.operators.rules import links

    spark = assessment.ledger.holding.sparkSession
    codes_frame = F.broadcast(spark.createDataFrame(list(model.REQUEST_CATEGORY.items()), "requirement string, category string"))
    cited = links(assessment).groupBy(*KEY, "requirement").agg(F.count("*").alias("evidence_claims"), F.bool_or("is_subsequent").alias("includes_subsequent"))
    base = assessment.members.select("fund_id", "period_date", *KEY).crossJoin(codes_frame)
    full = base.join(assessment.outcomes, [*KEY, "requirement"], "left").join(cited, [*KEY, "requirement"], "left")
    verdict = F.coalesce("verdict", F.lit("not_applicable"))
    return full.select(
        "fund_id", "period_id", "holding_id", "requirement", "category", verdict.alias("verdict"), (verdict != "not_applicable").alias("applicable"),
        F.coalesce("pro_forma", F.lit(False)).alias("pro_forma"), F.concat_ws("; ", "reasons").alias("reason_codes"),
        F.concat_ws("; ", "next_actions").alias("next_actions"), F.coalesce("evidence_claims", F.lit(0)).alias("evidence_claims"),
        F.coalesce("includes_subsequent", F.lit(False)).alias("includes_subsequent"))


def evidence_index(assessment: Assessment) -> DataFrame:
    """PKT-05: one row per cited fact and packet with the requests that rely on its claim.

    The packets of a holding and what relies on a claim at each of them are lists no longer than there are packets, so facts are
    shuffled once, as they are stored, and meet their packets last.
    """
    from attestor.operators.rules import links

    ledger = assessment.ledger
    relied = links(assessment).groupBy("period_id", "claim_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set("requirement"))).alias("relied_on"))
    relied = relied.filter("period_id IS NOT NULL").groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("period_id", "relied_on"))).alias("_relied"))
    packets_ = assessment.members.groupBy("holding_id").agg(F.collect_list(F.struct("period_id", "fund_id")).alias("_packets"))
    names = ledger.document.select("document_no", "document_id", "filename")
    claims = ledger.claim.select("claim_id", "holding_id", "source_class", "execution_status", "issued_date", "document_no").join(names, "document_no").join(packets_, "holding_id")
    cited = ledger.fact.select("claim_id", "field_name", "value_text", "value_numeric", "state", "span_start", "span_end", "quote")
    met = claims.join(relied, "claim_id", "left").join(cited, "claim_id").withColumn("_packet", F.explode("_packets"))
    kept = [c for c in met.columns if not c.startswith("_")]
    at = F.try_element_at("_relied", F.col("_packet.period_id"))
    return met.select(*kept, "_packet.period_id", "_packet.fund_id", F.coalesce(at, F.lit("not relied on")).alias("relied_on"))


def approval_log(assessment: Assessment) -> DataFrame:
    """PKT-06: one line per decision on a member's mark; a member without any keeps a line that says so."""
    ledger = assessment.ledger
    bound = ledger.decision_evidence.groupBy("decision_id").agg(F.count("*").alias("bound"))
    every = ledger.decision.filter("mark_id IS NOT NULL").join(bound, "decision_id", "left").select(
        "mark_id", "decision_id", F.concat(F.concat_ws(" ", "decision_type", "status"), F.lit(" by "), "actor_id", F.lit(" ("), F.coalesce("bound", F.lit(0)).cast("string"), F.lit(" bound)")).alias("decision"))
    rows = packet_rows(assessment).select("fund_id", "period_id", "holding_id", "mark_id", "reported_amount", "approved", support_text().alias("evidence_support"))
    return rows.join(every, "mark_id", "left").withColumn("decision", F.coalesce("decision", F.lit("nothing on record")))


def gap_report(assessment: Assessment) -> DataFrame:
    """PKT-07: everything a packet does not evidence, five kinds of finding in one shape."""
    ledger = assessment.ledger
    rows = packet_rows(assessment)
    shape = ["fund_id", "period_id", "holding_id", "finding", "requirement", "kind", "remediation", "basis"]
    none = F.lit(None).cast("string")
    recorded = assessment.members.select("fund_id", *KEY).join(ledger.gap.drop("gap_id"), "holding_id").select(
        "fund_id", "period_id", "holding_id", F.lit("missing_document").alias("finding"), "requirement", "kind", F.lit("open").alias("remediation"), F.col("missing_document").alias("basis"))
    reasons = F.col("unsupported_reasons")
    each = rows.select("*", F.explode(F.map_entries(reasons)).alias("e"))
    inapplicable = ~F.col("held") & (F.col("e.key") == "R4") & (F.col("e.value") == "not assessed")
    unsupported = each.select(
        "fund_id", "period_id", "holding_id", F.when(inapplicable, "requirement_not_applicable").otherwise("unsupported_requirement").alias("finding"),
        F.col("e.key").alias("requirement"), F.col("e.value").alias("kind"), F.when(inapplicable, "not_applicable").otherwise("open").alias("remediation"),
        F.when(inapplicable, F.concat(F.lit("not in the portfolio on "), F.col("period_date").cast("string"))).alias("basis"))
    unmarked = rows.filter("mark_id IS NULL").select(
        "fund_id", "period_id", "holding_id", F.lit("no_mark_at_this_date").alias("finding"), none.alias("requirement"),
        F.when(F.col("held"), "held_without_a_mark").otherwise("not_held").alias("kind"), F.lit("open").alias("remediation"), mark_state().alias("basis"))
    unapproved = rows.filter("NOT approved").select(
        "fund_id", "period_id", "holding_id", F.lit("no_valuation_approval").alias("finding"), none.alias("requirement"),
        F.lit("open").alias("kind"), F.lit("open").alias("remediation"), approval_text().alias("basis"))
    undocumented = assessment.members.select("fund_id", *KEY).join(ledger.claim.select("holding_id").distinct(), "holding_id", "left_anti").select(
        "fund_id", "period_id", "holding_id", F.lit("no_source_documents").alias("finding"), none.alias("requirement"),
        F.lit("not_located").alias("kind"), F.lit("open").alias("remediation"), F.lit("no file is kept for this position").alias("basis"))
    out = recorded.select(*shape)
    for part in (unsupported, unmarked, unapproved, undocumented):
        out = out.unionByName(part.select(*shape))
    return out


def statement(tally: DataFrame) -> DataFrame:
    """PKT-08: the sentence of the cover, from the counts and the totals it must not contradict."""
    opening = F.when(F.col("approved") == 0, F.concat(F.lit("Not one position here has an approved valuation on record (0 of "), F.col("positions").cast("string"), F.lit(")."))).otherwise(
        F.concat(F.col("approved").cast("string"), F.lit(" of "), F.col("positions").cast("string"), F.lit(" positions have an approved valuation on record.")))
    body = F.when(F.col("unsupported_positions") > 0, F.concat(
        F.col("unsupported_amount").cast("string"), F.lit(" of the "), F.col("amount").cast("string"), F.lit(" held_at_date_reported total, from "),
        F.col("unsupported_positions").cast("string"), F.lit(" of "), F.col("held").cast("string"), F.lit(" positions held, lacks support."))).otherwise(
        F.lit("Nothing held lacks evidence for a request that applies to it."))
    return tally.withColumn("statement", F.concat_ws(" ", opening, body))


def cover(assessment: Assessment) -> DataFrame:
    """PKT-08: key/value lines per fund-period."""
    rows = packet_rows(assessment)
    held = totals.held_totals(rows, ["fund_id", "period_id"]).drop("positions_held", "currencies", "kind")
    tally = statement(packet_counts(rows).join(held, ["fund_id", "period_id"]))
    items = ["positions", "held", "unheld", "marked", "supported", "approved", "gap_observations", "amount", "unsupported_amount",
             "unsupported_positions", "unheld_gap_positions", "statement"]
    text = tally.select("fund_id", "period_id", *[F.col(i).cast("string").alias(i) for i in items])
    return text.unpivot(["fund_id", "period_id"], items, "item", "value")


def evidence_documents(assessment: Assessment) -> DataFrame:
    """PKT-09: each document once per packet, however many claims cite it."""
    claims = assessment.ledger.claim.select("holding_id", "document_no").distinct()
    return assessment.members.select("fund_id", *KEY).join(claims, "holding_id").join(
        assessment.ledger.document.select("document_no", "document_id"), "document_no").select("fund_id", "period_id", "document_id").distinct()


def evidence_bundle(assessment: Assessment) -> dict[str, DataFrame]:
    """PKT-09: what stands behind the rows of every packet: claims, their facts, documents, and the decisions on the period.

    A claim belongs to each packet its holding is a member of. Decisions are reached through the marks they bind, so one on an
    older revision of the period's mark is in the bundle too; each tells how many assessments it binds.
    """
    ledger = assessment.ledger
    members = assessment.members.select("fund_id", *KEY)
    claims = members.join(ledger.claim.select("holding_id", "claim_id", "document_no", "source_class", "execution_status", "issued_date"), "holding_id")
    facts = claims.select("fund_id", "period_id", "claim_id").join(ledger.fact.select("claim_id", "field_name", "value_text", "state", "quote", "span_start", "span_end"), "claim_id")
    bound = ledger.decision_evidence.groupBy("decision_id").agg(F.count("*").alias("bound"))
    decided = ledger.decision.select("decision_id", "decision_type", "status", "mark_id", "actor_id", "decided_at").join(bound, "decision_id", "left")
    decisions = ledger.mark.select("mark_id", "fund_id", "period_id", "holding_id", "revision").join(decided, "mark_id").withColumn("bound", F.coalesce("bound", F.lit(0)))
    return {"claim": claims, "fact": facts, "document": evidence_documents(assessment), "decision": decisions.join(assessment.periods.select("period_id"), "period_id", "left_semi")}


def row_json(assessment: Assessment) -> DataFrame:
    """PKT-10: a row and its computed conclusion as JSON: its five assessments, what is unsupported and why, whether it is approved."""
    requests = F.array(*[F.struct(F.lit(code).alias("requirement"), F.col(code.lower()).alias("verdict"), (F.col(code.lower()) != "not_applicable").alias("applicable")) for code in model.REQUESTS])
    return packet_rows(assessment).select(*KEY, F.to_json(F.struct(
        F.col("approved"), requests.alias("assessments"), F.col("held"), F.col("holding_id").alias("holding"), F.col("reported_amount").cast("string").alias("reported"), F.col("row_verdict"),
        F.col("supported"), F.map_from_entries(F.array_sort(F.map_entries("unsupported_reasons"))).alias("unsupported_reasons"))).alias("json"))


def recomputation_json(assessment: Assessment, policy_version: str) -> DataFrame:
    """PKT-10: beside a row, never inside it, what the same evidence derives; rows that could not be recomputed have their entry too.

    A difference is null, not zero, where either side is absent. The lots behind a figure are rows of `validators.lot_lineage`.
    """
    told = F.struct(
        F.col("derived").cast("string").alias("derived"), F.col("difference").cast("string").alias("difference"), F.col("holding_id").alias("holding"), F.col("outcome"),
        F.lit(policy_version).alias("policy_version"), F.col("reason"), F.col("reported").cast("string").alias("reported"))
    return recomputations(assessment).select("fund_id", *KEY, F.to_json(told, {"ignoreNullFields": "false"}).alias("json"))


def total_json(kind: str, amount: str, unsupported: str, counts: dict[str, str]) -> Column:
    """A total with what it is a total of and how much of it is unsupported; figures are text, so no reader rounds them."""
    fields = [F.lit(kind).alias("kind"), F.col(amount).cast("string").alias("amount"), F.col(unsupported).cast("string").alias("unsupported_amount"),
              *[F.col(column).alias(name) for name, column in counts.items()], (F.col(counts["unsupported_positions"]) > 0).alias("contains_unsupported_inputs")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def totals_json(assessment: Assessment) -> DataFrame:
    """PKT-10/PKT-15: the two totals of each packet as JSON, the reported one and the approved one."""
    rows, key = packet_rows(assessment), ["fund_id", "period_id"]
    held, approved = totals.held_totals(rows, key), totals.approved_totals(rows, key)
    counts = {"unsupported_positions": "unsupported_positions", "packet_gap_positions": "packet_gap_positions"}
    return held.select(*key, total_json("held_at_date_reported", "amount", "unsupported_amount", counts).alias("held_total")).join(
        approved.select(*key, total_json("approved", "approved_amount", "unsupported_amount", {"unsupported_positions": "unsupported_positions"}).alias("approved_total")), key)


# What the codes mean, in this house's words; a house with other words passes its own.
GLOSSARY = {
    "R1": "The position exists and cost what is recorded.", "R2": "The reported value has support at the date.", "R3": "An unchanged mark was looked at again.",
    "R4": "What a sale brought in is evidenced.", "R5": "Figures that anticipate an event are marked as such.",
    "sufficient": "The documents answer the request.", "partial": "The documents answer a part of the request.", "insufficient": "The documents do not carry the value.",
    "missing": "No document answers the request.", "conflicting": "Documents contradict each other.", "not_applicable": "The request does not arise here.",
}


def row_payload(assessment: Assessment, glossary: dict[str, str] | None = None) -> DataFrame:
    """PKT-12: what a restatement may draw on: verdict and request with their meaning, reasons, steps still owed, evidence.

    An absent fact has no key, so there is nothing to narrate about it; an id stands under a name that says it is one where no
    name is known. A reason's meaning that speaks of another verdict than the row's is left out, its code stays. Evidence is
    told by kind of document with the number and the first and last day, so a payload does not grow with the claims.
    """
    glossary = GLOSSARY if glossary is None else glossary
    known = F.create_map(*[F.lit(x) for pair in glossary.items() for x in pair]) if glossary else F.create_map().cast("map<string,string>")
    empty_to_null = lambda c: F.when(F.size(c) > 0, c)
    foreign = [(v, F.lit(rf"(?i)(?<!in)\b{v.replace('_', ' ')}")) for v in model.VERDICTS]

    def reason(code: Column) -> Column:
        meaning = known[code]
        other = F.lit(False)
        for verdict, word in foreign:
            other = other | ((F.col("verdict") != verdict) & F.coalesce(F.regexp_like(meaning, word), F.lit(False)))
        return F.struct(code.alias("code"), F.when(~other, meaning).alias("meaning"))

    from attestor.operators.rules import links

    step = lambda code: F.struct(code.alias("code"), known[code].alias("meaning"))
    names = assessment.ledger.holding.select("holding_id", "company_name")
    documents = assessment.ledger.claim.select("claim_id", "source_class", "execution_status", "issued_date")
    kinds = links(assessment).select(*KEY, "requirement", "claim_id").join(documents, "claim_id").groupBy(*KEY, "requirement", "source_class", "execution_status").agg(
        F.count("*").alias("claims"), F.min("issued_date").cast("string").alias("first_issued"), F.max("issued_date").cast("string").alias("last_issued"))
    # At most one row a pair of closed vocabularies here.
    evidence = kinds.groupBy(*KEY, "requirement").agg(F.array_sort(F.collect_list(F.struct(
        "source_class", F.when(F.col("execution_status") != "not_applicable", F.col("execution_status")).alias("execution_status"), "claims", "first_issued", "last_issued"))).alias("evidence"))
    owing = assessment.outcomes.filter(F.size("next_actions") > 0).groupBy(*KEY).agg(F.array_sort(F.collect_set("requirement")).alias("owing"))
    arises = assessment.outcomes.filter("verdict <> 'not_applicable'").join(names, "holding_id").join(assessment.periods.select("period_id", "period_date"), "period_id")
    rows = arises.join(evidence, [*KEY, "requirement"], "left").join(owing, KEY, "left")
    others = F.array_remove(F.coalesce("owing", F.array().cast("array<string>")), F.col("requirement"))
    return rows.select(*KEY, "requirement", F.to_json(F.struct(
        F.coalesce("company_name", F.concat(F.lit("no name on file, its id is "), "holding_id")).alias("company"), F.col("evidence"), F.col("period_date").cast("string").alias("measurement_date"),
        empty_to_null(F.transform("next_actions", step)).alias("not_yet_done"), empty_to_null(others).alias("other_requests_with_open_steps"), empty_to_null(F.transform("reasons", reason)).alias("reasons"),
        F.col("requirement").alias("request"), known[F.col("requirement")].alias("request_means"), F.col("verdict"), known[F.col("verdict")].alias("verdict_means"))).alias("payload"))


def holding_file(assessment: Assessment, holding_id: str) -> DataFrame:
    """PKT-13: every claim of one holding with its facts and cited passages; the filter reaches the scan."""
    ledger = assessment.ledger
    claims = ledger.claim.filter(F.col("holding_id") == holding_id).select("claim_id", "source_class", "issued_date", "document_no")
    facts = ledger.fact.filter(F.col("holding_id") == holding_id).select("claim_id", "field_name", "value_text", "quote", "span_start", "span_end")
    return claims.join(facts, "claim_id", "left")


def document_file(documents: DataFrame, document_id: str) -> DataFrame:
    """PKT-14: one document with extractor, hashes and length."""
    return documents.filter(F.col("document_id") == document_id).select(
        "document_id", "filename", "extractor", S.text_hash(F.col("extractor"), F.col("canonical_text")).alias("text_hash"),
        F.length("canonical_text").alias("text_length"), "canonical_text")
