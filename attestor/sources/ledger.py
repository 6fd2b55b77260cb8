"""SRC-01: the ledger as a bundle of lazy frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.derived import DerivedFrames


@dataclass(frozen=True)
class Ledger:
    fund: DataFrame
    holding: DataFrame
    period: DataFrame
    lot: DataFrame
    conversion: DataFrame
    mark: DataFrame
    claim: DataFrame  # one row per claim, `requirements` folded in
    fact: DataFrame
    gap: DataFrame
    component: DataFrame
    support: DataFrame
    decision: DataFrame
    decision_evidence: DataFrame
    policy_decision: DataFrame
    document: DataFrame

    @property
    def packet_period(self) -> DataFrame:
        return self.period.filter("audit_scope = 'packet'")


SCHEMAS = {
    "fund": "fund_id string, legal_name string",
    "holding": "holding_id string, fund_id string, company_name string, position_type string, currency string",
    "period": "period_id string, fund_id string, period_date date, audit_scope string, label string",
    "lot": "lot_id string, holding_id string, security_class string, shares decimal(18,0), entry_pps decimal(18,6), "
           "cost_amount decimal(24,4), acquired_date date, realized_date date",
    "conversion": "lot_id string, effective_date date, to_security_class string, exchange_ratio decimal(18,8), to_shares decimal(18,0)",
    "mark": "mark_id string, holding_id string, fund_id string, period_id string, period_date date, audit_scope string, revision int, "
            "reported_amount decimal(24,4), reported_currency string, basis string",
    "claim": "claim_id string, holding_id string, fund_id string, position_type string, document_no bigint, source_class string, "
             "execution_status string, issued_date date, received_date date, applicable_from date, applicable_to date, "
             "priced_class string, price_per_share decimal(18,6), supersedes_claim_id string",
    "claim_requirement": "claim_id string, requirement string",
    "fact": "claim_id string, holding_id string, field_name string, value_text string, value_numeric decimal(26,6), quote string, "
            "span_start int, span_end int, state string",
    "gap": "gap_id string, holding_id string, requirement string, security_class string, kind string, missing_document string",
    "component": "holding_id string, component string",
    "support": "holding_id string, component string, supported_on date, lot_id string, claim_id string",
    "decision": "decision_id bigint, decision_type string, status string, assessment_kind string, holding_id string, mark_id string, "
                "period_id string, period_date date, decided_at timestamp, actor_id string",
    "decision_evidence": "decision_id bigint, mark_id string, assessment_id string, requirement string",
    "policy_decision": "decision_id string, holding_id string, fund_id string, period_id string, period_date date, from_class string, to_class string",
    "document": "document_id string, document_no bigint, canonical_text string, filename string, extractor string",
}


def fold_requirements(claim: DataFrame, claim_requirement: DataFrame) -> DataFrame:
    """Children folded into their parent: the requests a claim may answer become one sorted array."""
    folded = claim_requirement.groupBy("claim_id").agg(F.array_sort(F.collect_set("requirement")).alias("requirements"))
    return claim.join(folded, "claim_id", "left").withColumn("requirements", F.coalesce("requirements", F.array().cast("array<string>")))


def read(spark: SparkSession, folder: str) -> Ledger:
    """Read a stored ledger: one Parquet directory per table, schemas stated and never inferred."""
    table = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
    claim = fold_requirements(table.pop("claim"), table.pop("claim_requirement"))
    return Ledger(claim=claim, **table)


def from_derived(fr: DerivedFrames) -> Ledger:
    """The ledger that the test tables stand for."""
    flags = [F.when(F.col(name.lower()), name) for name in ("R1", "R2", "R4")]
    claim = fr["f_claim"].withColumn("requirements", F.array_compact(F.array(*flags)))
    return Ledger(
        fund=fr["f_fund"], holding=fr["f_holding"], period=fr["f_period"], lot=fr["f_lot"], conversion=fr["f_conversion"],
        mark=fr["f_mark"], claim=claim, fact=fr["f_fact"], gap=fr["f_gap"], component=fr["f_component"], support=fr["f_support"],
        decision=fr["f_decision"], decision_evidence=fr["f_decision_evidence"], policy_decision=fr["f_policy_decision"], document=fr["f_document"],
    )


#: Frames of a ledger that name the holding of every row.
BY_HOLDING = ("holding", "lot", "mark", "claim", "fact", "gap", "component", "support", "decision", "policy_decision")


def of_holdings(ledger: Ledger, holdings: DataFrame) -> Ledger:
    """The ledger's rows of some holdings (holding_id, each once); dates, funds and documents stay whole."""
    kept = {name: getattr(ledger, name).join(holdings, "holding_id", "left_semi") for name in BY_HOLDING}
    kept["conversion"] = ledger.conversion.join(kept["lot"].select("lot_id"), "lot_id", "left_semi")
    kept["decision_evidence"] = ledger.decision_evidence.join(kept["decision"].select("decision_id"), "decision_id", "left_semi")
    return replace(ledger, **kept)
