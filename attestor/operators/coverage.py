"""Coverage of the request letter: what each limb is owed for, and whether the ledger answers it.

Evidence is a long frame (holding, date, dimension, value) and the limbs are a few dozen value rows, so one join
replaces a set intersection per holding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.operators import retrieval
from attestor.operators.rules import Assessment

DIMENSIONS = ("class", "status", "field", "decision", "consideration")


def evidence(assessment: Assessment, considerations: DataFrame, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """COV-02: what is known of each position, and of each position at each packet date inside the reliance windows.

    Without ``once`` a word stands as often as it is said, and no row is shuffled to make it one.
    """
    ledger = assessment.ledger
    claims = ledger.claim.select("claim_id", "holding_id", "fund_id", "source_class", "execution_status", "applicable_from", "applicable_to")
    facts = ledger.fact.select("claim_id", "field_name").distinct()

    def dimensions(frame: DataFrame, keys: list[str]) -> DataFrame:
        of_claim = frame.select(*keys, F.explode(F.create_map(F.lit("class"), F.col("source_class"), F.lit("status"), F.col("execution_status"))).alias("dimension", "value"))
        of_fact = frame.join(facts, "claim_id").select(*keys, F.lit("field").alias("dimension"), F.col("field_name").alias("value"))
        return of_claim.unionByName(of_fact)

    decisions = ledger.decision.filter("mark_id IS NOT NULL").select("holding_id", "period_id", F.lit("decision").alias("dimension"), F.coalesce("assessment_kind", "decision_type").alias("value"))
    considered = considerations.join(ledger.decision.select("decision_id", "holding_id", "period_id"), "decision_id").select(
        "holding_id", "period_id", F.lit("consideration").alias("dimension"), F.col("consideration").alias("value"))
    dated = claims.join(assessment.periods.select("fund_id", "period_id", "period_date"), "fund_id").filter(retrieval.temporal.window_covers(F.col("period_date")))
    by_date = dimensions(dated, ["holding_id", "period_id"]).unionByName(decisions).unionByName(considered)
    by_position = dimensions(claims, ["holding_id"]).unionByName(decisions.drop("period_id")).unionByName(considered.drop("period_id"))
    return (by_position.distinct(), by_date.distinct()) if once else (by_position, by_date)


def owed(assessment: Assessment, branches: DataFrame) -> DataFrame:
    """COV-03: the positions, position-dates or realisations each limb is owed for.

    ``branches`` (holding_id, branch) says which arm of the fair-value request a position falls under.
    """
    limbs = F.broadcast(model.limbs(branches.sparkSession))
    held = assessment.held_keys.select("holding_id", "period_id")
    none = F.lit(None).cast("string")
    positions = held.select("holding_id").distinct().select("holding_id", none.alias("period_id"), F.lit("position").alias("scope"), none.alias("branch_of"))
    realised = assessment.ledger.lot.filter("realized_date IS NOT NULL").select("holding_id").distinct().select("holding_id", none.alias("period_id"), F.lit("realisation").alias("scope"), none.alias("branch_of"))
    dates = held.join(branches, "holding_id", "left").select("holding_id", "period_id", F.lit("position_date").alias("scope"), F.col("branch").alias("branch_of"))
    cells = positions.unionByName(realised).unionByName(dates)
    return cells.join(limbs, "scope").filter(F.col("branch").isNull() | (F.col("branch") == F.col("branch_of"))).drop("branch_of", "branch")


def answered(owed_cells: DataFrame, by_position: DataFrame, by_date: DataFrame) -> DataFrame:
    """COV-01: a limb is answered when every dimension it declares finds one of its alternatives.

    The dimensions met are bits united per limb and cell, combined before the shuffle, so it does not matter how often a word is said.
    """
    wanted = F.broadcast(model.limb_values(owed_cells.sparkSession))
    none = F.lit(None).cast("string")
    hits = by_date.join(wanted, ["dimension", "value"]).select("limb", "holding_id", "period_id", "dimension").unionByName(
        by_position.join(wanted, ["dimension", "value"]).select("limb", "holding_id", none.alias("period_id"), "dimension"))
    met = hits.groupBy("limb", "holding_id", F.coalesce("period_id", F.lit("")).alias("period_key")).agg(F.bit_count(F.bit_or(model.code_bit(F.col("dimension"), DIMENSIONS))).alias("met"))
    cells = owed_cells.withColumn("period_key", F.coalesce("period_id", F.lit("")))
    return cells.join(met, ["limb", "holding_id", "period_key"], "left").withColumn(
        "answered", F.coalesce(F.col("met") == F.col("dimensions"), F.lit(False))).drop("met", "period_key")


def limb_rows(spark, limbs=model.LIMBS) -> tuple[DataFrame, DataFrame]:
    """Limbs and the values they ask for, from rows (key, paragraph, scope, branch, {dimension: values})."""
    heads = spark.createDataFrame([(k, s, b, len(d)) for k, _, s, b, d in limbs], "limb string, scope string, branch string, dimensions int")
    return heads, spark.createDataFrame([(k, n, v) for k, _, _, _, d in limbs for n, vs in d.items() for v in vs], "limb string, dimension string, value string")


def vocabulary(facts: DataFrame) -> DataFrame:
    """Every word the ledger can say: its closed vocabularies, and the fields that its facts use."""
    fixed = [("class", v) for v in model.SOURCE_CLASSES] + [("status", v) for v in model.EXECUTION_STATUSES]
    fixed += [("decision", v) for v in ("transcription", "valuation", "management_assessment", "packet", "basis_memo", "representativeness", "calibration")]
    fixed += [("consideration", v) for v in ("company_performance", "market_conditions", "impairment_indicators")]
    return F.broadcast(facts.sparkSession.createDataFrame(fixed, "dimension string, value string")).unionByName(
        facts.select(F.lit("field").alias("dimension"), F.col("field_name").alias("value")).distinct())


def missing_vocabulary(facts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """COV-04: what a limb asks for that the ledger has no word for."""
    values = model.limb_values(facts.sparkSession) if values is None else values
    return values.join(vocabulary(facts), ["dimension", "value"], "left_anti").groupBy("limb").agg(F.array_sort(F.collect_set("value")).alias("missing"))


def indistinguishable(limbs: DataFrame, values: DataFrame, said_of: DataFrame | None = None) -> DataFrame:
    """COV-05: limbs of one scope whose whole predicates are the same, so one record would answer all of them.

    With ``said_of`` (dimension, value) predicates are compared in the words that the ledger says of some position; without it as they
    are written, also in words that occur nowhere.
    """
    if said_of is not None:
        values = values.join(said_of.select("dimension", "value").distinct(), ["dimension", "value"], "left_semi")
    said = values.groupBy("limb").agg(F.array_sort(F.collect_set(F.concat_ws("=", "dimension", "value"))).alias("predicate"))
    grouped = limbs.select("limb", "scope").join(said, "limb").groupBy("scope", "predicate").agg(F.array_sort(F.collect_set("limb")).alias("limbs"))
    return grouped.filter(F.size("limbs") > 1)


def standing(result: DataFrame, limbs: DataFrame, values: DataFrame, facts: DataFrame) -> DataFrame:
    """COV-04: what can be said of each limb: `not_expressible`, with the reasons; `unanswered`, though it could be answered; or a `census`.

    ``result`` is what `answered` gives. A limb that nothing in the ledger could answer is no finding about the documents, so its
    count of answers is not stated.
    """
    counts = result.groupBy("limb").agg(F.count("*").alias("owed"), F.count_if("answered").alias("answered"))
    twins = indistinguishable(limbs, values).select("limbs", F.explode("limbs").alias("limb")).select("limb", F.array_remove("limbs", F.col("limb")).alias("twins"))
    rows = limbs.select("limb").join(missing_vocabulary(facts, values), "limb", "left").join(twins, "limb", "left").join(counts, "limb", "left")
    rows = rows.withColumn("owed", F.coalesce("owed", F.lit(0))).withColumn("answered", F.coalesce("answered", F.lit(0)))
    reasons = F.array_compact(F.array(
        F.when(F.col("missing").isNotNull(), F.concat(F.lit("no word for "), F.array_join("missing", ", "))),
        F.when(F.col("twins").isNotNull(), F.concat(F.lit("asks the same as "), F.array_join("twins", ", ")))))
    state = F.when(F.size(reasons) > 0, "not_expressible").when(F.col("answered") == 0, "unanswered").otherwise("census")
    return rows.select("limb", state.alias("standing"), reasons.alias("reasons"), "owed", F.when(F.size(reasons) == 0, F.col("answered")).alias("answered"))


def by_fund(result: DataFrame, holdings: DataFrame) -> DataFrame:
    """COV-06: answered and owed per limb and fund."""
    return result.join(holdings.select("holding_id", "fund_id"), "holding_id").groupBy("limb", "fund_id").agg(
        F.count_if("answered").alias("answered"), F.count("*").alias("owed"), F.countDistinct(F.when(F.col("answered"), F.col("holding_id"))).alias("companies_answered"))
