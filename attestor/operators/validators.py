"""Independent recomputation of stated figures; every row gets one outcome and a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import temporal


def stated_values(facts: DataFrame) -> DataFrame:
    """FN-28: the one holding value a claim states; two declared fields leave the value null and the count 2."""
    return (
        facts.filter(F.col("field_name").isin(*model.VALUE_FIELDS))
        .groupBy("claim_id").agg(F.count("*").alias("declared"), F.max("value_numeric").alias("stated_value"))
        .withColumn("stated_value", F.when(F.col("declared") == 1, F.col("stated_value")))
    )


KEY = ["holding_id", "period_id"]
MONEY = "decimal(36,6)"


def compared(computed, stated):
    """Pass or fail on exact equality of two decimals."""
    return F.when(computed == stated, "pass").otherwise("fail")


def entry_cost(lots: DataFrame) -> DataFrame:
    """VAL-01: shares times entry price against the stated cost."""
    computed = S.implied_cost(F.col("entry_pps"), F.col("shares"))
    stated = F.col("cost_amount").cast(MONEY)
    return lots.select(
        "lot_id",
        F.when(computed.isNull(), "not_applicable").otherwise(compared(computed.cast(MONEY), stated)).alias("outcome"),
        F.when(F.col("shares").isNull(), "NO_SHARE_COUNT").when(F.col("entry_pps").isNull(), "NO_ENTRY_PRICE").otherwise("SHARES_X_ENTRY_PPS").alias("reason"),
        computed.cast(MONEY).alias("computed"), stated.alias("stated"),
    )


def recapitalisation(lots: DataFrame, conversions: DataFrame) -> DataFrame:
    """VAL-12: prior shares times the exchange ratio against the converted count; a fraction of a share fails."""
    joined = conversions.join(lots.select("lot_id", "shares"), "lot_id")
    computed = F.col("shares").cast("decimal(18,0)") * F.col("exchange_ratio").cast("decimal(18,8)")
    fractional = computed != F.floor(computed)
    return joined.select(
        "lot_id",
        F.when(computed.isNull(), "blocked_incomplete").when(fractional, "fail").otherwise(compared(computed, F.col("to_shares"))).alias("outcome"),
        F.when(computed.isNull(), "NO_PRIOR_SHARE_COUNT").when(fractional, "FRACTIONAL_SHARE_UNSUPPORTED").otherwise("PRIOR_SHARES_X_EXCHANGE_RATIO").alias("reason"),
        computed.cast("decimal(38,8)").alias("computed"), F.col("to_shares").cast("decimal(18,0)").alias("stated"),
    )


def realised_gross(terms: DataFrame) -> DataFrame:
    """VAL-08: shares times cash per share against the stated gross."""
    computed = S.implied_cost(F.col("cash_per_share"), F.col("realised_shares")).cast(MONEY)
    return terms.withColumn("computed_gross", computed).withColumn(
        "gross_outcome", F.when(F.col("stated_gross").isNull(), "blocked_incomplete").otherwise(compared(F.col("computed_gross"), F.col("stated_gross").cast(MONEY))))


def realised_net(terms: DataFrame) -> DataFrame:
    """VAL-09: net is gross less fees, escrow, earn-out and withholding; a separate line from the gross."""
    gross = S.implied_cost(F.col("cash_per_share"), F.col("realised_shares")).cast(MONEY)
    deductions = [F.coalesce(F.col(c), F.lit(0)).cast("decimal(24,6)") for c in ("fees", "escrow", "earnout", "withholding")]
    net = (gross.cast("decimal(30,6)") - deductions[0] - deductions[1] - deductions[2] - deductions[3]).cast(MONEY)
    return terms.withColumn("computed_net", net).withColumn(
        "net_outcome", F.when(F.col("stated_net").isNull(), "blocked_incomplete").otherwise(compared(F.col("computed_net"), F.col("stated_net").cast(MONEY))))


def diluted_shares(rounds: DataFrame) -> DataFrame:
    """VAL-05/JN-15: post-money over price equals the stated diluted count, by cross-multiplication.

    ``rounds`` carries the five-part key of the round and, per source of the price and the count, the same five
    parts prefixed price_ and shares_. Keys that disagree make the figures incomparable, not wrong.
    """
    parts = ("company", "round_name", "effective_date", "currency", "scope")
    same = F.lit(True)
    for source in ("price", "shares"):
        for part in parts:
            same = same & F.coalesce(F.col(f"{source}_{part}") == F.col(part), F.col(f"{source}_{part}").isNull())
    zero = F.col("price_per_share") == 0
    product = F.col("stated_shares").cast("decimal(18,0)") * F.col("price_per_share").cast("decimal(18,6)")
    exact = product == F.col("post_money").cast(MONEY)
    return rounds.select(
        "claim_id",
        F.when(~same, "not_comparable").when(zero, "blocked_incomplete").when(exact, "pass").otherwise("not_comparable").alias("outcome"),
        F.when(~same, "JOIN_KEYS_DIFFER").when(zero, "ZERO_PRICE_PER_SHARE").otherwise("POST_MONEY_OVER_PRICE_PER_SHARE").alias("reason"),
        F.when(same & ~zero, F.col("post_money").cast("decimal(24,4)") / F.when(~zero, F.col("price_per_share"))).cast("decimal(28,4)").alias("computed"),
        F.col("stated_shares").alias("stated"),
    )


def fx_recomputation(values: DataFrame) -> DataFrame:
    """VAL-07: foreign amount times rate against the concluded value; a stated rounding unit explains a variance."""
    recomputed = (F.col("foreign_amount").cast("decimal(20,4)") * F.col("rate").cast("decimal(16,8)")).cast("decimal(34,8)")
    concluded = F.col("concluded").cast("decimal(34,8)")
    rounding = S.rounds_to(F.col("computed"), concluded, F.col("rounding_unit"))
    return values.withColumn("computed", recomputed).withColumn(
        "reason", F.when(F.col("computed") == concluded, "EXACT").when(rounding, "ROUNDING_VARIANCE").otherwise("UNRECOGNISED_VARIANCE")
    ).withColumn("outcome", F.when(F.col("reason") == "UNRECOGNISED_VARIANCE", "fail").otherwise("pass"))


def fx_rate_present(assessment, observed: DataFrame | None = None) -> DataFrame:
    """VAL-06: one observed, cited, directed rate for the measurement date of every held FX position.

    ``observed`` (base, quote, rate, observed_date, effective_for, source_claim_id, source_document_id).
    """
    ledger = assessment.ledger
    text = ledger.fact.filter(F.col("field_name").isin("currency_pair", "fx_rate_effective_date", "fx_rate")).groupBy("claim_id").agg(
        F.max(F.when(F.col("field_name") == "currency_pair", F.col("value_text"))).alias("currency_pair"),
        F.max(F.when(F.col("field_name") == "fx_rate_effective_date", F.col("value_text"))).try_cast("date").alias("stated_for"),
        F.bool_or(F.col("field_name") == "fx_rate").alias("has_rate"))
    held = assessment.held_keys.select(*KEY, "period_date").join(
        ledger.holding.filter("position_type = 'fx_denominated_interest'").select("holding_id"), "holding_id")
    in_scope = assessment.relied.filter("requirement = 'R2'").select(*KEY, "period_date", "claim_id").join(text, "claim_id").filter(
        F.col("has_rate") & (F.col("stated_for") == F.col("period_date"))).groupBy(*KEY).agg(F.count("*").alias("cited_rates"))
    rows = held.join(in_scope, KEY, "left")
    if observed is None:
        return rows.select(
            *KEY, F.when(F.col("cited_rates").isNotNull(), "blocked_incomplete").otherwise("fail").alias("outcome"),
            F.when(F.col("cited_rates").isNotNull(), "FX_RATE_NOT_IN_LEDGER").otherwise("unsupported_missing_fx").alias("reason"),
            F.lit(None).cast("decimal(18,8)").alias("computed"))
    cited = observed.join(ledger.claim.select(F.col("claim_id").alias("source_claim_id"), "holding_id"), "source_claim_id").join(
        text.select(F.col("claim_id").alias("source_claim_id"), "currency_pair"), "source_claim_id")
    kept = cited.filter(F.col("currency_pair") == F.concat_ws("/", "base", "quote"))
    best = kept.groupBy("holding_id", F.col("effective_for").alias("period_date")).agg(
        F.count("*").alias("rates"),
        F.min_by(F.struct("base", "quote", "rate", "observed_date", "source_document_id"), "source_claim_id").alias("r"))
    met = held.join(best, ["holding_id", "period_date"], "left")
    undirected = (F.col("r.base") == F.col("r.quote")) | (F.col("r.base") == "") | (F.col("r.quote") == "")
    uncited = F.col("r.source_document_id").isNull() | (F.col("r.source_document_id") == "")
    reason = (
        F.when(F.col("rates").isNull(), "unsupported_missing_fx").when(F.col("rates") > 1, "MULTIPLE_FX_RATES_FOR_DATE")
        .when(uncited, "FX_RATE_UNCITED").when(undirected, "FX_RATE_PAIR_UNDIRECTED")
        .when(F.col("r.observed_date") != F.col("period_date"), "FX_RATE_NOT_OBSERVED_FOR_DATE").otherwise("FX_RATE_OBSERVED_FOR_MEASUREMENT_DATE"))
    return met.withColumn("reason", reason).select(
        *KEY, F.when(F.col("reason") == "MULTIPLE_FX_RATES_FOR_DATE", "blocked_incomplete")
        .when(F.col("reason") == "FX_RATE_OBSERVED_FOR_MEASUREMENT_DATE", "pass").otherwise("fail").alias("outcome"),
        "reason", F.when(F.col("reason").isin("FX_RATE_NOT_OBSERVED_FOR_DATE", "FX_RATE_OBSERVED_FOR_MEASUREMENT_DATE"), F.col("r.rate")).cast("decimal(18,8)").alias("computed"))


def held_classes(assessment) -> DataFrame:
    """Held lots reduced to one row per class: share count and whether any lot lacks one."""
    return assessment.lots.filter("held").groupBy(*KEY, "period_date", "held_class").agg(
        F.sum("held_shares").cast("decimal(24,0)").alias("shares"), F.bool_or(F.col("held_shares").isNull()).alias("no_shares"))


def class_prices(priced: DataFrame) -> DataFrame:
    """WIN-09: per priced class the last claim by (issued, id)."""
    order = F.struct("issued_date", "claim_id")
    return priced.filter("priced_class IS NOT NULL").groupBy(*KEY, F.col("priced_class").alias("held_class")).agg(
        F.max_by(F.struct(F.col("price_per_share").alias("price"), F.col("claim_id").alias("price_claim")), order).alias("own"))


def per_class(classes: DataFrame, priced: DataFrame, authorised: DataFrame | None) -> DataFrame:
    """VAL-03: value of each holding-date as class shares times the price of that class.

    A missing share count refuses before prices are looked at; with a recorded decision the latest price of any
    class is borrowed and flagged; otherwise classes without a price refuse by name.
    """
    order = F.struct("issued_date", "claim_id")
    last = priced.groupBy(*KEY).agg(F.max_by(F.struct("price_per_share", "priced_class", "claim_id"), order).alias("last"))
    rows = classes.join(class_prices(priced), [*KEY, "held_class"], "left").join(last, KEY, "left")
    if authorised is not None:
        rows = rows.join(authorised, KEY, "left").withColumn("authorised", F.coalesce("authorised", F.lit(False)))
    else:
        rows = rows.withColumn("authorised", F.lit(False))
    borrowed = F.col("own").isNull() & F.col("authorised") & F.col("last").isNotNull()
    price = F.coalesce("own.price", F.when(borrowed, F.col("last.price_per_share")))
    rows = (
        rows.withColumn("price", price).withColumn("used_claim", F.coalesce("own.price_claim", F.when(borrowed, F.col("last.claim_id"))))
        .withColumn("cross_class", F.when(borrowed, ~F.col("last.priced_class").eqNullSafe(F.col("held_class"))).otherwise(False))
        .withColumn("amount", (F.col("shares").cast("decimal(18,0)") * F.col("price").cast("decimal(18,6)")).cast(MONEY))
    )
    part = F.when(F.col("price").isNotNull(), F.struct("held_class", F.col("shares").cast("string").alias("shares"), F.col("price").cast("string").alias("price"), "cross_class"))
    total = rows.groupBy(*KEY).agg(
        F.bool_or("no_shares").alias("no_shares"), F.bool_or(F.col("last").isNull()).alias("no_price"),
        F.array_sort(F.collect_set(F.when(F.col("price").isNull(), F.col("held_class")))).alias("uncovered"),
        F.sum("amount").cast(MONEY).alias("total"), F.array_sort(F.collect_set(part)).alias("parts"),
        F.array_sort(F.collect_set("used_claim")).alias("evidence"))
    usable = ~F.col("no_shares") & ~F.col("no_price") & (F.size("uncovered") == 0)
    reason = (
        F.when(F.col("no_shares"), "COMPONENT_WITHOUT_SHARE_COUNT").when(F.col("no_price"), "NO_PRICE_IN_EVIDENCE")
        .when(F.size("uncovered") > 0, F.concat(F.lit("NO_PRICE_FOR_CLASS:"), F.concat_ws(",", "uncovered"))).otherwise("PER_CLASS_SHARES_X_PPS"))
    empty = F.array().cast("array<string>")
    return total.select(*KEY, F.when(usable, F.col("total")).alias("class_value"), reason.alias("class_reason"),
                        F.when(usable, F.col("parts")).alias("parts"), F.when(usable, F.col("evidence")).otherwise(empty).alias("class_evidence"))


def derive_marks(assessment) -> DataFrame:
    """VAL-02: what the relied-on evidence derives for each held holding-date."""
    return assessment.keep("derived", lambda: _derive_marks(assessment))


def _derive_marks(assessment) -> DataFrame:
    columns = [*KEY, "claim_id", "source_class", "issued_date", "priced_class", "price_per_share"]
    relied = assessment.relied_for("R2").select(*columns)
    # Claims meet what they state a row each, before the dates multiply them.
    valued = assessment.relied_for("R2", stated_values(assessment.ledger.fact).select("claim_id", "stated_value")).select(*columns, "stated_value")
    rank = F.lit(None).cast("int")
    for n, (source, _) in reversed(list(enumerate(model.AMOUNT_AUTHORITY))):
        rank = F.when(F.col("source_class") == source, n).otherwise(rank)
    stated = F.col("stated_value").isNotNull()
    bearing = F.col("source_class").isin(*[s for s, _ in model.AMOUNT_AUTHORITY])
    evidence = valued.withColumn("authority", rank).groupBy(*KEY).agg(
        F.min_by(F.struct("stated_value", "authority", "claim_id"), F.when(stated & F.col("authority").isNotNull(), F.struct("authority", "issued_date", "claim_id"))).alias("amount"),
        F.bool_or(stated).alias("any_amount"), F.bool_or(F.col("price_per_share").isNotNull()).alias("any_price"), F.bool_or(bearing).alias("any_bearing"))
    priced = relied.filter("price_per_share IS NOT NULL")
    classes = per_class(held_classes(assessment), priced, assessment.authorised)
    rows = assessment.held_keys.join(evidence, KEY, "left").join(classes, KEY, "left")
    reason = F.lit(None).cast("string")
    for n, (_, name) in reversed(list(enumerate(model.AMOUNT_AUTHORITY))):
        reason = F.when(F.col("amount.authority") == n, name).otherwise(reason)
    by_amount = F.coalesce("any_amount", F.lit(False))
    by_class = ~by_amount & F.coalesce("any_price", F.lit(False))
    return rows.select(
        *KEY, "fund_id", "period_date",
        F.when(by_amount, F.col("amount.stated_value").cast(MONEY)).when(by_class, F.col("class_value")).alias("derived"),
        F.when(F.col("any_amount").isNull(), "NO_APPLICABLE_EVIDENCE").when(by_amount, reason).when(by_class, F.col("class_reason"))
        .when(F.col("any_bearing"), "NO_VALUE_FIELD_CITED").otherwise("NO_PRICE_IN_EVIDENCE").alias("reason"),
        F.when(by_class, F.col("parts")).alias("parts"),
        F.when(by_amount, F.array("amount.claim_id")).when(by_class, F.col("class_evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )


def compare_marks(derived: DataFrame, marks: DataFrame) -> DataFrame:
    """VAL-04: derived against reported, with one of the six outcomes."""
    reported = marks.select(*KEY, F.col("reported_amount").cast(MONEY).alias("reported"), "reported_currency")
    joined = derived.join(reported, KEY, "left")
    carried = F.col("reason") == "MANAGEMENT_CARRYING_VALUE"
    silent = F.col("derived").isNotNull() & ~carried & F.col("reported").isNull()
    return joined.withColumn(
        "outcome", F.when(F.col("derived").isNull(), S.refusal_outcome(F.col("reason"))).when(carried, "not_comparable")
        .when(silent, "blocked_incomplete").otherwise(compared(F.col("derived"), F.col("reported")))
    ).withColumn("reason", F.when(silent, "NO_STATED_FIGURE_TO_COMPARE").otherwise(F.col("reason"))).withColumn(
        "difference", (F.col("reported") - F.col("derived")).cast(MONEY))


def mark_check(assessment) -> DataFrame:
    """V2 over every held holding-date."""
    return compare_marks(derive_marks(assessment), assessment.members.filter("mark_id IS NOT NULL").select(*KEY, "reported_amount", "reported_currency"))


def quoted_value(assessment) -> DataFrame:
    """VAL-11: listed positions at the last close on or before the date times their shares, no borrowing."""
    listed = assessment.ledger.holding.filter("position_type = 'public_listed'").select("holding_id")
    held = assessment.held_keys.join(listed, "holding_id")
    quotes = assessment.relied.filter("requirement = 'R2' AND source_class = 'public_market_quote'")
    done = F.col("issued_date") <= F.col("period_date")
    chosen = quotes.groupBy(*KEY).agg(
        F.count("*").alias("quotes"),
        F.max_by(F.struct("claim_id", "issued_date", "priced_class", "price_per_share"), F.when(done, F.struct("issued_date", "claim_id"))).alias("q"))
    priced = chosen.filter("q IS NOT NULL").select(*KEY, "q.*").filter("price_per_share IS NOT NULL")
    # A close without a price cannot value shares; the reference treats it like a missing count.
    classes = per_class(held_classes(assessment), priced, None)
    rows = held.join(chosen, KEY, "left").join(classes, KEY, "left")
    rows = rows.withColumn("unpriced", F.col("q").isNotNull() & F.col("q.price_per_share").isNull())
    uncovered = F.concat(F.lit("NO_PRICE_FOR_CLASS:"), F.concat_ws(",", F.array_sort("held_list")))
    rows = rows.join(assessment.held_dates.select(*KEY, F.col("held_classes").alias("held_list")), KEY)
    covers = F.coalesce(F.array_contains("held_list", F.col("q.priced_class")), F.lit(False))
    unpriced_reason = F.when(covers & (F.size("held_list") == 1), "COMPONENT_WITHOUT_SHARE_COUNT").when(
        covers, "COMPONENT_WITHOUT_SHARE_COUNT").otherwise(uncovered)
    derived = rows.select(
        *KEY, "quotes", "q", F.when(~F.col("unpriced"), F.col("class_value")).alias("derived"),
        F.when(F.col("unpriced") & ~F.col("class_reason").eqNullSafe("COMPONENT_WITHOUT_SHARE_COUNT"), unpriced_reason).otherwise(F.col("class_reason")).alias("reason"))
    out = compare_marks(derived, assessment.members.filter("mark_id IS NOT NULL").select(*KEY, "reported_amount", "reported_currency"))
    return out.select(
        *KEY,
        F.when(F.col("quotes").isNull(), "unconfirmable").when(F.col("q").isNull(), "fail").otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("quotes").isNull(), "NO_QUOTE_IN_EVIDENCE").when(F.col("q").isNull(), "QUOTE_AFTER_MEASUREMENT_DATE")
        .when(F.col("derived").isNotNull(), "QUOTED_CLOSE_X_SHARES").otherwise(F.col("reason")).alias("reason"),
        F.col("derived").alias("computed"), F.col("reported").alias("stated"), F.col("q.claim_id").alias("evidence"))


def realisations(assessment) -> DataFrame:
    """VAL-10: every lot realised by a packet date, priced by its latest covering claim."""
    ledger = assessment.ledger
    exits = temporal.class_at_realisation(ledger.lot, ledger.conversion).select("lot_id", "holding_id", "realized_date", "exit_class", "exit_shares")
    dated = exits.join(ledger.holding.select("holding_id", "fund_id"), "holding_id").join(
        assessment.periods.select("fund_id", "period_id", "period_date"), "fund_id").filter(F.col("realized_date") <= F.col("period_date"))
    priced = assessment.relied.filter("requirement = 'R4' AND price_per_share IS NOT NULL")
    order = F.struct("issued_date", "claim_id")
    pick = F.max_by(F.struct("issued_date", "claim_id", "price_per_share"), order)
    own = priced.filter("priced_class IS NOT NULL").groupBy(*KEY, F.col("priced_class").alias("exit_class")).agg(pick.alias("own"))
    free = priced.filter("priced_class IS NULL").groupBy(*KEY).agg(pick.alias("free"))
    rows = dated.join(own, [*KEY, "exit_class"], "left").join(free, KEY, "left").withColumn("price", F.greatest("own", "free"))
    computed = S.implied_cost(F.col("price.price_per_share"), F.col("exit_shares")).cast(MONEY)
    return rows.select(
        "lot_id", "period_id",
        F.when(F.col("price").isNull(), "unconfirmable").otherwise("blocked_incomplete").alias("outcome"),
        F.when(F.col("price").isNull(), "NO_REALIZATION_PRICE_IN_EVIDENCE").when(F.col("exit_shares").isNull(), "NO_REALIZED_SHARE_COUNT")
        .otherwise("NO_STATED_GROSS_IN_LEDGER").alias("reason"),
        computed.alias("computed"), F.when(F.col("exit_shares").isNotNull(), F.col("price.claim_id")).alias("evidence"))


def basis_checks(assessment) -> DataFrame:
    """VAL-14: a mark equal to cost while the highest entry price values the same shares higher."""
    lots = assessment.lots.filter("held").groupBy(*KEY, "period_date").agg(
        F.bool_or(F.col("held_shares").isNull()).alias("no_shares"), F.sum("cost_amount").cast("decimal(34,4)").alias("cost"),
        F.max("entry_pps").alias("top"), F.sum("held_shares").cast("decimal(18,0)").alias("shares"))
    last_round = (F.col("shares") * F.col("top")).cast(MONEY)
    marks = assessment.members.filter("mark_id IS NOT NULL").select(*KEY, "reported_amount")
    return lots.filter("NOT no_shares").join(marks, KEY).withColumn("last_round", last_round).filter(
        (F.col("reported_amount") == F.col("cost")) & (F.col("last_round") > F.col("cost"))).select(
        *KEY, "reported_amount", "cost", "last_round", (F.col("last_round") - F.col("cost")).cast(MONEY).alias("variance"))


def foreign_amounts(lots: DataFrame, foreign: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """What positions held at dates (``asked``: holding_id, ``on``) are stated to be worth in their own currency.

    ``foreign``: lot_id, foreign_amount. Null where a held lot states no such amount, or no lot is held.
    """
    stated = lots.select("lot_id", "holding_id", "acquired_date", "realized_date").join(foreign, "lot_id", "left")
    change = lambda day, sign: F.struct(
        day.alias("day"), (F.lit(sign) * F.coalesce("foreign_amount", F.lit(0))).cast("decimal(24,4)").alias("amount"),
        F.lit(sign).cast("long").alias("lots"), (F.lit(sign) * F.col("foreign_amount").isNull().cast("long")).cast("long").alias("unstated"))
    events = stated.select("holding_id", F.explode(F.array(change(F.col("acquired_date"), 1), change(F.col("realized_date"), -1))).alias("e")).select("holding_id", "e.*").filter("day IS NOT NULL")
    sums = temporal.sums_at(events, ["holding_id"], "day", ["amount", "lots", "unstated"], asked, on)
    return sums.select("holding_id", on, F.when((F.col("lots") > 0) & (F.col("unstated") == 0), F.col("amount").cast("decimal(20,4)")).alias("foreign_amount"))


def concluded_values(assessment, foreign: DataFrame) -> DataFrame:
    """VAL-15: the concluded value of a document is authoritative; the mark reported at its own date must equal it.

    The document's date is taken as it stands: a document of a day that is no measurement date of the fund has no mark to equal.
    The recomputation is a cross-check from the position's own stated foreign amount, and corrects nothing.
    """
    ledger = assessment.ledger
    concluded = ledger.fact.filter("field_name = 'concluded_fair_value_usd'").select("claim_id", F.col("value_numeric").alias("concluded"))
    rates = ledger.fact.filter("field_name = 'fx_rate'").select("claim_id", F.col("value_numeric").alias("rate"))
    claims = ledger.claim.select("claim_id", "holding_id", F.col("applicable_from").alias("period_date")).join(concluded, "claim_id").join(rates, "claim_id", "left")
    amounts = foreign_amounts(ledger.lot, foreign, claims.select("holding_id", "period_date"), "period_date")
    recomputed = (F.col("foreign_amount").cast("decimal(20,4)") * F.col("rate").cast("decimal(16,6)")).cast("decimal(30,6)")
    marks = temporal.latest(ledger.mark.select("holding_id", "period_date", "revision", "reported_amount"), ["holding_id", "period_date"], "revision").drop("revision")
    rows = claims.join(amounts, ["holding_id", "period_date"], "left").withColumn("recomputed", recomputed)
    return rows.join(marks, ["holding_id", "period_date"], "left").select(
        "claim_id", F.col("concluded").cast("decimal(26,6)").alias("concluded"), "reported_amount", "recomputed",
        (F.col("concluded") - F.col("recomputed")).cast("decimal(32,6)").alias("variance"),
        S.variance_class(F.col("concluded"), F.col("recomputed")).alias("classification"),
        F.when(F.coalesce(F.col("reported_amount") == F.col("concluded"), F.lit(False)), "pass").otherwise("fail").alias("outcome"))


def lot_lineage(assessment) -> DataFrame:
    """VAL-03 per lot: class, shares, price used and whether it was borrowed, for every value that could be derived.

    Lots meet one price row per class, so the join is many to one and a holding of any size streams through it.
    """
    priced = assessment.relied.filter("requirement = 'R2' AND price_per_share IS NOT NULL")
    order = F.struct("issued_date", "claim_id")
    last = priced.groupBy(*KEY).agg(F.max_by(F.struct("price_per_share", "priced_class"), order).alias("last")).join(assessment.authorised, KEY)
    usable = per_class(held_classes(assessment), priced, assessment.authorised).filter("class_value IS NOT NULL").select(*KEY)
    lots = assessment.lots.filter("held").select(*KEY, "lot_id", "held_class", "held_shares").join(usable, KEY, "left_semi")
    rows = lots.join(class_prices(priced), [*KEY, "held_class"], "left").join(last.select(*KEY, "last"), KEY, "left")
    return rows.select(
        *KEY, "lot_id", "held_class", "held_shares", F.coalesce("own.price", "last.price_per_share").alias("price"),
        S.implied_cost(F.coalesce("own.price", "last.price_per_share"), F.col("held_shares")).cast(MONEY).alias("amount"),
        (F.col("own").isNull() & ~F.col("last.priced_class").eqNullSafe(F.col("held_class"))).alias("cross_class"))
