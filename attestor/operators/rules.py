"""The five evidence requests over all holdings and packet dates at once.

Claims are reduced to (holding, period, request, priced class) before anything else meets them, and lots to
(holding, period, class): the rules then compare classes, so no lot is ever paired with every claim of its holding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators import temporal
from attestor.sources.ledger import Ledger

KEY = ["holding_id", "period_id"]
NO_CODES = "array<string>"
#: What requests read of a claim; whatever else a claim frame holds is neither shuffled nor stored with it.
CLAIM = ("claim_id", "holding_id", "fund_id", "position_type", "document_no", "source_class", "execution_status", "issued_date", "received_date",
         "applicable_from", "applicable_to", "priced_class", "price_per_share", "supersedes_claim_id")


def codes(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns))


def any_bit(vocabulary: tuple[str, ...], conditions: dict[str, Column]) -> Column:
    """The bits of the codes whose condition holds."""
    out = F.lit(0).cast("bigint")
    for code, condition in conditions.items():
        out = out.bitwiseOR(F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << vocabulary.index(code)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def any_of(*bits: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for one in bits:
        out = out.bitwiseOR(F.coalesce(one, F.lit(0).cast("bigint")))
    return out


def matrix_cells(claims: DataFrame, strict: bool = False) -> DataFrame:
    """JN-07/JN-08: what a claim does for a request. An unlisted tuple has no verdict; strict raises on it.

    The price-less fallback replaces the cell when a claim states no price.
    """
    cells = F.broadcast(model.matrix(claims.sparkSession))
    joined = claims.join(cells, ["requirement", "source_class", "execution_status", "position_type"], "left")
    fallback = F.col("priceless_verdict").isNotNull() & F.col("price_per_share").isNull()
    listed = F.col("verdict")
    if strict:
        # Also where a reader asks for other columns only.
        joined = joined.filter(F.when(F.col("verdict").isNull() & ~fallback, F.raise_error(F.concat_ws(
            " ", F.lit("unlisted policy tuple:"), "requirement", "source_class", "execution_status", "position_type"))).otherwise(F.lit(True)))
        listed = F.when(F.col("verdict").isNull(), F.raise_error(F.concat_ws(
            " ", F.lit("unlisted policy tuple:"), "requirement", "source_class", "execution_status", "position_type"))).otherwise(F.col("verdict"))
    return (
        joined.withColumn("fallback", fallback)
        .withColumn("verdict", F.when(F.col("fallback"), F.col("priceless_verdict")).otherwise(listed))
        .withColumn("reason_code", F.when(F.col("fallback"), F.col("priceless_reason")).otherwise(F.col("reason_code")))
        .withColumn("next_action", F.when(F.col("fallback"), F.lit(model.PRICELESS_ACTION)).otherwise(F.col("next_action")))
        .drop("priceless_verdict", "priceless_reason")
    )


def unlisted_tuples(claims: DataFrame) -> DataFrame:
    """Audit twin of the fail-closed lookup: the tuples nobody has ruled on."""
    cells = matrix_cells(claims).filter("verdict IS NULL")
    return cells.groupBy("requirement", "source_class", "execution_status", "position_type").agg(F.count("*").alias("claims"))


def applicable_claims(ledger: Ledger, periods: DataFrame) -> DataFrame:
    """FLT-06: claims per request and packet date; R2 by reliance window, R1 and R4 by issue date."""
    each = ledger.claim.withColumn("requirement", F.explode("requirements"))
    when = F.when(F.col("requirement") == "R2", temporal.window_covers(F.col("period_date"))).otherwise(F.col("issued_date") <= F.col("period_date"))
    return each.join(periods.select("fund_id", "period_id", "period_date"), "fund_id").filter(when)


def supersede(applicable: DataFrame) -> DataFrame:
    """JN-10: a claim that another claim of the same applicable set names is dropped; only R2 supersedes."""
    naming = (
        applicable.filter("requirement = 'R2' AND supersedes_claim_id IS NOT NULL")
        .select("requirement", "period_id", F.col("supersedes_claim_id").alias("claim_id")).distinct()
    )
    return applicable.join(naming, ["requirement", "period_id", "claim_id"], "left_anti")


def struck_dates(claims: DataFrame, dated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """JN-10 before claims meet dates: the claims that others name, with the packet dates at which they are superseded, ``struck``.

    ``dated`` puts claims to the dates at which they apply. Only claims that name another are put to dates here, and a claim is
    a row once and not once a date; its list is no longer than there are dates.
    """
    naming = dated(claims.filter("supersedes_claim_id IS NOT NULL")).select(F.col("supersedes_claim_id").alias("claim_id"), "period_id")
    return naming.groupBy("claim_id").agg(F.collect_set("period_id").alias("struck"))


def not_struck(applicable: DataFrame) -> DataFrame:
    """The claims and dates of `struck_dates` that are left: those `supersede` leaves."""
    return applicable.filter(~F.coalesce(F.array_contains("struck", F.col("period_id")), F.lit(False))).drop("struck")


def figure_flags(facts: DataFrame, positive: dict[str, tuple[str, ...]], stated: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per claim: which groups of figures it states; a positive group needs a figure above zero."""
    wanted = [f for group in (*positive.values(), *stated.values()) for f in group]
    value = F.col("value_numeric")
    aggs = [F.bool_or(F.col("field_name").isin(*fields) & counts).alias(f"has_{code}")
            for figures, counts in ((positive, F.coalesce(value > 0, F.lit(False))), (stated, value.isNotNull())) for code, fields in figures.items()]
    return facts.filter(F.col("field_name").isin(*wanted)).groupBy("claim_id").agg(*aggs)


@dataclass(frozen=True)
class Assessment:
    """Frames of one assessment run.

    Lazy by default. With a ``store`` (a frame and a name in, the frame read back from where it was written out) the
    frames that everything else stands on are written once per run, so the claims are read once per request and not
    once per rule that looks at them.
    """

    ledger: Ledger
    resolutions: DataFrame | None = None  # (holding_id, priced_class) contradictions settled by a recorded decision
    strict: bool = True
    store: Callable[[DataFrame, str], DataFrame] | None = None
    _kept: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def keep(self, name: str, build: Callable[[], DataFrame], order: tuple[str, ...] = ()) -> DataFrame:
        """A frame of this run by name, built once and stored if the run has a store.

        Stored in ranges of the columns ``order``, so that what is added up by the first of them is combined before it is shuffled;
        the others part a value that fills many ranges.
        """
        if name not in self._kept:
            df = build()
            self._kept[name] = self.store(df.repartitionByRange(*order) if order else df, name) if self.store else df
        return self._kept[name]

    def with_claims(self, claim: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None) -> Assessment:
        """The same ledger with other claims; lots and members, which no claim has a part in, are those of this run."""
        other = replace(self, ledger=replace(self.ledger, claim=claim), store=store, _kept={})
        self.lots, self.members  # noqa: B018
        other._kept.update({name: self._kept[name] for name in ("lots", "members")})
        return other

    @cached_property
    def periods(self) -> DataFrame:
        return temporal.packet_sequence(self.ledger.period)

    @cached_property
    def lots(self) -> DataFrame:
        placed = self.keep("lots", lambda: temporal.placed_lots(self.ledger.lot, self.ledger.conversion, self.ledger.holding), ("holding_id", "lot_id"))
        return temporal.at_dates(placed, self.periods)

    def claims_for(self, code: str) -> DataFrame:
        """Claims that may answer a request, a row each; of R2 with the dates at which they are superseded (null: none)."""
        mine = self.ledger.claim.filter(F.array_contains("requirements", code))
        mine = mine.select(*[c for c in mine.columns if c in CLAIM])
        if code != "R2":
            return mine
        # Stored, so that Spark knows how few they are before it moves the claims.
        struck = self.keep("struck_R2", lambda: struck_dates(mine, lambda claims: self._dated(claims, code)))
        return self.keep("claims_R2", lambda: mine.join(struck, "claim_id", "left"), ("holding_id", "claim_id"))

    @property
    def figured(self) -> DataFrame:
        """Claims that may answer R1 or R4, a row each, with the groups of figures they state."""
        return self.keep("claims_figures", self._figured, ("holding_id", "claim_id"))

    def _figured(self) -> DataFrame:
        claims = self.ledger.claim.filter(F.arrays_overlap("requirements", F.array(F.lit("R1"), F.lit("R4"))))
        claims = claims.select("requirements", *[c for c in claims.columns if c in CLAIM])
        return claims.join(figure_flags(self.ledger.fact, model.R1_FIGURES, model.R4_FIGURES), "claim_id", "left")

    def _dated(self, claims: DataFrame, code: str) -> DataFrame:
        in_scope = temporal.window_covers(F.col("period_date")) if code == "R2" else F.col("issued_date") <= F.col("period_date")
        return claims.join(self.periods.select("fund_id", "period_id", "period_date"), "fund_id").filter(in_scope)

    def relied_for(self, code: str, told: DataFrame | None = None) -> DataFrame:
        """Claims of one request and date that are in scope, with their matrix cell; only R2 is superseded.

        The dates multiply the claims where they are read, from a row a claim, so these rows are neither stored nor shuffled.
        ``told`` (claim_id, ...), a row a claim at most, is joined before that.
        """
        claims = self.claims_for(code)
        return self._relied(claims if told is None else claims.join(told, "claim_id", "left"), code)

    def _relied(self, claims: DataFrame, code: str) -> DataFrame:
        scoped = self._dated(claims.withColumn("requirement", F.lit(code)), code)
        if code == "R2":
            scoped = not_struck(scoped)
        return matrix_cells(scoped, self.strict).withColumn("effective_date", S.effective_date(F.col("issued_date"), F.col("received_date")))

    def at_dates_relied(self, reduced: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All requests' claims at the dates `relied` has them, each with its matrix cell and ``reduced`` before the dates multiply it.

        ``reduced`` keeps the columns that dates are told by, and ``unlisted``: a tuple without a rule still stops a strict run only where
        such a claim is relied on.
        """
        out = None
        for code in ("R1", "R2", "R4"):
            cells = matrix_cells(self.claims_for(code).withColumn("requirement", F.lit(code))).withColumn("unlisted", F.when(F.col("verdict").isNull(), F.concat_ws(
                " ", F.lit("unlisted policy tuple:"), "requirement", "source_class", "execution_status", "position_type")))
            scoped = self._dated(reduced(cells), code)
            if code == "R2":
                scoped = not_struck(scoped)
            if self.strict:
                # Within a column: a filter would be moved below the dates and stop on claims that no date relies on.
                scoped = scoped.withColumn("period_id", F.when(F.col("unlisted").isNotNull(), F.raise_error(F.col("unlisted"))).otherwise(F.col("period_id")))
            out = scoped if out is None else out.unionByName(scoped)
        return out

    @cached_property
    def relied(self) -> DataFrame:
        """All requests in one frame; a filter on the request leaves only its branch in the plan."""
        return self.relied_for("R1").unionByName(self.relied_for("R2")).unionByName(self.relied_for("R4"))

    def by_class(self, code: str) -> DataFrame:
        """Claims of one request reduced to holding, period and priced class.

        The request is filtered first, so each claim is shuffled once per request it may answer and the facts
        are read only where figures decide.
        """
        return self.keep(f"classes_{code}", lambda: self._by_class(code))

    def _by_class(self, code: str) -> DataFrame:
        figures = {"R1": model.R1_FIGURES, "R4": model.R4_FIGURES}.get(code, {})
        claims = self._relied(self.figured.filter(F.array_contains("requirements", code)) if figures else self.claims_for(code), code)
        is_pro_forma = F.col("execution_status") == "pro_forma"
        is_executed = F.col("execution_status") == "executed"
        priced = F.when(F.col("priced_class").isNotNull(), F.col("price_per_share"))
        return claims.groupBy(*KEY, "priced_class").agg(
            F.count("*").alias("claims"),
            F.max(model.severity(F.col("verdict"))).alias("best"),
            F.bit_or(model.code_bit(F.col("reason_code"), model.REASON_CODES)).alias("reasons"),
            F.bit_or(model.code_bit(F.col("next_action"), model.ACTION_CODES)).alias("actions"),
            F.min(priced).alias("low_price"),
            F.max(priced).alias("high_price"),
            F.max(F.when(is_pro_forma, F.col("issued_date"))).alias("last_pro_forma"),
            F.max(F.when(is_executed, F.col("issued_date"))).alias("last_executed"),
            F.bool_or(F.col("effective_date") > F.col("period_date")).alias("subsequent"),
            *[F.coalesce(F.bool_or(f"has_{c}"), F.lit(False)).alias(f"has_{c}") for c in figures],
        )

    @cached_property
    def authorised(self) -> DataFrame:
        return self.ledger.policy_decision.select(*KEY).distinct().withColumn("authorised", F.lit(True))

    @cached_property
    def r1(self) -> DataFrame:
        """REQ-01: existence and cost, worst over the lots held during the year, best per lot."""
        groups = (
            self.lots.filter(temporal.held_during_year(F.col("period_date")))
            .groupBy(*KEY, "held_class", "security_class", F.col("shares").isNotNull().alias("has_shares"))
            .agg(F.count("*").alias("lots"))
        )
        return reduce_requirement(self.r1_groups(groups), "R1")

    def r1_groups(self, groups: DataFrame) -> DataFrame:
        mine = self.by_class("R1")
        names = ["best", "reasons", "actions", *[f"has_{c}" for c in model.R1_FIGURES]]
        exact = mine.filter("priced_class IS NOT NULL").select(*KEY, F.col("priced_class").alias("held_class"), *[F.col(n).alias(f"own_{n}") for n in names])
        free = mine.filter("priced_class IS NULL").select(*KEY, *[F.col(n).alias(f"free_{n}") for n in names])
        kind = F.col("kind")
        gap = self.ledger.gap.filter("requirement = 'R1' AND security_class IS NOT NULL").groupBy("holding_id", "security_class").agg(
            F.max(model.severity(S.gap_verdict(kind))).alias("gap_best"),
            F.bit_or(model.code_bit(S.gap_reason(kind), model.REASON_CODES)).alias("gap_reasons"),
            F.bit_or(model.code_bit(S.gap_action(kind), model.ACTION_CODES)).alias("gap_actions"))
        met = groups.join(exact, [*KEY, "held_class"], "left").join(free, KEY, "left").join(gap, ["holding_id", "security_class"], "left")
        found = F.greatest("own_best", "free_best", "gap_best")
        nothing = F.lit(None).cast("string")
        met = met.withColumn("none_found", found.isNull()).withColumn("found", F.coalesce(found, model.severity(S.gap_verdict(nothing))))
        states = lambda c: F.coalesce(F.col(f"own_has_{c}"), F.lit(False)) | F.coalesce(F.col(f"free_has_{c}"), F.lit(False))
        owed = {c: (F.lit(True) if c == "SETTLEMENT_OF_FUNDS_NOT_EVIDENCED" else F.col("has_shares")) for c in model.R1_FIGURES}
        sufficient = F.col("found") == model.SEVERITY.index("sufficient")
        met = met.withColumn("absent", any_bit(model.REASON_CODES, {c: sufficient & owed[c] & ~states(c) for c in model.R1_FIGURES}))
        capped = F.col("absent") != 0
        bare = {"NO_DOCUMENT_AND_NO_GAP_RECORDED": F.col("none_found")}
        return (
            met.withColumn("outcome", F.when(capped, model.SEVERITY.index("partial")).otherwise(F.col("found")))
            .withColumn("reasons", any_of(F.col("own_reasons"), F.col("free_reasons"), F.col("gap_reasons"), F.col("absent"), any_bit(model.REASON_CODES, bare)))
            .withColumn("next_actions", any_of(F.col("own_actions"), F.col("free_actions"), F.col("gap_actions"), any_bit(
                model.ACTION_CODES, {"REQUEST_FROM_COMPANY": F.col("none_found"), "REQUEST_ACQUISITION_FIGURES": capped})))
        )

    @cached_property
    def held_rows(self) -> DataFrame:
        """Classes held at each holding-date, one row each."""
        return self.lots.filter("held").groupBy(*KEY, "fund_id", "period_date", "held_class").agg(F.count("*").alias("lots"))

    @cached_property
    def held_keys(self) -> DataFrame:
        return self.held_rows.select(*KEY, "fund_id", "period_date").distinct()

    @cached_property
    def held_dates(self) -> DataFrame:
        """Holding-dates with a held lot, and the classes held."""
        return self.held_rows.groupBy(*KEY, "fund_id", "period_date").agg(F.collect_set("held_class").alias("held_classes"))

    @cached_property
    def r2_evidence(self) -> DataFrame:
        """R2 class groups beside the classes held, reduced to one row per holding-date.

        Held and priced classes are moved once, by holding-date, and meet as rows of one class, so set differences become flags
        and the second aggregate runs on plain columns. What counts depends on a recorded decision, so both readings are kept.
        """
        priced = self.by_class("R2").withColumn("class_key", F.col("priced_class")).withColumn("is_priced", F.lit(True))
        held = self.held_rows.select(*KEY, "period_date", F.col("held_class").alias("class_key"), F.lit(True).alias("is_held"))
        if self.resolutions is not None:
            settled = self.resolutions.select("holding_id", "priced_class").distinct().withColumn("settled", F.lit(True))
            priced = priced.join(settled, ["holding_id", "priced_class"], "left")
        else:
            priced = priced.withColumn("settled", F.lit(None).cast("boolean"))
        apart = F.col("is_priced").isNotNull() & (F.col("class_key").isNull() | F.col("holding_id").isNull() | F.col("period_id").isNull())  # nulls never meet
        both = held.unionByName(priced.drop("priced_class"), allowMissingColumns=True).repartition(*KEY)
        # No text is added up: an extreme of text makes Spark sort the rows of all dates.
        rows = both.groupBy(*KEY, "class_key", apart.alias("apart")).agg(
            *[F.max(c).alias(c) for c in ("period_date", "is_held", "is_priced", "settled", "best", "high_price", "last_pro_forma", "last_executed", "subsequent")],
            F.sum("claims").alias("claims"), F.bit_or("reasons").alias("reasons"), F.bit_or("actions").alias("actions"), F.min("low_price").alias("low_price"))
        rows = rows.withColumn("priced_class", F.when(F.col("is_priced").isNotNull(), F.col("class_key")))
        is_held, is_priced = F.col("is_held").isNotNull(), F.col("is_priced").isNotNull()
        off = F.col("priced_class").isNotNull() & ~is_held
        differs = F.col("priced_class").isNotNull() & (F.col("low_price") != F.col("high_price"))
        clash = differs & F.col("settled").isNull()
        some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
        out = rows.groupBy(*KEY).agg(
            F.max("period_date").alias("period_date"), some(is_held).alias("any_held"),
            F.coalesce(F.sum("claims"), F.lit(0)).alias("relied"),
            F.max("best").alias("best_all"), F.max(F.when(~off, F.col("best"))).alias("best_on"),
            F.bit_or("reasons").alias("reasons_all"), F.bit_or(F.when(~off, F.col("reasons"))).alias("reasons_on"),
            F.bit_or("actions").alias("actions_all"), F.bit_or(F.when(~off, F.col("actions"))).alias("actions_on"),
            some(is_priced & off).alias("any_off"), some(is_held & ~is_priced).alias("any_bare"), some(F.col("priced_class").isNotNull()).alias("any_class"),
            some(differs).alias("differing"), some(clash).alias("contradicted"), some(is_priced & F.col("priced_class").isNull()).alias("class_free"),
            F.max("last_pro_forma").alias("last_pro_forma"), F.max("last_executed").alias("last_executed"), some(F.col("subsequent")).alias("subsequent"))
        return out.filter("any_held")

    @cached_property
    def priced_sets(self) -> DataFrame:
        """Priced classes as a set beside the held ones, for the set queries."""
        priced = self.by_class("R2").groupBy(*KEY).agg(F.collect_set("priced_class").alias("priced_classes"), F.bool_or(F.col("priced_class").isNull()).alias("class_free"))
        return self.held_dates.join(priced, KEY)

    @cached_property
    def expired(self) -> DataFrame:
        """FLT-07: the first day after which some R2 support of the holding has closed."""
        closed = self.ledger.claim.filter(F.array_contains("requirements", "R2") & F.col("applicable_to").isNotNull())
        return closed.groupBy("holding_id").agg(F.min("applicable_to").alias("first_closed"))

    @cached_property
    def r2(self) -> DataFrame:
        """REQ-02: fair value support at each date a holding is held."""
        return self.keep("r2", self._r2)

    def _r2(self) -> DataFrame:
        first_gap = self.ledger.gap.filter("requirement = 'R2'").groupBy("holding_id").agg(F.min_by("kind", "gap_id").alias("gap_kind"))
        rows = (
            self.r2_evidence.join(self.authorised, KEY, "left").join(self.expired, "holding_id", "left").join(first_gap, "holding_id", "left")
            .withColumn("authorised", F.coalesce("authorised", F.lit(False)))
        )
        for name in ("best", "reasons", "actions"):
            rows = rows.withColumn(name, F.when(F.col("authorised"), F.col(f"{name}_all")).otherwise(F.col(f"{name}_on")))
        sufficient, partial, insufficient = (model.SEVERITY.index(v) for v in ("sufficient", "partial", "insufficient"))
        bare = F.col("relied") == 0
        was_closed = bare & F.coalesce(F.col("first_closed") < F.col("period_date"), F.lit(False))
        by_gap = bare & ~was_closed
        unheld_only = ~bare & F.col("best").isNull()
        start = (
            F.when(was_closed, model.SEVERITY.index("missing")).when(by_gap, model.severity(S.gap_verdict(F.col("gap_kind"))))
            .when(unheld_only, insufficient).otherwise(F.col("best"))
        )
        rows = rows.withColumn("start", start)
        capped = ~F.col("class_free") & F.col("any_bare") & (F.col("start") == sufficient)
        rows = rows.withColumn("capped", F.coalesce(capped, F.lit(False))).withColumn("cross", F.col("any_class") & (F.col("any_off") | F.col("any_bare")))
        after_cap = F.when(F.col("capped"), partial).otherwise(F.col("start"))
        undecided = F.col("cross") & ~F.col("authorised")
        final = F.when(undecided & (after_cap == sufficient), partial).otherwise(after_cap)
        absent = {f"NO_APPLICABLE_SUPPORT_{k.upper()}": by_gap & (F.coalesce("gap_kind", F.lit("none")) == k) for k, *_ in model.GAP_VERDICTS}
        reasons = any_of(F.col("reasons"), any_bit(model.REASON_CODES, {
            "OFF_CLASS_EVIDENCE_NOT_RELIED": F.col("any_off") & ~F.col("authorised"), "NO_SUPPORT_FOR_A_HELD_CLASS": unheld_only,
            "SUPPORT_OUTSIDE_ITS_OWN_RELIANCE_WINDOW": was_closed, **absent,
            "UNCOVERED_SECURITY_CLASS": F.col("capped"), "CROSS_CLASS_POLICY_DECISION_REQUIRED": undecided}))
        to_ask = {a: by_gap & (S.gap_action(F.col("gap_kind")) == a) for a in sorted({g[3] for g in model.GAP_VERDICTS})}
        actions = any_of(F.col("actions"), any_bit(model.ACTION_CODES, {
            "REQUEST_UPDATED_VALUATION": was_closed, **to_ask, "REQUEST_SUPPORT_FOR_CLASS": F.col("capped"), "RECORD_VALUATION_POLICY_DECISION": undecided}))
        reasons, actions = model.codes_of(reasons, model.REASON_CODES), model.codes_of(actions, model.ACTION_CODES)
        clash = F.col("contradicted")
        pro_forma = F.col("last_pro_forma").isNotNull() & ~F.coalesce(F.col("last_executed") >= F.col("last_pro_forma"), F.lit(False))
        return rows.select(
            *KEY, F.lit("R2").alias("requirement"),
            F.when(clash, "conflicting").otherwise(model.verdict_of(final)).alias("verdict"),
            F.when(clash, F.array(F.lit("CONTRADICTORY_CLAIMS"))).otherwise(reasons).alias("reasons"),
            F.when(clash, F.array(F.lit("RESOLVE_CONTRADICTION"))).otherwise(actions).alias("next_actions"),
            (~clash & F.col("cross")).alias("cross_class"),
            (~clash & F.coalesce(pro_forma, F.lit(False))).alias("pro_forma"),
            (~clash & F.coalesce("subsequent", F.lit(False))).alias("subsequent"),
        )

    @cached_property
    def unchanged(self) -> DataFrame:
        """Packet marks equal to the observation before them."""
        read = self.ledger.mark.select(*KEY, "period_date", "audit_scope", "revision", "reported_amount")
        marks = temporal.previous_mark(read).filter("audit_scope = 'packet'")
        return marks.select(*KEY, "period_date", "reported_amount", "previous_date", "previous_amount")

    @cached_property
    def stale(self) -> DataFrame:
        """Components without support in the twelve months before an unchanged mark; none at all is stale too."""
        dates = self.unchanged.filter("previous_amount = reported_amount").select(*KEY, "period_date", "previous_date")
        asked = dates.join(self.ledger.component.select("holding_id", "component"), "holding_id")
        supported = temporal.latest_support(self.ledger.support, dates.select(*KEY, "period_date"))
        old = F.col("latest_support").isNull() | (F.col("latest_support") < S.months_back(F.col("period_date"), 12))
        return asked.join(supported, [*KEY, "component"], "left").filter(old)

    @cached_property
    def r3(self) -> DataFrame:
        """REQ-03: an unchanged mark on stale support needs an approved assessment; notes say why it does not arise.

        A holding without any recorded component is refused: nothing could ever be stale there.
        """
        stale = self.stale.groupBy(*KEY).agg(F.count("*").alias("stale_components"))
        approved = (
            self.ledger.decision.filter("decision_type = 'management_assessment' AND status = 'approved'")
            .select(*KEY).distinct().withColumn("assessed", F.lit(True))
        )
        listed = self.ledger.component.select("holding_id").distinct().withColumn("listed", F.lit(True))
        rows = self.unchanged.join(stale, KEY, "left").join(approved, KEY, "left").join(listed, "holding_id", "left")
        refused = F.raise_error(F.concat(F.lit("no valuation components are recorded for holding "), "holding_id"))
        applies = F.coalesce(F.col("previous_amount") == F.col("reported_amount"), F.lit(False)) & F.col("stale_components").isNotNull()
        closed = F.coalesce("assessed", F.lit(False))
        empty = F.array().cast(NO_CODES)
        return rows.select(
            *KEY, F.lit("R3").alias("requirement"),
            F.when(F.col("listed").isNull(), refused).when(~applies, "not_applicable").when(closed, "sufficient").otherwise("missing").alias("verdict"),
            F.when(applies & ~closed, F.array(F.lit("MARK_UNCHANGED_WITH_STALE_SUPPORT"))).otherwise(empty).alias("reasons"),
            F.when(applies & ~closed, F.array(F.lit("DRAFT_MANAGEMENT_ASSESSMENT"))).otherwise(empty).alias("next_actions"),
            F.when(F.col("previous_amount").isNull(), "first mark on record")
            .when(F.col("previous_amount") != F.col("reported_amount"), F.concat(F.lit("another value than on "), F.col("previous_date").cast("string")))
            .when(F.col("stale_components").isNull(), "every component was supported in the last 12 months").alias("note"),
            F.coalesce("stale_components", F.lit(0)).alias("stale_components"),
        )

    @cached_property
    def realised_lots(self) -> DataFrame:
        return self.lots.filter(temporal.realised_between(F.col("previous_date"), F.col("period_date")))

    @cached_property
    def r4(self) -> DataFrame:
        """REQ-04: every lot realised since the previous packet date needs covering evidence and its figures."""
        groups = self.realised_lots.groupBy(*KEY, "security_class").agg(F.count("*").alias("lots"))
        mine = self.by_class("R4")
        names = ["best", *[f"has_{c}" for c in model.R4_FIGURES]]
        exact = mine.filter("priced_class IS NOT NULL").select(*KEY, F.col("priced_class").alias("security_class"), *[F.col(n).alias(f"own_{n}") for n in names])
        free = mine.filter("priced_class IS NULL").select(*KEY, *[F.col(n).alias(f"free_{n}") for n in names])
        met = groups.join(exact, [*KEY, "security_class"], "left").join(free, KEY, "left")
        missing, insufficient, partial, sufficient = range(4)
        found = F.coalesce(F.greatest("own_best", "free_best"), F.lit(missing))
        states = lambda c: F.coalesce(F.col(f"own_has_{c}"), F.lit(False)) | F.coalesce(F.col(f"free_has_{c}"), F.lit(False))
        absent = codes(*[F.when(~states(c), c) for c in model.R4_FIGURES])
        met = met.withColumn("found", found).withColumn("absent", F.when(F.col("found") == sufficient, absent).otherwise(F.array().cast(NO_CODES)))
        outcome = F.when(F.size("absent") == len(model.R4_FIGURES), insufficient).when(F.size("absent") > 0, partial).otherwise(F.col("found"))
        worst = met.withColumn("outcome", outcome).groupBy(*KEY).agg(
            F.min("outcome").alias("worst"), F.sum("lots").alias("realised_lots"),
            *[F.bool_or(F.array_contains("absent", c)).alias(f"lacks_{c}") for c in model.R4_FIGURES])
        short = F.col("worst") < sufficient
        lacking = [F.col(f"lacks_{c}") for c in model.R4_FIGURES]
        in_order = codes(F.when(short, "NO_REALIZATION_SUPPORT_FOR_LOT"), *[F.when(lacks, c) for lacks, c in zip(lacking, model.R4_FIGURES, strict=True)])
        actions = codes(F.when(short, "REQUEST_REALIZATION_SUPPORT"), F.when(lacking[0] | lacking[1] | lacking[2], "REQUEST_REALIZATION_FIGURES"))
        return worst.select(*KEY, F.lit("R4").alias("requirement"), model.verdict_of(F.col("worst")).alias("verdict"),
                            in_order.alias("reasons"), actions.alias("next_actions"), "realised_lots")

    @cached_property
    def r5(self) -> DataFrame:
        """REQ-05: the pro-forma label, derived from what R2 relied on."""
        empty = F.array().cast(NO_CODES)
        return self.r2.filter("pro_forma").select(*KEY, F.lit("R5").alias("requirement"), F.lit("sufficient").alias("verdict"),
                                                  empty.alias("reasons"), empty.alias("next_actions"))

    @cached_property
    def members(self) -> DataFrame:
        """PKT-01: held, realised since the previous packet date, or marked; a mark alone stands in for absent lots."""
        return self.keep("members", self._members)

    def _members(self) -> DataFrame:
        from_lots = self.lots.groupBy(*KEY, "fund_id", "period_date").agg(
            F.bool_or("held").alias("held"),
            F.bool_or(temporal.realised_between(F.col("previous_date"), F.col("period_date"))).alias("realised"))
        has_lots = self.ledger.lot.groupBy("holding_id").agg(F.lit(True).alias("has_lots"))
        marks = temporal.latest(
            self.ledger.mark.filter("audit_scope = 'packet'").select(*KEY, "fund_id", "period_date", "mark_id", "revision", "reported_amount", "reported_currency"),
            [*KEY, "fund_id", "period_date"], "revision")
        both = from_lots.join(marks, [*KEY, "fund_id", "period_date"], "full").join(has_lots, "holding_id", "left")
        by_mark = F.col("has_lots").isNull() & F.col("mark_id").isNotNull()
        return (
            both.withColumn("held", F.coalesce("held", F.lit(False)) | by_mark).withColumn("realised", F.coalesce("realised", F.lit(False)))
            .filter(F.col("held") | F.col("realised") | F.col("mark_id").isNotNull()).drop("has_lots")
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """REQ-06, long form: one row per member and request that arises."""
        flags = ["cross_class", "pro_forma", "subsequent"]
        base = [*KEY, "requirement", "verdict", "reasons", "next_actions"]
        # R5 is a label on R2, so it leaves the same row instead of computing R2 a second time.
        empty = F.array().cast(NO_CODES)
        own = F.struct("requirement", "verdict", "reasons", "next_actions", *flags)
        label = F.struct(F.lit("R5").alias("requirement"), F.lit("sufficient").alias("verdict"), empty.alias("reasons"), empty.alias("next_actions"),
                         *[F.lit(False).alias(f) for f in flags])
        two_and_five = self.r2.select(*KEY, F.explode(F.when(F.col("pro_forma"), F.array(own, label)).otherwise(F.array(own))).alias("o")).select(*KEY, "o.*")
        parts = [self.r1.select(*base), two_and_five, self.r3.select(*base, "note"), self.r4.select(*base)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    @cached_property
    def rows(self) -> DataFrame:
        """REQ-06/REQ-07: one row per packet member with its five verdicts, row verdict and support."""
        return self.keep("rows", self._rows)

    def _rows(self) -> DataFrame:
        verdict = lambda code: F.max(F.when(F.col("requirement") == code, F.col("verdict")))
        wide = self.outcomes.groupBy(*KEY).agg(
            *[verdict(code).alias(code.lower()) for code in model.REQUESTS],
            *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in ("cross_class", "pro_forma", "subsequent")])
        joined = self.members.join(wide, KEY, "left")
        for code in model.REQUESTS:
            joined = joined.withColumn(code.lower(), F.coalesce(code.lower(), F.lit("not_applicable")))
        for flag in ("cross_class", "pro_forma", "subsequent"):
            joined = joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
        return support(row_verdict(joined))


def reduce_requirement(groups: DataFrame, code: str) -> DataFrame:
    """Worst outcome over the groups of a holding-date, codes united."""
    return groups.groupBy(*KEY).agg(
        F.min("outcome").alias("worst"),
        F.bit_or("reasons").alias("reasons"), F.bit_or("next_actions").alias("next_actions"), F.sum("lots").alias("lots"),
    ).select(*KEY, F.lit(code).alias("requirement"), model.verdict_of(F.col("worst")).alias("verdict"),
             model.codes_of(F.col("reasons"), model.REASON_CODES).alias("reasons"), model.codes_of(F.col("next_actions"), model.ACTION_CODES).alias("next_actions"), "lots")


def row_verdict(rows: DataFrame) -> DataFrame:
    """AGG-09: conflicting dominates, what does not arise drops out, the worst of the rest remains."""
    cells = [F.col(c.lower()) for c in model.REQUESTS]
    lowest = F.array_min(F.array(*[model.severity(c) for c in cells]))
    conflicting = F.array_contains(F.array(*cells), "conflicting")
    applicable = F.filter(F.array(*cells), lambda v: v != "not_applicable")
    return (
        rows.withColumn("row_verdict", F.when(conflicting, "conflicting").when(lowest.isNull(), "not_applicable").otherwise(model.verdict_of(lowest)))
        .withColumn("applicable_count", F.size(applicable))
        .withColumn("sufficient_count", F.size(F.filter(F.array(*cells), lambda v: v == "sufficient")))
        .withColumn("fully_supported", (F.col("applicable_count") > 0) & (F.col("applicable_count") == F.col("sufficient_count")))
    )


def support(rows: DataFrame) -> DataFrame:
    """REQ-07: why a row is not supported, as a map from request to reason; empty means supported."""
    nothing = F.col("applicable_count") == 0
    entries = []
    for code in model.REQUESTS:
        verdict = F.col(code.lower())
        short = (verdict != "not_applicable") & (verdict != "sufficient")
        if code in model.ALWAYS_APPLICABLE:
            reason = F.when(F.col("held") & (verdict != "sufficient"), verdict).when(short, verdict)
        elif code == "R4":
            reason = F.when(~F.col("held") & nothing, F.lit("not assessed")).when(short, verdict)
        else:
            reason = F.when(short, verdict)
        entries.append(F.when(reason.isNotNull(), F.struct(F.lit(code).alias("key"), reason.alias("value"))))
    return (
        rows.withColumn("unsupported_reasons", F.map_from_entries(F.array_compact(F.array(*entries))))
        .withColumn("supported", F.size("unsupported_reasons") == 0)
    )


def links(assessment: Assessment) -> DataFrame:
    """Long form of what each request relied on: one row per claim, never an array per holding."""
    held = assessment.lots.filter(temporal.held_during_year(F.col("period_date"))).select(*KEY, F.col("held_class").alias("priced_class")).distinct()
    cols = [*KEY, "requirement", "claim_id", (F.col("effective_date") > F.col("period_date")).alias("is_subsequent")]
    r1 = assessment.relied.filter("requirement = 'R1'")
    covering = r1.filter("priced_class IS NOT NULL").join(held, [*KEY, "priced_class"], "left_semi").select(*cols)
    free = r1.filter("priced_class IS NULL").join(held.select(*KEY).distinct(), KEY, "left_semi").select(*cols)
    r2 = assessment.relied.filter("requirement = 'R2'").join(assessment.held_keys.select(*KEY), KEY, "left_semi").select(*cols)
    r4 = assessment.relied.filter("requirement = 'R4'").join(assessment.realised_lots.select(*KEY).distinct(), KEY, "left_semi").select(*cols)
    return covering.unionByName(free).unionByName(r2).unionByName(r4)


def best_and_worst(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-07: extremes on the local severity order; verdicts outside it never reduce."""
    ranked = verdicts.withColumn("ord", model.severity(F.col("verdict"))).filter("ord IS NOT NULL")
    out = ranked.groupBy(*keys).agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    return out.select(*keys, model.verdict_of(F.col("low")).alias("worst"), model.verdict_of(F.col("high")).alias("best"))


def reduce_links(groups: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-08: the best link decides unless prices of one class contradict each other."""
    clash = F.coalesce(F.bool_or(F.col("priced_class").isNotNull() & (F.col("low_price") != F.col("high_price"))), F.lit(False))
    out = groups.groupBy(*keys).agg(F.max("best").alias("best"), clash.alias("contradicted"))
    return out.select(*keys, F.when(F.col("contradicted"), "conflicting").otherwise(model.verdict_of(F.col("best"))).alias("verdict"))


def reduce_rows(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-09 over stored assessments: conflicting dominates, N/A drops out, the worst of the rest stays."""
    out = assessments.groupBy(*keys).agg(
        F.bool_or(F.col("verdict") == "conflicting").alias("conflicting"), F.min(model.severity(F.col("verdict"))).alias("low"))
    return out.select(*keys, F.when(F.col("conflicting"), "conflicting").when(F.col("low").isNull(), "not_applicable").otherwise(
        model.verdict_of(F.col("low"))).alias("verdict"))
