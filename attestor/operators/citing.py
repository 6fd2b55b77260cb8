"""Citations: locating quotes and patterns, pages, field requests, and the checks on stored facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S
from attestor.operators.extraction import Rule
from attestor.session import cut_lineage
from attestor.sources.publish import staged_copy


def locate(df: DataFrame, text: str, quote: str) -> DataFrame:
    """FN-14: the span of a quote; absent, ambiguous and empty quotes are states, not rows dropped."""
    hits = S.occurrences(F.col(text), F.col(quote))
    start = F.instr(F.col(text), F.col(quote)) - 1
    return (
        df.withColumn("hits", hits)
        .withColumn("state", F.when(F.length(quote) == 0, "empty_quote").when(F.col("hits") == 0, "absent")
                    .when(F.col("hits") > 1, "ambiguous").otherwise("found"))
        .withColumn("span_start", F.when(F.col("hits") == 1, start))
        .withColumn("span_end", F.col("span_start") + F.length(quote))
    )


def nth_start(text: Column, quote: Column, hits: Column, n: int) -> Column:
    """Start of the n-th hit (from 1) when the occurrence is named, else null."""
    before = F.length(text)
    rest = F.length(F.array_join(F.slice(F.split(text, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E")), n + 1), n + 1, 1), ""))
    return F.when(hits >= n, before - rest - F.length(quote))


def locate_pattern(df: DataFrame, text: str, pattern: str, group: int) -> DataFrame:
    """FN-15: a pattern must match exactly one passage; its span and one group are returned."""
    whole = F.regexp_substr(F.col(text), F.lit(pattern))
    return (
        df.withColumn("hits", F.regexp_count(F.col(text), F.lit(pattern)))
        .withColumn("value", F.when(F.col("hits") == 1, F.regexp_extract(text, pattern, group)))
        .withColumn("span_start", F.when(F.col("hits") == 1, F.instr(F.col(text), whole) - 1))
        .withColumn("span_end", F.when(F.col("hits") == 1, F.col("span_start") + F.length(whole)))
    )


def pages(documents: DataFrame) -> DataFrame:
    """FN-18: page extents from form feeds; a break at the very end opens no page, a blank page counts.

    Extents are summed within the row, so no text and no page body leaves it.
    """
    lengths = F.transform(F.split("canonical_text", "\f"), lambda body: F.length(body))
    opened = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page_start:int,page_end:int>>").alias("pages"))
    laid = F.aggregate(lengths, opened, lambda acc, n: F.struct(
        (acc["at"] + n + 1).alias("at"), F.array_append(acc["pages"], F.struct(acc["at"].alias("page_start"), (acc["at"] + n).alias("page_end"))).alias("pages")))["pages"]
    each = documents.select("document_id", F.size(F.split("canonical_text", "\f")).alias("parts"), F.posexplode(laid).alias("n", "page"))
    return each.filter("n + 1 < parts OR page.page_end > page.page_start").select("document_id", (F.col("n") + 1).alias("page_no"), "page.page_start", "page.page_end")


def page_of(points: DataFrame, page_frame: DataFrame, offset: str) -> DataFrame:
    """FN-19: the page holding an offset; null is the refusal of an offset outside every page."""
    p = page_frame.withColumnRenamed("document_id", "page_document")
    inside = (F.col("page_document") == F.col("document_id")) & (F.col("page_start") <= F.col(offset)) & (F.col(offset) < F.col("page_end"))
    return points.join(p, inside, "left").select(*points.columns, "page_no")


def with_requests(facts: DataFrame) -> DataFrame:
    """FN-29: the requests a field answers; an undeclared field is flagged, never guessed."""
    known = F.broadcast(model.field_requests(facts.sparkSession).withColumn("declared", F.lit(True)))
    return facts.join(known, "field_name", "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def answer_ranks(facts: DataFrame) -> DataFrame:
    """FN-30: position of a field among those leading a request; the rest tie behind them."""
    spark = facts.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(r, len(f)) for r, f in model.LEAD_FIELDS.items()], "requirement string, lead_count int"))
    each = with_requests(facts).withColumn("requirement", F.explode("requirements"))
    return (
        each.join(sizes, "requirement")
        .join(F.broadcast(model.lead_fields(spark)), ["requirement", "field_name"], "left")
        .withColumn("answer_rank", F.coalesce("lead_position", "lead_count"))
    )


def glossed(codes: DataFrame, column: str, glossary: tuple[tuple[str, str], ...]) -> DataFrame:
    """FN-32: a code nobody defined stays visible as one nobody defined."""
    known = F.broadcast(codes.sparkSession.createDataFrame(list(glossary), f"{column} string, meaning string"))
    return codes.join(known, column, "left").withColumn(
        "meaning", F.coalesce("meaning", F.lit("Nobody has said what this code means.")))


def bind_facts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """CIT-02: the three bindings of a stored fact, as an array of the ones it breaks."""
    stated = S.cited_numeral(F.col("value_text"))
    checks = F.array(
        F.when(~S.span_resolves(F.col("canonical_text"), F.col("quote"), F.col("span_start"), F.col("span_end")), "span_does_not_resolve"),
        F.when(~S.supports_value(F.col("quote"), F.col("value_text")), "value_not_in_quote"),
        F.when(~F.col("value_numeric").cast(S.NUMBER).eqNullSafe(stated), "number_is_not_the_stated_one"),
    )
    joined = facts.join(texts.select("claim_id", "canonical_text"), "claim_id")
    return joined.withColumn("violations", F.array_compact(checks)).drop("canonical_text")


def census(bound: DataFrame) -> DataFrame:
    """CIT-01: how many stored citations resolve, in one row."""
    broken = F.array_contains("violations", "span_does_not_resolve")
    return bound.agg(
        F.count("*").alias("citations"),
        F.count_if(~broken).alias("resolved"),
        F.count_if(broken).alias("failing"),
        F.countDistinct("claim_id").alias("claims"),
    )


def uncited_prices(claims: DataFrame, facts: DataFrame, column: str = "price_per_share") -> DataFrame:
    """CIT-03: claims whose own figure is no number any of their facts states."""
    stated = facts.filter("value_numeric IS NOT NULL").select("claim_id", F.col("value_numeric").cast("decimal(26,6)").alias("stated"))
    mine = claims.filter(F.col(column).isNotNull()).select("claim_id", F.col(column).cast("decimal(26,6)").alias("figure"))
    return mine.join(stated.withColumnRenamed("figure", "stated"),
                     (mine["claim_id"] == stated["claim_id"]) & (F.col("figure") == F.col("stated")), "left_anti")


def bind_proposals(proposals: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """CIT-07: proposals carry a quote and a value but no offset; both outcomes are kept."""
    placed = locate(proposals.join(texts, key), "canonical_text", "quote")
    return (
        placed.withColumn("refusal", F.when(F.col("state") == "empty_quote", "quote_is_empty").when(F.col("state") == "absent", "quote_not_found")
                          .when(F.col("state") == "ambiguous", "quote_is_ambiguous")
                          .when(~S.supports_value(F.col("quote"), F.col("value_text")), "quote_does_not_state_the_value"))
        .withColumn("accepted", F.col("refusal").isNull())
        .drop("canonical_text")
    )


def replay(proposals: DataFrame, recorded: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """CIT-15: recorded proposals bound to the stored text they were made on.

    ``recorded`` (key, prefix): the text's hash began so when the recording was made. Where no stored text of the key
    begins so any more, its proposals are kept, not replayed and without an outcome.
    """
    found = texts.select(key, F.sha2("canonical_text", 256).alias("_hash"), "canonical_text").join(recorded, key).filter(F.startswith("_hash", "prefix"))
    bound = bind_proposals(proposals, found.select(key, "canonical_text"), key).withColumn("replayed", F.lit(True))
    left = proposals.join(found.select(key).distinct(), key, "left_anti").withColumn("replayed", F.lit(False))
    return bound.unionByName(left, allowMissingColumns=True)


GRAM, WORDS = 6, 3


def sentence_for_fragment(fragments: DataFrame, documents: DataFrame, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """CIT-08: a fragment must fall in exactly one distinct sentence; an empty fragment falls in none.

    A fragment's words but its first and last are whole words of every sentence that holds it. Sentences are indexed by the hashes
    of their runs of ``words`` words, and a fragment is looked for where the rarest of its own runs stands. A fragment with
    fewer whole words is found by runs of ``gram`` characters, one shorter than that by itself; the index holds the kinds and
    lengths of runs that some fragment needs. Runs that no fragment asks for are dropped as soon as they are met, and texts are
    read again for candidates only.
    """
    slide = lambda column, n: F.regexp_extract_all(column, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    # ``of`` is a column that holds the words: an expression would be worked out anew for every run of a sentence.
    phrases = lambda of: F.transform(F.sequence(F.lit(0), F.size(of) - words), lambda i: F.xxhash64(F.lit(0), *[F.get(F.col(of), i + n) for n in range(words)]))
    whole = F.split("fragment", " ")
    inner = F.slice(whole, 2, F.greatest(F.size(whole) - 2, F.lit(0)))
    size = F.when(F.size(inner) >= words, F.lit(0)).otherwise(F.least(F.length("fragment"), F.lit(gram)))
    ids = staged_copy(fragments.select("fragment_id", "fragment"), "fragments")  # read once from the texts they may be cut from
    named = ids.filter(F.length("fragment") > 0).select("fragment").distinct().select("fragment", inner.alias("inner"), size.alias("size"))
    sizes = sorted(r["size"] for r in named.select("size").distinct().collect())  # 0 for words, and at most ``gram`` more
    none = F.array().cast("array<bigint>")

    def runs(column: str, n: int) -> Column:
        if n:
            return F.transform(slide(column, n), lambda r: F.xxhash64(F.lit(n), r))
        return F.when(F.size("words") >= words, phrases("words")).otherwise(none)

    lines = documents.select(F.explode(S.sentences(F.col("canonical_text"))).alias("sentence")).withColumn("at", F.xxhash64("sentence"))
    index = lines.withColumn("words", F.split("sentence", " ")).select("at", F.explode(F.flatten(F.array(*[runs("sentence", n) for n in sizes])) if sizes else none).alias("run"))
    own = F.when(F.col("size") == 0, phrases("inner"))
    for n in sizes:
        if n:
            own = own.when(F.col("size") == n, runs("fragment", n))
    asked = staged_copy(named.select("fragment", F.explode(F.array_distinct(own)).alias("run")), "fragment-runs")
    # Stored, so that Spark knows how few are asked for before it moves the runs of all sentences.
    met = cut_lineage(index.join(staged_copy(asked.select("run").distinct(), "asked-runs"), "run", "left_semi").distinct())
    frequency = met.groupBy("run").agg(F.count("*").alias("sentences_with"))
    anchors = asked.join(frequency, "run", "left").groupBy("fragment").agg(F.min(F.struct(F.coalesce("sentences_with", F.lit(0)).alias("sentences_with"), "run")).alias("rarest"))
    candidates = met.join(anchors.select("fragment", "rarest.run"), "run").select("fragment", "at")
    texts = lines.join(candidates.select("at").distinct(), "at", "left_semi").repartition("at").distinct()
    hit = candidates.join(texts, "at").filter(F.contains(F.col("sentence"), F.col("fragment")))
    # A sentence stands once in the texts, so hits are counted and not told apart by their text again.
    found = hit.groupBy("fragment").agg(F.count("*").alias("sentences"), F.min("at").alias("at"))
    only = found.filter("sentences = 1").join(texts, "at").filter(F.contains(F.col("sentence"), F.col("fragment"))).select("fragment", "sentence")
    by_id = ids.join(found.select("fragment", "sentences"), "fragment", "left").join(only, "fragment", "left").select(
        "fragment_id", *[F.when(F.col("fragment_id").isNotNull(), F.col(c)).alias(c) for c in ("sentences", "sentence")]).withColumn("sentences", F.coalesce("sentences", F.lit(0)))
    several = ids.filter(F.length("fragment") > 0).groupBy("fragment_id").agg(F.count_distinct("fragment").alias("fragments")).filter("fragments > 1").select("fragment_id")
    if several.isEmpty():
        return by_id
    # An id of several fragments has the sentences of all of them, each once.
    every = ids.join(several, "fragment_id").distinct().join(hit.select("fragment", "sentence"), "fragment", "left").groupBy("fragment_id").agg(
        F.count_distinct("sentence").alias("sentences"), F.min("sentence").alias("sentence"))
    return by_id.join(several, "fragment_id", "left_anti").unionByName(
        ids.select("fragment_id").join(every.withColumn("sentence", F.when(F.col("sentences") == 1, F.col("sentence"))), "fragment_id"))


def lineage(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """CIT-14: every leaf reachable from a figure, by path doubling.

    ``edges`` (figure_id, child_id), ``leaves`` (figure_id, leaf_id, state). Round k knows the leaf-bearing figures within 2^k steps
    and the ends of paths of exactly 2^k steps; both double, so depth 1,000 takes ten rounds. Paths of more steps than
    there are figures go round a cycle, which is raised, not truncated.
    """
    steps = cut_lineage(edges.select(F.col("figure_id").alias("start"), F.col("child_id").alias("end")).distinct())
    reached = leaves.select(F.col("figure_id").alias("figure"), F.col("figure_id").alias("node")).distinct()
    figures = steps.select("start").distinct().count()
    length = 1
    while not steps.isEmpty():
        if length > figures:
            raise ValueError("the figures do not form an acyclic graph")
        through = steps.join(reached, F.col("end") == F.col("figure")).select(F.col("start").alias("figure"), "node")
        reached = cut_lineage(reached.unionByName(through).distinct())
        onward = steps.select(F.col("start").alias("end"), F.col("end").alias("further"))
        steps = cut_lineage(steps.join(onward, "end").select("start", F.col("further").alias("end")).distinct())
        length *= 2
    return reached.withColumnRenamed("figure", "figure_id").join(leaves.withColumnRenamed("figure_id", "node"), "node")


def fact_map(facts: DataFrame) -> DataFrame:
    """AGG-10: numeric facts folded to one map per claim; a field with two values is flagged, not silently picked."""
    one = facts.filter("value_numeric IS NOT NULL").groupBy("claim_id", "field_name").agg(
        F.countDistinct("value_numeric").alias("values"), F.max("value_numeric").alias("value"))
    return one.groupBy("claim_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("facts"), (F.max("values") > 1).alias("ambiguous"))


DATE_FIELDS = ("fx_rate_effective_date",)
TEXT_FIELDS = ("currency_pair",)


def dated_facts(facts: DataFrame) -> DataFrame:
    """AGG-11: date and text facts by allow-list; a date that does not read is counted, never dropped."""
    day = F.col("value_text").try_cast("date")
    wanted = facts.filter(F.col("field_name").isin(*DATE_FIELDS, *TEXT_FIELDS))
    return wanted.groupBy("claim_id").agg(
        *[F.max(F.when(F.col("field_name") == f, day)).alias(f) for f in DATE_FIELDS],
        *[F.max(F.when(F.col("field_name") == f, F.col("value_text"))).alias(f) for f in TEXT_FIELDS],
        F.count_if(F.col("field_name").isin(*DATE_FIELDS) & day.isNull()).alias("unreadable"))


# One line a fact, "field is value", as the recordings of this ledger write it. Other houses state their own rules.
def line_rules(family: str, fields: tuple[str, ...]) -> tuple[Rule, ...]:
    value = {"currency_pair": r"([A-Z]{3}/[A-Z]{3})", "fx_rate_effective_date": r"(\d{4}-\d{2}-\d{2})"}
    return tuple(Rule(family, f, rf"(?m)^{f.replace('_', ' ')} is {value.get(f, r'([0-9]+(?:[.][0-9]+)?)')}$", ((f, 1),)) for f in fields)


PURCHASE_AGREEMENT = line_rules("purchase_agreement", (
    "fund_shares", "fund_price_per_share", "settlement_amount_received", "gross_consideration", "consideration_per_share", "shares_of_record"))
CAP_TABLE = line_rules("cap_table", ("fund_shares", "fund_price_per_share"))
MEMO = line_rules("memo", ("concluded_fair_value_usd", "net_asset_value", "fund_holding_value", "fx_rate", "fx_rate_effective_date", "currency_pair"))
IRREGULAR = line_rules("irregular", ("fund_shares", "settlement_amount_received", "fund_price_per_share"))
TERM_SHEET = line_rules("term_sheet", ("fund_shares", "fund_price_per_share", "settlement_amount_received"))
FAMILIES = {"purchase_agreement": PURCHASE_AGREEMENT, "cap_table": CAP_TABLE, "memo": MEMO, "irregular": IRREGULAR, "term_sheet": TERM_SHEET}


def rules_of(*families: str) -> tuple[Rule, ...]:
    return tuple(r for f in (families or FAMILIES) for r in FAMILIES[f])


def family_of() -> Column:
    """Document family of a claim, from the pair that also decides its authority."""
    source, status = F.col("source_class"), F.col("execution_status")
    return (
        F.when(source == "executed_transaction_doc", "purchase_agreement").when(source == "company_cap_table", "cap_table")
        .when(source.isin("third_party_valuation_memo", "administrator_statement", "fund_internal_record"), "memo")
        .when(status == "non_binding", "term_sheet").otherwise("irregular"))


def claims_of_document(extracted: DataFrame, documents: DataFrame, observations: DataFrame) -> DataFrame:
    """CIT-05: one document gives several claims when authority, date or class differ.

    The base claim always; a settlement clause is a price-less claim of its own; a quote record gives one claim for
    each observation it states (``observations``: claim_id, observed_on, price_per_share), closing on that day.
    """
    base = documents.select("claim_id", "family", "issued_date", "applicable_to", "price_per_share")
    settled = extracted.filter("field_name = 'settlement_amount_received' AND outcome = 'cited'").select("claim_id").distinct()
    shape = ["claim_id", "claim_key", "issued_date", "closes", "price_per_share"]
    main = base.withColumn("claim_key", F.col("family")).withColumn("closes", F.col("applicable_to"))
    clause = base.join(settled, "claim_id", "left_semi").withColumn("claim_key", F.lit("settlement")).withColumn(
        "closes", F.col("applicable_to")).withColumn("price_per_share", F.lit(None).cast("decimal(18,6)"))
    stated = observations.select("claim_id", F.col("observed_on").alias("closes"), "price_per_share")
    quotes = base.filter("family = 'quote'").drop("price_per_share").join(stated, "claim_id").withColumn("claim_key", F.concat(F.lit("quote_"), F.col("closes").cast("string")))
    return main.filter("family <> 'quote'").select(*shape).unionByName(clause.select(*shape)).unionByName(quotes.select(*shape))


def declared_against_cited(claims: DataFrame, facts: DataFrame, declared: str, field_name: str) -> DataFrame:
    """CIT-06: a declared figure must be the cited one; both sides shown, agreement null when nothing is cited."""
    cited = facts.filter(F.col("field_name") == field_name).select("claim_id", F.col("value_numeric").alias("cited"))
    joined = claims.filter(F.col(declared).isNotNull()).select("claim_id", F.col(declared).cast("decimal(26,6)").alias("declared")).join(cited, "claim_id", "left")
    return joined.withColumn("agrees", F.col("declared") == F.col("cited"))


def wrong_passages(cited: DataFrame, manifest: DataFrame) -> DataFrame:
    """CIT-11: cited facts against a manifest made without the extractor: value, passage, distractor, absence.

    ``manifest`` (claim_id, field_name, expected, passage, distractor, absent).
    """
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    joined = manifest.join(cited.select("claim_id", "field_name", "value_text", "quote"), ["claim_id", "field_name"], "full")
    return joined.withColumn("problem", F.when(F.col("expected").isNull() & F.col("absent").isNull(), "not_in_manifest")
                             .when(F.coalesce("absent", F.lit(False)) & F.col("quote").isNotNull(), "stated_absent_but_cited")
                             .when(F.coalesce("absent", F.lit(False)), None)
                             .when(F.col("quote").isNull(), "expected_but_not_cited").when(F.col("value_text") != F.col("expected"), "value_differs")
                             .when(F.col("distractor").isNotNull() & F.contains(flat("quote"), flat("distractor")), "distractor_cited")
                             .when(~F.contains(flat("passage"), flat("quote")), "outside_the_passage"))


def promotion_violations(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """CIT-13: approved facts need an approved transcription; candidates must not carry one."""
    by = decisions.select(F.col("decision_id").alias("promoted_by"), "decision_type", "status")
    joined = facts.join(by, "promoted_by", "left")
    lawful = F.coalesce((F.col("decision_type") == "transcription") & (F.col("status") == "approved"), F.lit(False))
    rule = F.when((F.col("state") == "approved") & F.col("promoted_by").isNull(), "approved_without_a_decision").when(
        (F.col("state") == "approved") & ~lawful, "promoted_by_another_decision").when(
        (F.col("state") == "candidate") & F.col("promoted_by").isNotNull(), "candidate_carries_a_promotion")
    return joined.withColumn("rule", rule).filter("rule IS NOT NULL")


def spelled_dates(day: Column) -> tuple[Column, Column]:
    """CIT-22: the two spellings a document may use for a day."""
    return F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "MM/dd/yyyy")


def states_day(text: Column, day: Column) -> Column:
    long, short = spelled_dates(day)
    return F.contains(text, long) | F.contains(text, short)
