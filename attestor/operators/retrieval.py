"""Passage retrieval for many cases at once, and its measurement against the ledger's own reliance."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor import model
from attestor.operators import temporal
from attestor.sources.ledger import Ledger


def candidate_claims(claims: DataFrame, holding_id: str | None = None, on: datetime.date | None = None,
                     requirement: str | None = None, source_classes: tuple[str, ...] | None = None) -> DataFrame:
    """FLT-11: optional metadata filters; one that is not asked for never reaches the plan."""
    out = claims
    if holding_id is not None:
        out = out.filter(F.col("holding_id") == holding_id)
    if on is not None:
        out = out.filter(temporal.window_covers(F.lit(on)))
    if source_classes is not None:
        out = out.filter(F.col("source_class").isin(*source_classes))
    if requirement is not None:
        out = out.filter(F.array_contains("requirements", requirement))
    return out


def claims_in_window(ledger: Ledger) -> DataFrame:
    """JN-02: claims per evidence-bearing request and packet period inside their reliance window."""
    each = ledger.claim.withColumn("requirement", F.explode("requirements"))
    return each.join(ledger.packet_period.select("fund_id", "period_id", "period_date"), "fund_id").filter(temporal.window_covers(F.col("period_date")))

# --- fixed values -----------------------------------------------------------------------------
QUERIES = {
    "R1": "executed stock purchase agreement shares purchased price per share capital account balance",
    "R2": "price per share post-money valuation closing price net asset value fair value",
    "R4": "merger consideration per share paid at closing realization proceeds",
}
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with", "per",
)
# --- end of fixed values ----------------------------------------------------------------------
WORD = r"([0-9A-Za-z][0-9A-Za-z'’-]*)"
SUFFIX = "(ings|ing|edly|ed|es|s|ly)$"


def stem(word: Column) -> Column:
    """Light suffix stripping; a word of five letters or fewer stays whole."""
    return F.when(F.length(word) > 5, F.regexp_replace(word, SUFFIX, "")).otherwise(word)


def query_terms(queries: DataFrame) -> DataFrame:
    """RET-01/RET-08: distinct stemmed terms of each query; a query of stop words only has none and says so.

    ``queries`` (requirement, query) is a handful of rows.
    """
    words = F.transform(F.regexp_extract_all(F.lower("query"), F.lit(WORD), F.lit(1)), lambda w: F.regexp_replace(w, "['’-]+$", ""))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    terms = F.array_sort(F.array_distinct(F.transform(kept, stem)))
    return queries.withColumn("terms", terms).withColumn("refusal", F.when(F.size("terms") == 0, "query_has_no_search_terms"))


INDEX_SLOTS = 64


@dataclass(frozen=True)
class Index:
    """A stored inverted index: which words stand on which line of which document.

    ``postings`` (slot, word, document_no, document_id, line_no, n) lie in order of word and document, cut into slots of about
    equal size, so a word with very many documents lies in several. ``dictionary`` (word, slot, documents) is their table of
    contents, in order of word.
    """

    postings: DataFrame
    dictionary: DataFrame


POSTING = "word string, document_no bigint, document_id string, line_no int, n bigint, slot int"
ENTRY = "word string, slot int, documents bigint, head string"


def build_index(documents: DataFrame, path: str, slots: int = INDEX_SLOTS) -> None:
    """Read every text once and write its index below ``path``."""
    lines = documents.select("document_no", "document_id", F.posexplode(F.split("canonical_text", "\n")).alias("line_no", "line"))
    words = lines.select(F.col("document_no").cast("bigint").alias("document_no"), "document_id", "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(1))).alias("word"))
    counted = words.groupBy("word", "document_no", "document_id", "line_no").agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(slots, "word", "document_no", "line_no").withColumn("slot", F.spark_partition_id())
    dealt.sortWithinPartitions("slot", "word", "document_no", "line_no").write.partitionBy("slot").parquet(f"{path}/postings")
    stored = open_index(documents.sparkSession, path).postings
    entries = stored.groupBy("word", "slot").agg(F.countDistinct("document_no").alias("documents")).withColumn("head", F.substring("word", 1, 1))
    entries.repartitionByRange("head", "word").sortWithinPartitions("head", "word").write.partitionBy("head").parquet(f"{path}/dictionary")


def open_index(spark: SparkSession, path: str) -> Index:
    dictionary = spark.read.schema(ENTRY).parquet(f"{path}/dictionary") if _has(spark, f"{path}/dictionary") else spark.createDataFrame([], ENTRY)
    return Index(spark.read.schema(POSTING).parquet(f"{path}/postings"), dictionary)


def _has(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("word string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def words_of_terms(index: Index, terms: DataFrame) -> DataFrame:
    """The dictionary's words that start with a term, and their slots; only parts of the dictionary with a term's first letter are read."""
    heads = [r[0] for r in terms.select(F.substring("term", 1, 1)).distinct().collect()]
    entries = index.dictionary.filter(F.col("head").isin(heads)).select("word", "slot", "head")
    return entries.join(terms.withColumn("head", F.substring("term", 1, 1)), "head").filter(F.startswith("word", "term")).drop("head")


def hits(index: Index, queries: DataFrame, key: str = "requirement") -> DataFrame:
    """RET-01: key, document, line, term and how often the term stands there; a word hits a term when it starts with it.

    No text is read: of the postings, only the slots that hold a word of the queries.
    """
    terms = query_terms(queries).filter("refusal IS NULL").select(key, F.explode("terms").alias("term"))
    wanted = words_of_terms(index, terms)
    slots = [r[0] for r in wanted.select("slot").distinct().collect()]
    found = index.postings.filter(F.col("slot").isin(slots)).join(wanted, ["slot", "word"])
    return found.groupBy(key, "document_no", "document_id", "line_no", "term").agg(F.sum("n").alias("n"))


def matched_documents(index: Index, queries: DataFrame, key: str = "requirement") -> DataFrame:
    """RET-01/02/04: per document and query the text rank and the best line.

    Rank = sum over terms of 1/1 + 1/4 + ... + 1/tf^2.
    """
    hit = hits(index, queries, key)
    query = ["document_no", "document_id", key]
    weight = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("tf")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / (i * i))
    rank = hit.groupBy(*query, "term").agg(F.sum("n").alias("tf")).groupBy(*query).agg(F.sum(weight).cast("decimal(18,6)").alias("text_rank"))
    # At most one row per term of a query here, so the list of a line's terms is as short as the query.
    by_line = hit.groupBy(*query, "line_no").agg(F.array_sort(F.collect_list("term")).alias("matched"))
    best = by_line.groupBy(*query).agg(F.max_by(F.struct("line_no", "matched"), F.struct(F.size("matched"), -F.col("line_no"))).alias("best"))
    return rank.join(best, query).select(*query, "text_rank", "best.line_no", "best.matched", F.size("best.matched").alias("line_terms"))


def passages(matched: DataFrame, documents: DataFrame, key: str = "requirement") -> DataFrame:
    """RET-04/05/06: the best line as a citation: trimmed, windowed to whole words when long, located, paged.

    Texts are read here, and only those of the rows at hand; a best line has a word, so no row is lost.
    """
    matched = documents.select("document_no", "canonical_text").join(matched, "document_no")
    before = F.when(F.col("line_no") > 0, F.length(F.expr("substring_index(canonical_text, '\n', line_no)")) + 1).otherwise(0)
    line = F.get(F.split("canonical_text", "\n"), F.col("line_no"))
    out = matched.withColumn("line", line).withColumn("line_start", before)
    lead = F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    out = out.withColumn("low", F.col("line_start") + lead).withColumn("body", F.regexp_replace(F.regexp_replace("line", r"^\s+", ""), r"\s+$", ""))
    # A word begins after anything but a letter or digit; marks before it belong to it only if no word precedes them,
    # however many they are.
    anywhere = F.concat(F.lit(r"(?:^|[^0-9a-z'’-])['’-]*(?:"), F.array_join("matched", "|"), F.lit(")"))
    half = model.PASSAGE_CHARS // 2
    long = F.length("body") > model.PASSAGE_CHARS
    hit = F.regexp_substr(F.lower("body"), anywhere)
    before = F.length(hit) - F.length(F.regexp_replace(hit, r"^[^0-9a-z'’-]?['’-]*", ""))
    first = F.regexp_instr(F.lower("body"), anywhere) - 1 + F.coalesce(before, F.lit(0))
    out = out.withColumn("first_hit", first)
    cut = F.greatest(F.lit(0), F.col("first_hit") - half)
    stop = F.least(F.length("body"), cut + model.PASSAGE_CHARS)
    out = out.withColumn("cut", cut).withColumn("stop", stop)
    head = F.length(F.regexp_replace(F.expr("substring(body, 1, cut)"), r"\S+$", ""))
    tail = F.col("stop") + F.length(F.regexp_extract(F.expr("substring(body, stop + 1)"), r"^(\S*)", 1))
    out = out.withColumn("head", F.when(long, head).otherwise(0)).withColumn("tail", F.when(long, tail).otherwise(F.length("body")))
    window = F.expr("substring(body, head + 1, tail - head)")
    out = out.withColumn("window", window).withColumn("lead", F.length("window") - F.length(F.regexp_replace("window", r"^\s+", "")))
    quote = F.regexp_replace(F.regexp_replace("window", r"^\s+", ""), r"\s+$", "")
    out = out.withColumn("quote", quote).withColumn("span_start", (F.col("low") + F.col("head") + F.col("lead")).cast("int"))
    out = out.withColumn("span_end", F.col("span_start") + F.length("quote"))
    page = F.length(F.expr("substring(canonical_text, 1, span_start)")) - F.length(F.replace(F.expr("substring(canonical_text, 1, span_start)"), F.lit("\f"), F.lit(""))) + 1
    earlier = F.expr("substring(canonical_text, 1, span_end - 1)")
    occurrence = F.when(F.length("quote") > 0, ((F.length(earlier) - F.length(F.replace(earlier, F.col("quote"), F.lit("")))) / F.length("quote")).cast("int"))
    return out.withColumn("page", page.cast("int")).withColumn("occurrence", occurrence).select(
        "document_no", "document_id", key, "text_rank", "line_no", "matched", "span_start", "span_end", "quote", "page", "occurrence")


def gold_cases(ledger: Ledger, dealt: tuple[str, ...] = ()) -> DataFrame:
    """RET-09: cases and their relevant documents, read out of the ledger's own reliance and windows.

    ``dealt``: the columns by which they meet something else, so that they are moved to it once and told apart there.
    """
    cases = claims_in_window(ledger).select("holding_id", "requirement", "period_id", "period_date", "document_no")
    return (cases.repartition(*dealt) if dealt else cases).distinct()


def ranked(ledger: Ledger, found: DataFrame, entity_scoped: bool = True, apply_window: bool = True, k: int = model.TOP_K) -> DataFrame:
    """RET-03/RET-07/WIN-10: top k documents of every gold case by the declared lexicographic key, one per claim.

    ``found`` is what `matched_documents` gives. A document has one passage for a request, so the place of the passage decides
    nothing and only winners need be quoted (`quoted`). A claim meets the documents found before any case meets it, so what is
    shuffled is a row a claim and request, never one a case; all dates of a holding and request are then ranked where they were joined.
    """
    cases = claims_in_window(ledger).select("holding_id", "requirement", "period_id", "period_date").distinct()
    claims = ledger.claim.select("claim_id", F.col("holding_id").alias("claim_holding"), "fund_id", "document_no", "source_class", "execution_status", "issued_date", "applicable_from", "applicable_to")
    preferred = F.broadcast(model.preference(ledger.claim.sparkSession))
    answering = claims.join(found, "document_no").join(preferred, ["source_class", "execution_status"], "left")
    if entity_scoped:
        hit = cases.join(answering.withColumn("holding_id", F.col("claim_holding")), ["holding_id", "requirement"])
        case = ["holding_id", "requirement", "period_id"]
    else:
        # One row per request and packet date: a fixed handful that every claim is tested against.
        hit = answering.join(cases.select("requirement", "period_date").distinct(), "requirement")
        case = ["requirement", "period_date"]
    if apply_window:
        hit = hit.filter(temporal.window_covers(F.col("period_date")))
    by_key = Window.partitionBy(*case).orderBy(
        F.coalesce("preference", F.lit(len(model.PREFERENCE))), F.abs(F.datediff("period_date", "issued_date")), F.desc("text_rank"), "document_id", "claim_id")
    return hit.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= k)


def quoted(top: DataFrame, documents: DataFrame, key: str = "requirement") -> DataFrame:
    """The winners with their passages; each document and request is cut once, however many cases it wins."""
    columns = ["document_no", "document_id", key, "text_rank", "line_no", "matched"]
    cut = passages(top.select(*columns).distinct(), documents, key).drop("document_id", "text_rank", "line_no", "matched")
    return top.join(cut, ["document_no", key])


def recall_per_case(ledger: Ledger, top: DataFrame, case: list[str]) -> DataFrame:
    """SET-07: per case how many relevant documents were found, how many there are, and how many were retrieved."""
    relevant = gold_cases(ledger, (*case, "document_no"))
    got = top.groupBy(*case, "document_no").agg(F.min("place").alias("place"))
    counts = got.groupBy(*case).agg(F.count("*").alias("retrieved"))
    both = relevant.join(got, [*case, "document_no"], "left").groupBy("holding_id", "requirement", "period_id").agg(
        F.count("*").alias("relevant"), F.count("place").alias("found"), F.min("place").alias("best_place"))
    if set(case) != {"holding_id", "requirement", "period_id"}:
        both = both.join(claims_in_window(ledger).select("holding_id", "requirement", "period_id", "period_date").distinct(), ["holding_id", "requirement", "period_id"])
    return both.join(counts, case, "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))


def recall(cases: DataFrame) -> DataFrame:
    """RET-10/WIN-14: recall at 1, 3 and 5 from one ranking, cases fully covered, candidates in total."""
    return cases.agg(
        F.count("*").alias("cases"), *[F.count_if(F.col("best_place") <= k).alias(f"any_at_{k}") for k in (1, 3, 5)],
        F.count_if(F.col("found") == F.col("relevant")).alias("all_relevant"), F.sum("retrieved").alias("candidates"))


def search(ledger: Ledger, index: Index, documents: DataFrame, requests: DataFrame, k: int = model.TOP_K) -> tuple[DataFrame, DataFrame]:
    """RET-12: passages for any number of requests, and what became of each request.

    ``requests``: request_id, holding_id, period_date, requirement, query. An outcome is `unknown_holding` (no claim names it),
    `query_has_no_search_terms`, `none_matched` or `found`: an empty answer never stands for a question that was not asked.
    Passages come from documents of the holding's claims that answer the requirement in their window, k a request.
    """
    # Requests that ask the same words share one look-up.
    asked = requests.select("query").distinct()
    terms = query_terms(requests).select("request_id", "refusal")
    each = ledger.claim.select(
        "claim_id", "holding_id", "document_no", "source_class", "execution_status", "issued_date", "applicable_from", "applicable_to", F.explode("requirements").alias("requirement"))
    met = requests.join(each, ["holding_id", "requirement"]).filter(temporal.window_covers(F.col("period_date")))
    found = matched_documents(index, asked, "query")
    preferred = F.broadcast(model.preference(ledger.claim.sparkSession))
    hit = met.join(found, ["document_no", "query"]).join(preferred, ["source_class", "execution_status"], "left")
    by_key = Window.partitionBy("request_id").orderBy(
        F.coalesce("preference", F.lit(len(model.PREFERENCE))), F.abs(F.datediff("period_date", "issued_date")), F.desc("text_rank"), "document_id", "claim_id")
    top = hit.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= k)
    known = ledger.claim.select("holding_id").distinct().withColumn("known", F.lit(True))
    counted = top.groupBy("request_id").agg(F.count("*").alias("passages"))
    told = requests.select("request_id", "holding_id").join(known, "holding_id", "left").join(terms, "request_id").join(counted, "request_id", "left")
    outcome = F.when(F.col("known").isNull(), "unknown_holding").when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("passages").isNull(), "none_matched").otherwise("found")
    return told.select("request_id", outcome.alias("outcome"), F.coalesce("passages", F.lit(0)).alias("passages")), quoted(top, documents, "query")
