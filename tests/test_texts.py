"""Rules, fragments, pages and the stored index against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestor.operators import citing, extraction, retrieval
from attestor.operators.extraction import Rule

FACT = ("rule", "field_name", "claim_key", "hits", "outcome", "value_text", "span_start", "span_end")
ROW = r"(?m)^(\S[^\t\n]*?)(?: {2,}|\t)([0-9,]+)(?: {2,}|\t)\$([0-9.]+)$"


def facts(spark, texts, rules, **columns):
    rows = [(k, family, text, *[columns[c].get(k) for c in columns]) for k, family, text in texts]
    df = spark.createDataFrame(rows, "claim_id string, family string, canonical_text string" + "".join(f", {c} string" for c in columns))
    return {(r["claim_id"], r["field_name"], r["claim_key"]): r for r in extraction.extract(df, rules).collect()}


def test_groups_parameters_and_spans(spark):
    rule = Rule("schedule", "row", ROW, (("shares", 2), ("price", 3)), where=((1, "purchaser"),))
    text = "Name  Shares  Price\nB Fund  5  $9.00\nA  Fund  1,200\t$1.50\nsee A Fund  7  $2\nTOTAL  1,205  $0\n"
    texts = [("once", "schedule", text), ("twice", "schedule", text + "A Fund  3  $4.00\n"), ("none", "schedule", "nothing"), ("null", "schedule", None), ("other", "letter", text)]
    got = facts(spark, texts, (rule,), purchaser={k: "A Fund" for k, _, _ in texts})
    assert {k[0] for k in got} == {"once", "twice", "none", "null"}
    one = got["once", "shares", None]
    assert (one.value_text, one.outcome, one.hits) == ("1,200", "cited", 1) and got["once", "price", None].value_text == "1.50"
    assert text[one.span_start : one.span_end] == one.quote == "A  Fund  1,200\t$1.50"
    assert got["twice", "price", None].outcome == "pattern_is_ambiguous" and got["twice", "price", None].hits == 2 and got["twice", "price", None].quote is None
    assert got["none", "shares", None].outcome == "pattern_matched_nothing"


def test_a_match_is_placed_where_it_matched_and_not_where_its_words_stand_first(spark):
    text = "not x: 5 here\nx: 5\n"
    got = facts(spark, [("d", "f", text)], (Rule("f", "x", r"(?m)^x: ([0-9])$", (("x", 1),)),))["d", "x", None]
    assert got.span_start == text.index("\nx") + 1


def test_several_claims_of_one_document(spark):
    rule = Rule("letter", "value", r"value\s+at\s+([0-9]{4}):\s+([0-9]+)", (("value", 2),), claim_group=1)
    optional = Rule("letter", "basis", r"basis ([a-z]+)", (("basis", 1),), required=False)
    got = facts(spark, [("d", "letter", "value at 1999: 5 value\nat 2000: 6, value at 2001: 7; value at 2001: 8"), ("e", "letter", "")], (rule, optional))
    assert {(k, v.outcome, v.value_text) for k, v in got.items()} == {
        (("d", "value", "1999"), "cited", "5"), (("d", "value", "2000"), "cited", "6"), (("d", "value", "2001"), "pattern_is_ambiguous", None), (("d", "basis", None), "not_stated", None),
        (("e", "value", None), "pattern_matched_nothing", None), (("e", "basis", None), "not_stated", None)}
    df = spark.createDataFrame([("d", "letter", "value at 1999: 5"), ("e", "letter", "")], "claim_id string, family string, canonical_text string")
    assert [tuple(r) for r in extraction.refused(extraction.extract(df, (rule, optional))).collect()] == [("e", ["value: pattern_matched_nothing"])]


def test_matches_of_random_texts(spark):
    rng = random.Random(1)
    texts = [(f"d{n}", "f", "".join(rng.choice("ab1 \n🙂é") for _ in range(rng.randrange(60)))) for n in range(150)]
    rule = Rule("f", "x", r"([ab]+)([0-9])", (("x", 2),), claim_group=1)
    got = facts(spark, texts, (rule,))
    for key, _, text in texts:
        found = {}
        for m in re.finditer(r"([ab]+)([0-9])", text):
            found.setdefault(m[1], []).append(m)
        for claim, own in found.items():
            r = got[key, "x", claim]
            assert r.hits == len(own)
            if len(own) == 1:
                assert (r.span_start, r.span_end, r.value_text) == (own[0].start(), own[0].end(), own[0][2])


def sentences(spark, texts):
    df = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "document_id string, canonical_text string")
    return df


def test_fragments_of_every_length(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "be", "a", "gamma,", "étude", "x", "🙂", "delta"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 15))).capitalize() + "." for _ in range(80)]
    texts += texts[:10]
    pieces = ["", "x", "be", "a", "🙂", "zz", "étude"]
    for _ in range(150):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        pieces.append(t[a : a + rng.randrange(1, 30)])
    fragments = spark.createDataFrame([(n, p) for n, p in enumerate(pieces)], "fragment_id int, fragment string")
    frame = citing.sentence_for_fragment(fragments, sentences(spark, texts))
    plan = frame._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    distinct = {r[0] for r in sentences(spark, texts).select(F.explode(citing.S.sentences(F.col("canonical_text")))).collect()}
    for r in frame.collect():
        own = sorted(s for s in distinct if pieces[r["fragment_id"]] in s) if pieces[r["fragment_id"]] else []
        assert r["sentences"] == len(own) and r["sentence"] == (own[0] if len(own) == 1 else None)


def test_no_fragments(spark):
    assert citing.sentence_for_fragment(spark.createDataFrame([], "fragment_id int, fragment string"), sentences(spark, ["One. Two."])).collect() == []


@pytest.mark.parametrize("text", ["", "\f", "a", "a\f", "a\f\f", "\fa", "a\f\fbc\fd", "a\f🙂\f"])
def test_pages_of_a_text(spark, text):
    got = [(r["page_no"], r["page_start"], r["page_end"]) for r in citing.pages(sentences(spark, [text])).orderBy("page_no").collect()]
    parts, at, want = text.split("\f"), 0, []
    for n, part in enumerate(parts):
        if n + 1 < len(parts) or part:
            want.append((n + 1, at, at + len(part)))
        at += len(part) + 1
    assert got == want


TEXTS = ["the shares purchased were shared\nnothing here\npurchase of SHARES", "no match at all", "", "sharing is 100 shares-of-record\n\nprice's price", "a\nb\nprice price price", "Price. " * 50]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(n, f"d{n}", t) for n, t in enumerate(TEXTS)] + [(99, "d99", None)], "document_no bigint, document_id string, canonical_text string")
    path = str(tmp_path_factory.mktemp("index"))
    retrieval.build_index(docs, path, slots=5)
    return docs, retrieval.open_index(spark, path)


def plain_hits(queries):
    word = re.compile(r"[0-9A-Za-z][0-9A-Za-z'’-]*")
    out = {}
    for key, terms in queries.items():
        for no, text in enumerate(TEXTS):
            for line_no, line in enumerate(text.split("\n")):
                for term in terms:
                    n = sum(w.startswith(term) for w in word.findall(line.lower()))
                    if n:
                        out[key, no, line_no, term] = n
    return out


def test_hits_of_the_index(spark, index):
    asked = spark.createDataFrame([("q1", "shares price"), ("q2", "the of"), ("q3", "purchasing 1"), ("q4", "zebra")], "requirement string, query string")
    got = {(r["requirement"], r["document_no"], r["line_no"], r["term"]): r["n"] for r in retrieval.hits(index[1], asked).collect()}
    assert got == plain_hits({"q1": ["shar", "price"], "q3": ["purchas", "1"]})


def test_an_index_of_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([], "document_no bigint, document_id string, canonical_text string")
    retrieval.build_index(docs, str(tmp_path / "none"))
    asked = spark.createDataFrame([("q", "shares")], "requirement string, query string")
    assert retrieval.matched_documents(retrieval.open_index(spark, str(tmp_path / "none")), asked).collect() == []


def test_only_slots_with_a_word_of_the_query_are_read(spark, index):
    asked = spark.createDataFrame([("q", "zebra")], "requirement string, query string")
    assert retrieval.hits(index[1], asked).count() == 0
    everything = index[1].postings.select("slot").distinct().count()
    wanted = retrieval.words_of_terms(index[1], spark.createDataFrame([("q", "price")], "requirement string, term string"))
    assert 0 < wanted.select("slot").distinct().count() < everything
