import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from attestor.llm import winnowing
from tests.llm.helpers import awkward, documents, words


def longs(*values: int) -> int:
    """xxhash64 of a row of longs: each hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed=seed)
    return seed


def plain(text: str) -> list[tuple[int, int]]:
    """(hash, place) by the definition: every window of grams, its least hash, the rightmost of equals."""
    own = [w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not own:
        return []
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in own]
    if len(own) < winnowing.K:
        grams = [xxhash.xxh64_intdigest(" ".join(own).encode(), seed=42) >> 5]
    else:
        grams = [longs(*hashes[i : i + winnowing.K]) >> 5 for i in range(len(own) - winnowing.K + 1)]
    kept = []
    for i in range(max(1, len(grams) - winnowing.WINDOW + 1)):
        window = range(i, min(i + winnowing.WINDOW, len(grams)))
        best = min(window, key=lambda p: (grams[p], -p))
        if best not in kept:
            kept.append(best)
    return [(grams[p], p) for p in kept]


def like(a, b) -> float:
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def got(spark):
    return winnowing.compare(documents(spark, awkward())).collect()


def test_against_the_definition(got):
    rows = [(i, t or "") for i, t, *_ in awkward()]
    known = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id == 1:
            continue
        text = dict(known)[r.doc_id]
        at = [i for i, _ in known].index(r.doc_id)
        following = known[(at + 1) % len(known)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if r.doc_id != 10:  # lower case of these letters differs between Python and the JVM
            assert r.fingerprint == ",".join(f"{h:x}:{p}" for h, p in plain(text))
            if "Σ" not in edited and "İ" not in edited:
                assert r.edited_fingerprint == ",".join(f"{h:x}:{p}" for h, p in plain(edited))
                assert r.near_edited == like(plain(text), plain(edited))
                assert r.near_next == pytest.approx(like(plain(text), plain(following))) or "Σ" in following


def test_the_last_is_followed_by_the_first(spark):
    texts = {i: " ".join(words(i, 40)) for i in range(1, 300)}
    got = {r.doc_id: r for r in winnowing.compare(documents(spark, list(texts.items()))).collect()}
    for i, text in texts.items():
        following = texts[i - 1] if i > 1 else texts[299]
        third = len(text) // 3
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


def test_rows_without_id_are_their_own_next(got):
    assert [r.near_next for r in got if r.doc_id is None] == [1.0, 1.0]


def test_shared_runs_share_a_hash(spark):
    run = " ".join(words(5, winnowing.K + winnowing.WINDOW - 1))
    rows = [(i, " ".join([*words(100 + i, 30), run, *words(200 + i, 17)])) for i in range(20)]
    prints = documents(spark, rows).select(winnowing.fingerprint(F.col("text")).alias("p")).collect()
    assert set.intersection(*({*r.p["hash"]} for r in prints))


def test_equal_minima_keep_the_rightmost(spark):
    row = documents(spark, [(1, "a " * 30)]).select(winnowing.fingerprint(F.col("text")).alias("p")).first()
    assert row.p["at"] == list(range(winnowing.WINDOW - 1, 26))


def test_empty_table(spark):
    assert winnowing.compare(documents(spark, [(1, "a")]).where("false")).collect() == []
