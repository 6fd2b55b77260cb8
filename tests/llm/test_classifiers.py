import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import language, lm, ppm, quality, texts, toxicity
from tests.llm.helpers import SMALL, awkward, documents, words


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, awkward())


# language identification


def test_language_on_held_out_rows(spark, corpus):
    docs = corpus[0]
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if fold(r.doc_id, 5) == 0]
    assert len(got) == 200 and all(g.held_out for _, g in held)
    assert sum(lang == g.lang_pred for lang, g in held) >= 0.97 * len(held)


def test_language_of_awkward_rows(odd):
    got = language.identify(odd).collect()
    assert len(got) == len(awkward())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {2, 3, 4, 11}
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in got)
    kept = language.accepted(odd, language.train(odd))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 8, 9}


def test_language_without_labels(odd):
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("doc_id < 0 or doc_id is null")).collect()} == {"und"}
    assert language.identify(odd.where("false")).collect() == []


def test_language_never_reads_the_answer(corpus):
    docs = corpus[0]
    model = language.train(docs)
    one = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert one == {r.doc_id: r.lang_pred for r in language.predict(docs.drop("lang", "source"), model).collect()}


# prediction by partial matching


def plain_bits(train: list[bytes], text: bytes, order: int) -> float:
    """Escape by distinct symbols with exclusion, by dictionaries."""
    table: dict = {}
    for t in train:
        symbols = [0] * order + [b + 1 for b in t] + [0]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                own = table.setdefault(tuple(symbols[i - k : i]), {})
                own[symbols[i]] = own.get(symbols[i], 0) + 1
    bits, symbols = 0.0, [0] * order + [b + 1 for b in text] + [0]
    for i in range(order, len(symbols)):
        out: set = set()
        for k in range(order, -1, -1):
            own = {s: n for s, n in table.get(tuple(symbols[i - k : i]), {}).items() if s not in out}
            if symbols[i] in own:
                bits += math.log2((sum(own.values()) + len(own)) / own[symbols[i]])
                break
            if own:
                bits += math.log2((sum(own.values()) + len(own)) / len(own))
            out |= own.keys()
        else:
            bits += math.log2(257 - len(out))
    return bits


@pytest.mark.parametrize("order", [1, 3, 5])
def test_trie_against_dictionaries(order):
    rng = random.Random(order)
    train = [bytes(rng.choice(b"abcd \xc3\xa9") for _ in range(rng.randrange(60))) for _ in range(30)]
    new = [b"", b"a", b"zzz", *(bytes(rng.choice(b"abcdz ") for _ in range(40)) for _ in range(10))]
    as_chunk = lambda own: (np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
    keys, n = np.unique(ppm.grams(*as_chunk(train), order)[0], return_counts=True)
    got = ppm.Scorer([ppm.Trie.of(keys, n, order)]).texts(*as_chunk(new))[:, 0]
    assert got == pytest.approx([plain_bits(train, t, order) for t in new])


def test_a_scorer_takes_little_more_than_its_table():
    rng = random.Random(2)
    keys = np.unique(np.array([rng.randrange(1 << 40) for _ in range(20_000)], np.uint64) | np.uint64(1))
    tries = [ppm.Trie.of(keys[a::2], np.full(len(keys[a::2]), 7), 4) for a in (0, 1)]
    scorer = ppm.Scorer(tries)
    assert scorer.table.tolist() == np.stack([t.bits(keys) for t in tries], axis=1).tolist()
    other = np.setdiff1d(keys ^ np.uint64(2), keys)
    for whole, sent in zip(tries, scorer.tries, strict=True):
        assert len(sent.nodes[-1][0]) == 0 < len(whole.nodes[-1][0])
        assert sent.bits(other).tolist() == whole.bits(other).tolist()
        assert all(part.itemsize == 4 for _, *parts in sent.contexts for part in parts)
    big = ppm.Trie.of(keys[:3], np.array([1 << 40, 1, 2]), 4)
    assert big.nodes[0][1].sum() == (1 << 40) + 3


def test_adaptive_learns():
    assert ppm.adaptive_bits(b"", 4) == pytest.approx(math.log2(257))
    assert ppm.adaptive_bits(b"abcabcabc" * 20, 4) < 2 * ppm.adaptive_bits(b"abcabcabc", 4)


def test_lm_counts_and_base(spark, odd):
    rows = [(i, t or "") for i, t, *_ in awkward()]
    tokens = lambda t: [*t.encode().lower().split(), None]
    trained = [w for i, t in rows if i is not None and fold(i, 5) != 1 for w in tokens(t)]
    counts = {w: trained.count(w) for w in set(trained)}
    term = lambda w: math.log10((counts.get(w, 0) + 0.5) / (len(trained) + 0.5 * (len(counts) + 1)))
    got = sorted(lm.score_corpus(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(tokens(r[1]))))
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (i, len(tokens(t)), len(trained))
        assert r.n_known == sum(w in counts for w in tokens(t))
        assert r.base_score == pytest.approx(sum(map(term, tokens(t))))
        assert r.held_out == (i is not None and fold(i, 5) == 1) and r.score < 0
    assert lm.score_corpus(odd.where("false")).collect() == []


def test_lm_rare_words_go_through_the_join(spark, odd, monkeypatch):
    full = sorted(map(tuple, lm.score_corpus(odd).select("doc_id", "n_tokens", "n_known").collect()), key=repr)
    monkeypatch.setattr(lm, "FREQUENT", 2)
    assert sorted(map(tuple, lm.score_corpus(odd).select("doc_id", "n_tokens", "n_known").collect()), key=repr) == full


def test_lm_score_is_the_tries(spark):
    rows = [(i, " ".join(words(i, 30, 20))) for i in range(12)]
    train = [t.encode() for i, t in rows if fold(i, 5) != 1]
    got = {r.doc_id: r.score for r in lm.score_corpus(documents(spark, rows), order=3).collect()}
    assert got == pytest.approx({i: -plain_bits(train, t.encode(), 3) * math.log10(2) for i, t in rows})


@pytest.mark.parametrize("most", [0, 4, 1 << 19])
def test_lm_rare_grams_keep_their_score(spark, monkeypatch, most):
    rows = [*((i, " ".join(words(i, 20, 20 + i))) for i in range(14)), (14, None), (15, "Éa ñu 🙂 zz"), (None, "qq no id"), (None, "zzzz")]
    train = [(t or "").encode() for i, t in rows if i is not None and fold(i, 5) != 1]
    monkeypatch.setattr(lm, "MAX_GRAMS", most)
    for order in (2, 5):
        got = sorted(r.score for r in lm.score_corpus(documents(spark, rows), order).collect())
        assert got == pytest.approx(sorted(-plain_bits(train, (t or "").encode(), order) * math.log10(2) for _, t in rows))


def test_lm_adaptive(odd):
    assert {r.doc_id: r.score for r in lm.score_adaptive(odd.where("doc_id in (2, 5)"), 2).collect()}[2] == pytest.approx(-math.log10(257))


# quality and toxicity


def auc(pairs) -> float:
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_quality_on_held_out_rows(corpus):
    got = {r.doc_id: r for r in quality.classify(*corpus).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in corpus[1].collect() if fold(r.doc_id, 5) == 0]
    assert len(got) == 200 and auc(held) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_quality_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    none = quality.classify(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd.where("false"), labels).collect() == []
    assert quality.accepted(odd, quality.train(odd, labels)).columns == odd.columns


def test_context_vectors_are_sums_of_neighbours(spark):
    vectors = quality.word_vectors(documents(spark, [(1, "a b"), (2, "a b"), (3, None)]))
    data, offsets = np.frombuffer(b"a b", np.uint8), np.array([0, 3])
    word, shape, _ = quality.types_of(data, offsets)
    want = np.zeros(quality.DIMENSIONS)
    for t in (word[1], shape[1]):
        for j in range(quality.NONZERO):
            want[quality._INDEX[t, j]] += 2 * quality._SIGN[t, j]
    assert vectors[word[0]] == pytest.approx(want / max(1, np.linalg.norm(want)), abs=1e-6)


def toxic_corpus(n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(words(1000 * i + k, 8, 150)) for k in range(rng.randrange(2, 7))]
        if i % 3 == 0:
            sentences.insert(rng.randrange(len(sentences)), "you are such a bad" + rng.choice(["ger", "dest", "ly"]))
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_and_its_sentences(spark):
    rows, labels = toxic_corpus()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].score, y) for i, _, y in labels if fold(i, 4) == 2]
    assert all(got[i].held_out == (fold(i, 4) == 2) for i, _, _ in labels)
    assert auc(held) > 0.95
    found = [(r.doc_id, r.sentence) for r in toxicity.locate(docs, model).collect()]
    assert found and all("such a bad" in s for _, s in found)
    texts_of = dict(rows)
    for r in toxicity.locate(docs, model).collect():
        assert texts_of[r.doc_id].encode()[r.begin : r.end].decode() == r.sentence


def test_noisy_or(spark):
    weights = np.zeros(toxicity.BUCKETS)
    data, offsets = np.frombuffer(b"aa bb. cc! dd", np.uint8), np.array([0, 13])
    model = toxicity.Model(weights, -1.0)
    p = model.sentences(data, offsets)[0]
    assert len(p) == 3 and 1 - np.prod(1 - p) == pytest.approx(1 - (1 - 1 / (1 + math.e)) ** 3)


def test_toxicity_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert all(r.predicted == 0 for r in toxicity.classify(odd.where("doc_id < 8"), labels.where("false")).collect())
    assert toxicity.classify(odd.where("false"), labels).collect() == []


# the byte helpers


def test_words_and_shingles():
    column = pa.array(["Ab ab  c", "", None, "x y z w v u", "a\tb\x0bc d", " X Y z w V u "])
    sets = []
    for limit in (1, 7, 1 << 20):
        own = [s for _, _, data, offsets in texts.chunks(column, limit) for s in texts.shingle_sets(data, offsets)]
        assert [len(s) for s in own] == [1, 0, 0, 2, 1, 2]
        assert (own[3] == own[5]).all()
        sets.append([s.tolist() for s in own])
    assert sets[0] == sets[1] == sets[2]


def test_slots_find_exactly():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    slots = ppm.Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(keys + np.uint64(1)) == -1).mean() > 0.99
    assert (ppm.Slots(keys[:0]).find(keys) == -1).all()
