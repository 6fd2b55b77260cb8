import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from sentencepiece import SentencePieceProcessor

from attestor.llm import licences, packing, sentencepieces, texts, wordids
from tests.llm.helpers import SMALL, awkward, documents

# packing


def checked(rows, texts, capacity, tokenizer):
    """The pieces must be the whole texts, in order, in sequences without gaps."""
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want[(i, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing_round_trip(spark, capacity):
    docs = documents(spark, awkward())
    tokenizer = packing.WordIds(packing.default_vocabulary()).tokenizer
    checked(packing.pack(docs, capacity=capacity).collect(), awkward(), capacity, tokenizer)
    assert packing.pack(docs.where("false")).collect() == []


def test_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(docs).collect()
    used = checked(rows, texts, 4096, packing.WordIds(packing.default_vocabulary()).tokenizer)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_ids_of_odd_texts():
    ids = packing.WordIds(packing.default_vocabulary())
    rng = random.Random(3)
    marks = ["<|endoftext|>", "'s", "don't", "İ", "Σας", "é", "½", " ", "\x1c", "漢字", "🙂", "A", "b!", "12", "ﬁ", " ", "K"]
    own = ["".join(rng.choice([*marks, " ", "\n"]) for _ in range(rng.randrange(20))) for _ in range(400)]
    data = np.frombuffer("".join(own).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in own)])
    got, bounds = ids.encode(data, offsets)
    for i, text in enumerate(own):
        assert got[bounds[i] : bounds[i + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_combination():
    rng = random.Random(1)
    for _ in range(200):
        counts = [0] * 31
        for _ in range(rng.randrange(6)):
            counts[rng.randrange(1, 31)] += 1
        items = [length for length, n in enumerate(counts) for _ in range(n)]
        room = rng.randrange(31)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = packing.fullest(counts, room, 30)
        assert sum(length * n for length, n in got) == best and all(n <= counts[length] for length, n in got)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 1500): rng.randrange(1, 500) for _ in range(300)}
    planned = packing.plan(histogram)
    placed = Counter()
    for sequences, combination in planned:
        assert sum(length * n for length, n in combination) <= 4096
        for length, n in combination:
            placed[length] += n * sequences
    assert placed == histogram
    assert sum(s for s, _ in planned) <= -(-sum(k * v for k, v in histogram.items()) // 4096) * 1.01 + 2


def test_a_common_length_is_numbered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SLICE", 10)
    texts = [(i, "same text here") for i in range(300)] + [(i, "x " * (i % 40)) for i in range(300, 400)]
    tokenizer = packing.WordIds(packing.default_vocabulary()).tokenizer
    checked(packing.pack(documents(spark, texts), capacity=64).collect(), texts, 64, tokenizer)


# licences

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_licences_against_the_definition(spark):
    notices = ["Released under the MIT License.", "mit-license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "the mit licensee", "MIT\nLICENSE mit license",
               "Licensed undr the Apachee License version 2.0", "Licensed under CC BY-NC 4.0.", "submit license", "Éapache license"]
    rng = random.Random(6)
    rows = awkward() + [(100 + i, " ".join(rng.sample(notices, 3)) + " filler" * i) for i in range(60)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows)).collect() if r.doc_id is not None}
    for i, text in rows:
        if i is None:
            continue
        own = WORD.findall(lowered(text or ""))
        places = [(k, label) for phrase, label in licences.PHRASES.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_fuzzy_notices_and_their_spans():
    text = "Intro text, été. Licensed undr the Apachee License version 2.0 and so on. Released under tha MIT licence! Licensed under CC BY-NC 4.0."
    n, base, found = licences.scan_text(text)
    labels = {label: (start, end, likeness) for label, _, start, end, likeness in found}
    assert base == [] and {"apache", "mit", "cc-by-nc"} <= labels.keys() and "cc-by" not in labels
    start, end, likeness = labels["apache"]
    assert text[start:end].startswith("Licensed undr") and text[start:end].endswith("2.0") and 0.9 < likeness < 1
    assert labels["cc-by-nc"][2] == 1


@pytest.mark.parametrize(("text", "want"), [
    ("licensed under CC BY-ND 4.0", ["cc-by-nd"]), ("unlicensed under cc by 4.0", []), ("licensed under CC BY-NC 4.0", ["cc-by-nc"]), ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa"]),
    ("licensd under CC BY 4.0", ["cc-by"]), ("licensed under CC BX 4.0", []), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", ["cc-by-nc-nd"]), ("GNU Lesser General Public License", ["lgpl"]),
    ("licensed under the GNU General Public Licenses", ["gpl"]), ("licensed under the gnu affero general public license", ["agpl"]), ("sublicensed under cc by sa 4 0", []), ("a plain text about nothing", []),
    ("the cc list is licensed to nobody", []), ("Mozilla Public Licence Version 2.0", ["mpl"])])
def test_a_notice_gets_its_own_label_and_no_siblings(text, want):
    assert sorted({label for label, *_ in licences.scan_text(text)[2]}) == want


def test_of_overlapping_notices_the_nearest_counts():
    notices = {n.text.decode(): n for n in licences._NOTICES}
    exact, sibling = notices["creative commons attribution noncommercial noderivatives"], notices["creative commons attribution noncommercial"]
    assert licences.foremost([(sibling, 0, 42, 0), (exact, 0, 56, 0), (sibling, 60, 100, 2)]) == [(exact, 0, 56, 0), (sibling, 60, 100, 2)]


def test_seeds_lose_no_place():
    """Every place that a plain bounded-error search finds is in a window around an exact piece."""
    rng = random.Random(12)
    for notice in licences._NOTICES[:6]:
        for _ in range(30):
            own = list(notice.text.decode())
            for _ in range(notice.edits):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["q"], [own[k], "q"]])
            text = ("some words before " + "".join(own) + " and after").encode()
            assert notice.matches(text), (notice.text, text)


# sentencepiece


@pytest.fixture(scope="module")
def original():
    return SentencePieceProcessor(model_file=sentencepieces.default_model())


def test_sentencepiece_whole_texts(spark, original):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).cache()
    assert all(r.parity for r in sentencepieces.parity(docs).collect())
    rows = sentencepieces.encode(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.ids == original.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip and r.parity
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = sentencepieces.decode(spark.createDataFrame(rows, sentencepieces.encode(docs).schema))
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_sentencepiece_of_awkward_rows(spark, original):
    docs = documents(spark, awkward())
    got = sentencepieces.encode(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(original.encode(t or ""))) for i, t, *_ in awkward())
    assert all(r.round_trip and r.parity for r in got)
    assert sentencepieces.encode(docs.where("false")).collect() == []


def test_rows_of_a_batch_are_spelled_apart(original):
    codec = sentencepieces.Codec(sentencepieces.default_model())
    some = ["", "a", "two words", "", "漢 é🙂", ""]
    rows = [np.array(original.encode(t), "<u4") for t in some]
    assert codec.spell_rows(rows) == [(" " + t if t else "").encode() for t in some]
    # A byte that moves to the row beside it changes both, though all rows together spell the same.
    assert codec.spell_rows([rows[2][:1], rows[2][1:]]) != codec.spell_rows([rows[2], rows[0]])
    assert codec.spell_rows([]) == [] and codec.spell_rows([rows[0]]) == [b""]


def test_random_texts_have_parity(original):
    codec = sentencepieces.Codec(sentencepieces.default_model())
    rng = random.Random(9)
    marks = [" ", "  ", "\n", "\t", "a", "The", "été", "漢", "🙂", " ", "<s>", "</s>", "<0x0A>", "12", "!!", "▁", "é", "\x00"]
    for _ in range(300):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(25)))
        if "▁" in text or "<" in text:
            continue
        assert codec.encode(text) == original.encode(text), text
        assert codec.decode(codec.encode(text)) == original.decode(original.encode(text))


def test_unigram_models_are_rebuilt(tmp_path):
    """A model written by hand: pieces with scores, a dummy prefix, byte fallback."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def entry(number, payload):
        return varint(number << 3 | 2) + varint(len(payload)) + payload

    def piece(text, score, kind):
        return entry(1, entry(1, text.encode()) + varint(2 << 3 | 5) + np.float32(score).tobytes() + varint(3 << 3) + varint(kind))

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -4, 1), ("b", -4.5, 1), ("ba", -2, 1), ("c", -5, 1)]
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1) + varint(40 << 3) + varint(0)
    normal = varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    path = tmp_path / "own.model"
    path.write_bytes(b"".join(piece(*p) for p in pieces) + entry(2, trainer) + entry(3, normal))
    own, codec = SentencePieceProcessor(model_file=str(path)), sentencepieces.Codec(str(path))
    assert codec.proto.model_type == sentencepieces.UNIGRAM and codec.proto.byte_fallback
    for text in ["ab", "ab abba", "cab  ba", "é a", "", "zab"]:
        assert codec.encode(text) == own.encode(text), text
        assert codec.decode(codec.encode(text)) == own.decode(own.encode(text))


def test_word_ids_take_one_thread_and_tables_go_with_their_task(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    wordids.WordIds(wordids.default_vocabulary())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"

    def run(batches):
        for data in batches:
            yield texts.span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]
            assert len(texts._powers[0]) < 2 * len(data) + (1 << 16)

    first = list(texts.tidied(run)([b"some words", b"x" * 200_000]))
    assert len(texts._powers[0]) == 0 and first == list(texts.tidied(run)([b"some words", b"x" * 200_000]))
