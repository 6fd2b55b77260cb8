"""Sum-of-squares packing, the manifest and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attestor.llm import audit, manifest, squares, wordids
from tests.llm.helpers import CLASHING, SMALL, awkward, documents, words

# packing


def packed(rows, texts, capacity, tokenizer) -> dict:
    """Pieces must be whole texts, each id once, in sequences without gaps; returns the length of each sequence."""
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    ids_of = {}
    for i, text in texts:
        ids_of.setdefault(i, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    assert set(by_document) == set(ids_of)
    for i, own in by_document.items():
        if len(ids_of[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                ids = ids_of[i][0]
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids_of[i][0])
        else:
            assert sum(r.length for r in own) == sum(map(len, ids_of[i]))
    return {s: sum(r.length for r in own) for s, own in by_sequence.items()}


@pytest.mark.parametrize(("capacity", "open_windows"), [(4096, 64), (50, 3), (64, 1)])
def test_every_id_in_one_piece_and_nothing_padded(spark, capacity, open_windows):
    rows = awkward() + [(1000 + i, " ".join(words(i, 1 + i * 7 % 90))) for i in range(200)]
    lengths = packed(squares.pack(documents(spark, rows).repartition(3), capacity=capacity, open_windows=open_windows).collect(), rows, capacity, wordids.WordIds(wordids.default_vocabulary()).tokenizer)
    short = [n for n in lengths.values() if n < capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 3 * capacity.bit_length()


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = squares.pack(docs).collect()
    packed(rows, texts, 4096, wordids.WordIds(wordids.default_vocabulary()).tokenizer)
    short = {r.doc_id for r in rows if r.doc_tokens <= 4096}
    cut = {i for i, n in Counter(r.doc_id for r in rows if r.doc_tokens <= 4096).items() if n > 1}
    assert len(cut) <= max(80, len(short) // 2)
    assert squares.pack(docs.where("false")).collect() == []


def test_the_chosen_level_makes_the_squares_least():
    rng = random.Random(5)
    for _ in range(2_000):
        capacity = rng.randrange(2, 12)
        levels = np.zeros(capacity + 1, np.int64)
        for h in range(1, capacity):
            levels[h] = rng.randrange(4)
        size = rng.randrange(1, capacity)

        def squares_after(h, levels=levels, size=size, capacity=capacity):
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + size < capacity:
                after[h + size] += 1
            return int((after**2).sum())

        fits = [h for h in range(1, capacity - size + 1) if levels[h]]
        got = squares.chosen(levels, size)
        assert (got == 0 or got in fits) and squares_after(got) == min(squares_after(h) for h in [0, *fits])
        assert got == max((h for h in [0, *fits] if squares_after(h) == squares_after(got)), default=0)
        closed = squares.chosen(levels, size, room_for_new=False)
        assert closed == -1 if not fits else squares_after(closed) == min(map(squares_after, fits))


def test_a_stream_holds_no_more_windows_than_it_may():
    stream = squares.Stream(100, 4, 0)
    rng = random.Random(2)
    for i in range(3_000):
        stream.add(i, np.arange(rng.randrange(1, 260), dtype="<u4").tobytes())
        assert stream.open == sum(len(w) for w in stream.windows.values()) == stream.levels.sum() <= 4
    stream.finish()
    assert not stream.windows


# ids


def test_ids_are_the_tokenizers_own():
    ids = wordids.WordIds(wordids.default_vocabulary())
    assert ids.cuts_known
    rng = random.Random(3)
    marks = ["<|endoftext|>", "'s", "don't", "İ", "Σας", "é", "½", " ", "\x1c", "漢字", "🙂", "A", "b!", "12", "ﬁ", "K", "'", "'re", "'ll", "’s", "…", "×", "ÀB", "l", "ve", "d", "'T", "x́", "́", "\u0085", "²", "#$", " ", " ", "\n"]
    for _ in range(100):
        own = ["".join(rng.choice(marks) for _ in range(rng.randrange(20))) for _ in range(30)]
        data = np.frombuffer("".join(own).encode(), np.uint8)
        got, bounds = ids.encode(data, np.cumsum([0, *(len(t.encode()) for t in own)]))
        for i, text in enumerate(own):
            assert got[bounds[i] : bounds[i + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_another_file_is_encoded_plainly():
    import public_tokenizers

    ids = wordids.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not ids.cuts_known
    own = ["Two words, A and b.", "", "  blanks  ", "<|endoftext|>x"]
    got, bounds = ids.encode(np.frombuffer("".join(own).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in own)]))
    for i, text in enumerate(own):
        assert got[bounds[i] : bounds[i + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_slots_that_two_cuts_share(monkeypatch):
    ids = wordids.WordIds(wordids.default_vocabulary())
    monkeypatch.setattr(wordids, "HELD_IDS", 50)
    rng = random.Random(4)
    for _ in range(30):
        text = " ".join(words(rng.randrange(1000), 50, 300))
        got, _ = ids.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


# manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and the siblings (side, node) of every node, bottom up."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, covered = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for j, other in ((i, i + 1), (i + 1, i)):
                for k in under[j] if j < len(nodes) else []:
                    paths[k].append(("R" if other > j else "L", nodes[other]) if other < len(nodes) else ("-", ""))
            above.append(sha("".join(pair)))
            covered.append(sum(under[i : i + 2], []))
        nodes, under = above, covered
    return nodes[0], paths


def plain_manifest(rows) -> Counter:
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, tops = tree([trees[g][0] for g in order])
    out = Counter()
    for g, top in zip(order, tops, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf((*row[:3], row[3] + 1, row[4])) if hit else leaf(row)
            for side, other in path + top:
                node = sha(other + node) if side == "L" else sha(node + other)
            proof = sha("".join(other for _, other in path + top))
            out[(row[0], leaf(row), trees[g][0], root, proof, node, node == root)] += 1
    return out


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", *(F.lit(i).alias(name) for i, name in enumerate(CLASHING)))


def got_manifest(spark, rows) -> Counter:
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.verify(table(spark, rows)).collect())


def test_manifest_against_plain_trees(spark):
    rng = random.Random(8)
    rows = [(i, f"src{i % 3}", rng.choice(["en", "en", "en", "de", None, "", "é", "z"]), i * 3, f"text é {i}") for i in rng.sample(range(-3_000, 200_000), 3_000)]
    rows += [(i, None, "en", None, t) for i, t, *_ in awkward()] + [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (7, "s", "only", 1, "x"), (2**63 - 1, "s", "en", 2**63 - 1, ""), (-(2**63), "s", "en", 0, "")]
    rows += [(5, "s", "rep", i % 4, "same") for i in range(1_300)] + [(6, "s", "rep", 0, "other"), (4, "s", "rep", 0, "other")]
    want = plain_manifest(rows)
    got = got_manifest(spark, rows)
    # Equal rows of one id share a leaf, so only the multiset of their proofs is defined.
    assert got == want
    assert not all(key[6] for key in got) and any(key[6] for key in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en" if i % 2 else "de", 1, str(i)) for i in range(n)]
    assert got_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_one_group_and_of_none(spark):
    assert got_manifest(spark, [(3, "s", None, 1, "x")]) == plain_manifest([(3, "s", None, 1, "x")])
    assert manifest.verify(table(spark, [(3, "s", None, 1, "x")]).where("false")).collect() == []


# audit

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def plain_audit(rows, labels) -> dict:
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    failed = []
    for i, text, source in rows:
        text = text or ""
        own = [w for w in SPACES.split(text) if w]
        bits = (len(own) < 50, 100 * len(set(own)) < 65 * len(own), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text),
                any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows))
        failed.append((source or "", {f for f, bit in zip("ABCDE", bits, strict=True) if bit}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        own, total = [f[1:] for f in failed if f[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_against_a_plain_count(spark):
    rng = random.Random(9)
    pool = ["", None, "   ", "A B C", "word " * 80, " ".join(words(1, 60, 10_000)), " ".join(words(2, 70, 10_000)) + " #", "É" * 3 + " " + " ".join(words(3, 55, 10_000)), "AB " * 60, "one two\x0bthree\x1cfour"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice([None, "", "s0", "s0", "s0", "s1"])) for _ in range(250)]
    rows += [(3, "twice the same", "s1"), (3, "twice the same", "s0"), (4, "twice the same", "s0")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    sources = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    got = audit.steps(sources.selectExpr("*", "1 AS part", "2 AS mask", "3 AS digest", "4 AS n"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_audit_of_an_empty_table(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.steps(docs.where("false"), labels).collect() == []
    assert len(audit.steps(docs, labels).collect()) == 600


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_meet_every_order_once(n):
    order, met = list(range(n)), {tuple(range(n))}
    for level in audit.swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        assert tuple(order) not in met
        met.add(tuple(order))
    assert met == set(itertools.permutations(range(n)))


def test_equal_subdiagrams_are_held_once():
    diagram = audit.Diagram({0: (5, 1, 0), 31: (2, 0, 1)}, 5)
    assert len(diagram.nodes) < 20
