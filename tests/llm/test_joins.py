import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import graph, jaccard, quality, queries, texts, vectors
from tests.compare import connect
from tests.llm.helpers import SMALL, awkward, documents, rows_of, words


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_classes(rows):
    sets: dict = {}
    for i, text in rows:
        own = (text or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(own[k : k + 5]) for k in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else []))
    links = [(i, j) for i, j in itertools.combinations(sets, 2) for s in sets[i] for t in sets[j] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    return {i: len(s[0]) for i, s in sets.items()}, roots(sets, links)


def near_copies(n: int, hot: int) -> list[tuple[int, str]]:
    """A large family of near copies, pairs around the threshold, a passage that all texts share, and copies."""
    rng = random.Random(8)
    passage, family = words(9, 30), words(10, 120, 5000)
    rows = []
    for i in range(n):
        if i < hot:
            own = list(family)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
        elif i % 3 == 0:
            own = passage + words(1000 + i, rng.randrange(0, 12))
        else:
            own = words(2000 + i // 2, 60, 5000)
            if i % 2:
                own[: rng.randrange(1, 14)] = words(3000 + i, 3)
            own = passage + own
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    return rows + [(n + 1, rows[0][1]), (n + 2, rows[1][1].upper())]


@pytest.mark.parametrize("hot", [50, 3])
def test_jaccard_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = near_copies(260, 90)
    sizes, want = plain_classes(rows)
    got = {r.doc_id: r for r in jaccard.classes_of(documents(spark, rows)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert 20 < len(set(want.values())) < 230


def test_jaccard_without_groups(spark, monkeypatch):
    """Links that no leader finds must come out of the matrix."""
    monkeypatch.setattr(jaccard, "AGREEING", 7)
    rows = near_copies(150, 40)
    assert {r.doc_id: r.component_id for r in jaccard.classes_of(documents(spark, rows)).collect()} == plain_classes(rows)[1]


def test_jaccard_of_awkward_rows(spark):
    got = jaccard.classes_of(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    by = {r.doc_id: r for r in got}
    assert by[9].component_id == 1 and by[7].component_id == 6 and by[6].n_shingles == 1
    assert [by[i].n_shingles for i in (2, 3, 4, 5)] == [0, 0, 0, 1] and by[3].component_id == 3
    assert by[None].component_id is None
    assert jaccard.classes_of(documents(spark, awkward()).where("false")).collect() == []


def test_one_id_with_two_texts_connects(spark):
    a, b = " ".join(words(1, 30)), " ".join(words(2, 30))
    got = {r.doc_id: r.component_id for r in jaccard.classes_of(documents(spark, [(1, a), (5, a), (5, b), (7, b), (9, "z z")])).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9}


def test_representatives(spark):
    docs = documents(spark, awkward())
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 8, 10, 11, 12, None, None], key=repr)


def test_representatives_by_text_not_by_id(spark):
    """Unrelated texts of one doc_id both stay; copies without an id go, also near copies of a row with one."""
    one, two, three = (" ".join(words(seed, 40)) for seed in (1, 2, 3))
    docs = documents(spark, [(1, one), (1, two), (2, two), (None, three), (None, three), (None, one + " more"), (None, ""), (None, ""), (3, three + " end"), (4, None), (4, " ")])
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, one), (1, two), (3, three + " end"), (None, ""), (None, ""), (4, None), (4, " ")], key=repr)


def on_duckdb(name):
    cursor = connect(SMALL).execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    return names, sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_duckdb(spark, name):
    names, want = on_duckdb(name)
    assert rows_of(queries.QUERIES[name](spark, SMALL), *names) == want


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in [1, *range(200, 260)]}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_stars_take_no_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, plain=graph.cut_lineage: (cuts.append(df), plain(df))[1])
    edges = spark.createDataFrame([(1, 5), (7, 1), (1, 7), (9, 1), (3, 4), (3, 3)], "a long, b long")
    assert rows_of(graph.components(edges)) == [(1, 1), (3, 3), (4, 3), (5, 1), (7, 1), (9, 1)]
    assert len(cuts) == 1
    for tangled in ([(1, 5), (2, 5)], [(1, 2), (2, 3)]):
        cuts.clear()
        assert {r.component for r in graph.components(spark.createDataFrame(tangled, "a long, b long")).collect()} == {1}
        assert len(cuts) > 1


def test_driver_takes_tables_not_rows(spark, monkeypatch):
    rows = [(i, " ".join(words(i % 7, 30)), "en") for i in range(40)] + [(40, None), (41, "")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")

    def refused(*_):
        raise AssertionError("rows were taken as Python objects")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    assert rows_of(jaccard.representatives(docs).select("doc_id")) == [(i,) for i in (0, 1, 2, 3, 4, 40, 41, 5, 6)]
    assert quality.accepted(docs, quality.train(docs, labels)).columns == docs.columns
    assert jaccard.bitmap(docs.select((F.col("doc_id") + 23).alias("id")).where("id IN (23, 63, 64)"), 12)[:3].tolist() == [(1 << 63) + (1 << 23), 1, 0]
    assert not jaccard.bitmap(docs.select("doc_id").where("doc_id < 0"), 12).any()


def test_ids_of_whole_sets_are_told_once(spark):
    docs = documents(spark, [(i, " ".join(words(i, 20))) for i in range(12)])
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    ids = spark.createDataFrame([(3,), (3,), (5,)], "doc_id long").mapInArrow(counted, "doc_id long")
    assert rows_of(jaccard.whole_sets(docs, ids).select("doc_id")) == [(3,), (5,)]
    assert runs.value == 3


def vector_rows(seed=2, n=300, dimensions=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=dimensions) * np.linalg.norm(base) / dimensions**0.5 * rng.choice([0.02, 0.1, 0.19, 0.21, 0.4])
        else:
            v = rng.normal(size=dimensions)
        rows.append((i, (v * rng.choice([1.0, 7.5])).tolist(), int(i % 2)))
    return rows


def plain_links(rows, threshold=0.98):
    links = []
    for (i, u, k), (j, v, m) in itertools.combinations(rows, 2):
        u, v = np.array(u), np.array(v)
        if k == m and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
            links.append((i, j))
    return links


def test_near_vectors_recall(spark):
    found = asked = 0
    for seed in range(3):
        rows = vector_rows(seed)
        links = plain_links(rows)
        got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        want = {i: sum(i in pair for pair in links) for i, _, _ in rows}
        assert all(got[i].n_links <= n for i, n in want.items())
        found, asked = found + sum(r.n_links for r in got.values()), asked + 2 * len(links)
    assert asked > 100 and found >= 0.99 * asked


def test_near_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.01 * rng.normal(size=16)).tolist(), 1) for i in range(60)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(59, 0, True), (59, 0, False)}


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1),
            (10, [float("inf"), 2.0, 3.0], 1), (11, [*one, 4.0], 1), (12, [2e200, 4e200, 6e200], 1), (None, one, 1), (2, one, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS cell", "2 AS member", "3 AS i", "4 AS links")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == by[12] == (2, 1, False) and by[None] == (0, None, None)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_calibrated_count():
    p = 0.9973
    assert vectors.least_collisions() <= vectors.PROJECTIONS
    draws = np.random.default_rng(0).binomial(vectors.PROJECTIONS, p, 100_000)
    assert (draws >= vectors.least_collisions()).mean() >= vectors.RECALL - 0.002


def test_tasks_of_joins_and_quality_give_memory_back(spark, monkeypatch):
    """Workers live on through stages that run in the JVM only, so what a task no longer uses must not stay with them."""
    tidied, kept = [], texts.tidied
    monkeypatch.setattr(texts, "tidied", lambda run: tidied.append(run.__qualname__.split(".")[0]) or kept(run))
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(40))) for i in range(8)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == [0, 2, 4, 6]
    assert {"profiles", "heads", "whole_sets", "_matrix_rows", "_parted"} <= set(tidied)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    quality.accepted(docs, quality.train(docs, labels)).collect()
    assert {"_contexts", "train", "accepted"} <= set(tidied)
