import ast
import pathlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import jaccard, language, packing, quality
from tests.llm.helpers import SMALL, awkward, documents


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, whole = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, ids = kept, {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, before, SMALL).cache()
        rows = kept.collect()
        assert kept.columns == columns and all(whole[r.doc_id] == r for r in rows)
        got = {r.doc_id for r in rows}
        if name == "language_id":
            model = language.train_to_reject(before)
            want = {r.doc_id for r in language.predict(before, model).collect() if r.lang_pred != "und" and r.bits_per_byte <= model.most_bits}
        elif name == "quality":
            want = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.predicted}
        else:
            want = {r.doc_id for r in jaccard.classes_of(before).collect() if r.doc_id == r.component_id}
        assert got == want and len(rows) == len(got) and got <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
    want = packing.pieces(docs).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, want))


def noise(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(33, 127)) for _ in range(n)) + "a"


def test_the_language_stage_drops_what_is_in_no_language(spark):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = plain.select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(10_000 + n, noise(n, 400), None, "s", 401) for n in range(20)] + [(20_000, "12 34 !!", "en", "s", 8), (20_001, None, None, "s", None)]
    told = own.select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("lang")).alias("lang"), "source", "n_chars")
    kept = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, told.unionByName(spark.createDataFrame(rows, told.schema)), SMALL).collect()}
    assert not any(i >= 10_000 for i in kept)
    stated = {r.doc_id: r.lang for r in own.collect()}
    # Of the given documents at most a few short or broken ones go, and a language that was taken away is found again.
    assert len(kept) >= 0.99 * len(stated)
    found = [i for i in kept if i % 10 == 0]
    assert found and sum(kept[i].lang == stated[i] for i in found) >= 0.95 * len(found) and all(kept[i].lang == stated[i] for i in kept if i % 10)


def test_what_each_stage_dropped(spark, tmp_path):
    corpus_pipeline.run_stages(spark, SMALL, str(tmp_path / "run"))
    rows = corpus_pipeline.dropped(spark, SMALL, str(tmp_path / "run")).orderBy("place").collect()
    assert [r.stage for r in rows] == ["language_id", "quality", "near_duplicates"]
    assert rows[0].given == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(a.kept == b.given for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.dropped == r.given - r.kept >= 0 for r in rows) and rows[1].dropped > 0 and rows[2].dropped > 0


def test_awkward_rows_pass_through(spark, tmp_path):
    docs = documents(spark, awkward())
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, docs, str(tmp_path))
        assert following.columns == docs.columns
        docs = following.cache()
        docs.count()
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} >= {1, 8}


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("attestor/**/*.py"), *root.glob("catalogue/**/*.py")]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
