"""The corpus pipeline over `documents`: language ID, quality classifier, one document of each near-duplicate class, packing.

Every stage takes the rows that the one before it kept, written as Parquet and read again; all but the last hand on the
columns of `documents`. SQL cannot state the first two stages, so there is no oracle; tests compare each stage with a
plain version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import jaccard, language, packing, quality
from attestor.session import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in none of the languages learned from the rows, go; a language that is not stated is handed on as found."""
    return language.accepted(docs, language.train_to_reject(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, predicts to be of no quality go."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect, the one with the smallest id stays."""
    return jaccard.representatives(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", join_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run_stages(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """All stages; what each keeps lies in ``folder`` under its name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def dropped(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """stage, given, kept and dropped: the rows of every filtering stage of a run that wrote to ``folder``."""
    counts, before = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, _) in enumerate(STAGES[:-1]):
        kept = spark.read.parquet(f"{folder}/{name}")
        row = before.agg(F.count("*").alias("given")).join(kept.agg(F.count("*").alias("kept")), F.lit(True)).select(F.lit(place).alias("place"), F.lit(name).alias("stage"), "given", "kept")
        counts, before = row if counts is None else counts.unionByName(row), kept
    return counts.withColumn("dropped", F.col("given") - F.col("kept"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, sf_dir, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
