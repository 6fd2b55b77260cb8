"""Documents: load with hashes and pages, refuse empty text, store by content, read recorded proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import model
from attestor.functions import scalars as S


def read_files(spark, path: str, extractor: str = "plain") -> DataFrame:
    """SRC-07 from a folder: each file once, bytes and text, hashes of both."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return hashed(raw.select(F.col("path").alias("document_id"), F.decode("content", "UTF-8").alias("canonical_text"), F.lit(extractor).alias("extractor"), F.col("length").alias("byte_size")))


def hashed(documents: DataFrame) -> DataFrame:
    """SRC-07: hashes, length and page count; a text without any character is refused, not stored empty."""
    breaks = F.length("canonical_text") - F.length(F.replace("canonical_text", F.lit("\f"), F.lit("")))
    tail = F.when(F.endswith("canonical_text", F.lit("\f")) | (F.length("canonical_text") == 0), 0).otherwise(1)
    return (
        documents.withColumn("content_hash", S.content_hash(F.col("canonical_text"))).withColumn("text_hash", S.text_hash(F.col("extractor"), F.col("canonical_text")))
        .withColumn("page_count", breaks + tail).withColumn("text_length", F.length("canonical_text"))
        .withColumn("refusal", F.when(F.trim(F.regexp_replace("canonical_text", r"\s", "")) == "", "the text is empty"))
    )


def arrivals(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC-08: each incoming version is new, already stored, or a collision: the id of a stored one with other content."""
    by_id = stored.select("document_id", F.col("content_hash").alias("stored_hash"))
    by_hash = stored.select("content_hash").distinct().withColumn("known", F.lit(True))
    met = incoming.join(by_id, "document_id", "left").join(by_hash, "content_hash", "left")
    return met.withColumn("arrival", F.when(F.col("stored_hash").isNotNull() & (F.col("stored_hash") != F.col("content_hash")), "collision")
                          .when(F.col("stored_hash").isNotNull(), "already_stored").when(F.col("known"), "same_content_elsewhere").otherwise("new"))


PROPOSAL = "field string, value string, quote string, fingerprint string"


def recorded_proposals(recordings: DataFrame, column: str, fingerprint: str) -> DataFrame:
    """SRC-09: proposals parsed under a fixed schema; undeclared fields and stale recordings are refused by name."""
    parsed = recordings.withColumn("p", F.from_json(column, PROPOSAL, {"mode": "PERMISSIVE"}))
    known = list(model.FIELD_REQUESTS)
    refusal = (
        F.when(F.col("p.field").isNull() | F.col("p.quote").isNull(), "not_a_proposal").when(F.col("p.fingerprint") != F.col(fingerprint), "stale_recording")
        .when(~F.col("p.field").isin(known), "undeclared_field"))
    return parsed.withColumn("refusal", refusal)


def declared_counts(frames: dict[str, DataFrame], declared: DataFrame) -> DataFrame:
    """SRC-10: rows read per table beside the declared number (table_name, declared); a difference is visible, not repaired.

    A table that nothing declares has neither number nor agreement.
    """
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out.join(declared.select("table_name", "declared"), "table_name", "left").withColumn("agrees", F.col("declared") == F.col("rows"))


def findings_snapshot(findings: DataFrame, path: str) -> DataFrame:
    """SRC-11: findings written as JSON lines and read back under their schema."""
    findings.write.json(path)
    return findings.sparkSession.read.schema(findings.schema).json(path)
