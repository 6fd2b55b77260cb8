"""Sinks: staged writes, quarantine of refused rows, CSV tables, evidence folders and the hashed manifest."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.session import shared_folder


def staging_path(spark, name: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged_copy(df: DataFrame, name: str) -> DataFrame:
    """Write to staging and read back, so that what follows sees what was written."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_rows(df: DataFrame, table: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """SNK-01: rows that keep every rule, and the refused rows with their reasons; one bad row never stops the rest."""
    tagged = df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()])))
    refused = tagged.filter(F.size("violations") > 0).withColumn("table_name", F.lit(table))
    return tagged.filter(F.size("violations") == 0).drop("violations"), refused


def document_outcomes(documents: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """SNK-02: what each document gave: facts, refusals, and an error where it gave nothing."""
    counted = extracted.groupBy(key).agg(F.count_if(F.col("outcome") == "cited").alias("facts"), F.count_if(F.col("outcome") != "cited").alias("refused"))
    out = documents.select(key).join(counted, key, "left")
    return out.select(key, F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("refused", F.lit(0)).alias("refused"),
                      F.when(F.coalesce("facts", F.lit(0)) == 0, "nothing was cited").alias("error"))


def csv_table(df: DataFrame, name: str) -> str:
    """SNK-04: one table as CSV, data only: no totals, no notes."""
    path = staging_path(df.sparkSession, f"csv-{name}")
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


# Characters no file system takes in a name (fixed value); a run of them becomes one underscore.
UNSAFE_IN_NAME = r'[/\\:*?"<>|\x00-\x1f]+'


def safe_name(raw: Column) -> Column:
    cleaned = F.replace(F.regexp_replace(raw, UNSAFE_IN_NAME, "_"), F.lit(".."), F.lit("__"))
    trimmed = F.regexp_replace(cleaned, r"^[ .]+|[ .]+$", "")
    return F.when(trimmed == "", "unnamed").otherwise(trimmed)


def path_plan(rows: DataFrame, within: list[str], name: str, key: str) -> DataFrame:
    """SNK-06: a folder of its own for every row.

    The first holder of a safe name has it plain, every other row carries its id. A name that itself ends in the id
    of some row of the same packet carries its own id too, so no plain name can be another row's name with its id. An
    id that is not safe as a name is told apart by its hash. The first holder is an aggregate per name, so no packet
    is sorted whole.
    """
    raw = F.col(key).cast("string")
    plain = safe_name(raw)
    label = F.when(plain == raw, plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.sha2(raw, 256), 1, 16)))
    named = rows.withColumn("safe", safe_name(F.col(name))).withColumn("label", label).withColumn("folded", F.lower("safe"))
    named = named.withColumn("ending", F.regexp_extract("folded", r"\(([^()]*)\)$", 1))
    first = named.groupBy(*within, "folded").agg(F.min(F.struct(name, key)).alias("first"))
    ids = named.select(*within, F.lower("label").alias("ending")).distinct().withColumn("posing", F.lit(True))
    joined = named.join(first, [*within, "folded"]).join(ids, [*within, "ending"], "left")
    taken = (F.col(f"first.{key}") != F.col(key)) | F.col("posing").isNotNull()
    directory = F.concat(F.lit("companies/"), F.when(taken, F.concat("safe", F.lit(" ("), "label", F.lit(")"))).otherwise(F.col("safe")))
    return joined.withColumn("directory", directory).drop("safe", "folded", "first", "label", "ending", "posing")


# What Spark's partition folders do not hold as it is (fixed value), and the folder of a value that is null or empty.
ESCAPED_IN_FOLDER = frozenset('"#%\'*/:=?\\{[]^\x7f' + "".join(map(chr, range(1, 32))))
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _mounted(spark, path: str) -> str | None:
    """A path of the shared folder as executors' own file calls reach it, or None where only Spark's file systems do."""
    if not urlparse(path).scheme:
        # Which file system a bare path belongs to is the cluster's setting; a file written there tells it.
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/_begun")
        path = spark.read.parquet(f"{path}/_begun").inputFiles()[0].rsplit("/_begun/", 1)[0]
    found = urlparse(path)
    return unquote(found.path) if found.scheme == "file" else None


def _write_folders(root: str):
    """Batches whose rows lie in order of their folder: a task writes a file into each folder and tells (folder, file)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, told, here, writer = f"part-{task.partitionId():05d}.parquet", [], None, None

        def close() -> None:
            if writer is not None:
                writer.close()
                os.replace(*told[-1][2])

        for batch in batches:
            values, rest = batch.column("folder").to_pylist(), pa.Table.from_batches([batch]).drop_columns("folder")
            start = 0
            for n in range(1, len(values) + 1):
                if n < len(values) and values[n] == values[start]:
                    continue
                if writer is None or values[start] != here:
                    close()
                    if len(told) >= 10_000:
                        yield _told_files(told)
                        told = []
                    here = values[start]
                    directory = f"{root}/folder=" + ("".join(f"%{ord(c):02X}" if c in ESCAPED_IN_FOLDER else c for c in here) if here else NO_VALUE)
                    os.makedirs(directory, exist_ok=True)
                    # Hidden from readers until it is whole.
                    told.append((here or None, f"{directory}/{name}", (f"{directory}/.{name}.{task.taskAttemptId()}", f"{directory}/{name}")))
                    writer = pq.ParquetWriter(told[-1][2][0], rest.schema, store_schema=False)
                writer.write_table(rest.slice(start, n - start))
                start = n
        close()
        yield _told_files(told)

    return write


def _told_files(told: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t[n] for t in told], pa.string()) for n in (0, 1)], ["folder", "file"])


def _read_files(columns: list[str]):
    """Batches of (folder, file): the rows of the files, many files to a batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for folder, file in zip(*(batch.column(c).to_pylist() for c in ("folder", "file")), strict=True):
                with pq.ParquetFile(file) as opened:
                    for part in opened.iter_batches(columns=[c for c in columns if c != "folder"]):
                        part = part.append_column("folder", pa.repeat(pa.scalar(folder, pa.string()), part.num_rows)).select(columns)
                        held.append(part)
                        rows += part.num_rows
                        if rows >= 10_000:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return read


def evidence_folders(members: DataFrame, documents: DataFrame, name: str, slices: int = 8) -> str:
    """SNK-05: one folder per position; a position without documents gets a note saying so.

    ``members``: holding_id and the folder that the path plan gives it. ``slices`` bounds the files per folder and lets a
    position with very many documents be written by several tasks. Tasks put their files in place themselves; moving the files of
    all positions one by one would be the driver's work. In a mounted folder they also write them themselves, since Spark's local
    file system starts processes for every file, and list them in a table beside the folders for `read_folders`. The path is
    handed on only when all are written.
    """
    full = members.join(documents, "holding_id", "left").withColumn(
        "note", F.when(F.col("document_id").isNull(), "no document of this position is on file"))
    spark = members.sparkSession
    path = staging_path(spark, f"evidence-{name}")
    spread = F.pmod(F.xxhash64(F.coalesce("document_id", F.lit(""))), F.lit(slices))
    root = _mounted(spark, path)
    if root is None:
        dealt = full.repartition(F.col("folder"), spread).sortWithinPartitions("folder")
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder").parquet(path)
    else:
        # A number is stated, so that tasks are dealt folders and not united by their few bytes.
        dealt = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("folder"), spread).sortWithinPartitions("folder")
        dealt.mapInArrow(_write_folders(root), "folder string, file string").write.parquet(f"{path}/_files")
    return path


def read_folders(spark, path: str, schema: str) -> DataFrame:
    """The rows that `evidence_folders` wrote: tasks open the files it listed, so the driver lists no folder; else Spark's own reader."""
    try:
        files = spark.read.schema("folder string, file string").parquet(f"{path}/_files")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.schema(schema).parquet(path)
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_read_files(StructType.fromDDL(schema).fieldNames()), schema)


def row_hash(columns: list[str]) -> Column:
    """A hash of named cells: JSON keeps names, nulls and separators apart, so different rows never read alike."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def hash_lanes(hash_: str) -> list[Column]:
    """The four quarters of a hash as whole numbers of 64 bits."""
    return [F.conv(F.substring(hash_, 1 + 16 * n, 16), 16, -10).cast("bigint") for n in range(4)]


def lane_sum(lanes: list[Column]) -> Column:
    """Order-free digest of many hashes in constant state: their number and the sums of all four quarters of each.

    A quarter is added up as pieces of 24, 24 and 16 bits, whole numbers that no count of rows below 2^39 carries over.
    """
    told = []
    for lane in lanes:
        high, middle, low = F.shiftrightunsigned(lane, 40), F.shiftrightunsigned(lane, 16).bitwiseAND(0xFFFFFF), lane.bitwiseAND(0xFFFF)
        sums = [F.sum(piece).cast("decimal(20,0)") for piece in (high, middle, low)]
        told.append((sums[0] * F.lit(1 << 40).cast("decimal(13,0)") + sums[1] * F.lit(1 << 16).cast("decimal(5,0)") + sums[2]).cast("decimal(38,0)").cast("string"))
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *told), 256)


def hash_sum(hash_: str) -> Column:
    """`lane_sum` of a column of hashes."""
    return lane_sum(hash_lanes(hash_))


def table_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-09: digest of a set of rows in constant state.

    Sums do not depend on the order of rows or tasks, so the digest is the same on any cluster.
    """
    return df.withColumn("_row", row_hash(sorted(c for c in df.columns if c not in keys))).groupBy(*keys).agg(F.count("*").alias("rows"), hash_sum("_row").alias("digest"))


def ordinals(manifest: DataFrame) -> DataFrame:
    """Manifest ordinals must be 1..n per packet."""
    return manifest.groupBy("packet_id").agg(F.count("*").alias("entries"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.countDistinct("ordinal").alias("distinct")).withColumn(
        "contiguous", (F.col("low") == 1) & (F.col("high") == F.col("entries")) & (F.col("distinct") == F.col("entries")))


def company_slice(entries: DataFrame, plan: DataFrame, holding_id: str) -> DataFrame:
    """SNK-11: every entry is in the folder of one company or withheld; nothing falls between.

    ``plan`` is the packet's path plan (packet_id, holding_id, directory); an entry is a company's if its path lies in that
    company's folder, so a company whose name begins another's is not taken for it.
    """
    mine = plan.filter(F.col("holding_id") == holding_id).select("packet_id", "directory")
    inside = F.startswith(F.col("path"), F.concat(F.col("directory"), F.lit("/")))
    return entries.join(mine, "packet_id", "left").withColumn("part", F.when(F.coalesce(inside, F.lit(False)), "present").otherwise("withheld"))


def scope_note(sliced: DataFrame) -> DataFrame:
    """What a slice is and is not, from its own counts, per packet."""
    counted = sliced.groupBy("packet_id", "directory").agg(F.count_if(F.col("part") == "present").alias("present"), F.count_if(F.col("part") == "withheld").alias("withheld"))
    said = F.concat(F.lit("This is part of packet "), "packet_id", F.lit(": "), F.col("present").cast("string"), F.lit(" of its "), (F.col("present") + F.col("withheld")).cast("string"),
                    F.lit(" files, those in "), F.coalesce("directory", F.lit("no folder")), F.lit(". The other "), F.col("withheld").cast("string"),
                    F.lit(" are withheld, not absent; no total of the packet can be checked from this part."))
    return counted.withColumn("note", said)


def publish(spark, tables: dict[str, DataFrame], checks: dict[str, DataFrame], target: str) -> int:
    """SNK-07: write every table to a folder of this version, run every check on what was written, and only then commit.

    ``checks`` take the written tables by name and must come back empty; one that does not commits nothing. A commit is a
    record (version, folder, tables, token) appended below the target; nothing is moved or overwritten, so it needs no rename that
    an object store does not have. Readers follow the latest record: a run that fails, or dies between writing and
    committing, leaves them the version they had. Of two writers that commit one version, the lesser token counts.
    """
    version = (committed(spark, target).agg(F.max("version")).first()[0] or 0) + 1
    token = uuid.uuid4().hex
    folder = f"versions/{version}-{token}"
    for name, df in tables.items():
        df.write.parquet(f"{target}/{folder}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{target}/{folder}/{name}") for name, df in tables.items()}
    failed = [name for name, check in checks.items() if not check(written).isEmpty()]
    if failed:
        raise ValueError(f"not published, failing checks: {', '.join(sorted(failed))}")
    record = spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.array(*map(F.lit, sorted(tables))).alias("tables"), F.lit(token).alias("token"))
    record.coalesce(1).write.mode("append").parquet(f"{target}/commits")
    if published(spark, target).folder != folder:
        raise ValueError(f"version {version} of {target} was committed by another writer")
    return version


def committed(spark, target: str) -> DataFrame:
    """The commit records below a target, one for each version; none where nothing was ever committed."""
    schema = "version int, folder string, tables array<string>, token string"
    try:
        records = spark.read.schema(schema).parquet(f"{target}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        records = spark.createDataFrame([], schema)
    return records.groupBy("version").agg(F.min(F.struct("token", "folder", "tables")).alias("first")).select("version", "first.folder", "first.tables", "first.token")


def published(spark, target: str, version: int | None = None) -> Row:
    """The record of the latest version (or of one version) and, by ``read_published``, its tables."""
    records = committed(spark, target)
    found = (records if version is None else records.filter(F.col("version") == version)).orderBy(F.desc("version")).head()
    if found is None:
        raise ValueError(f"nothing is published at {target}" if version is None else f"{target} has no version {version}")
    return found


def read_published(spark, target: str, table: str, schema, version: int | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/{published(spark, target, version).folder}/{table}")


def differing_claims(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """SNK-13: declared reliance against stored claims; anything on one side only refuses the write."""
    keys = ["claim_id", "requirement"]
    d, s = declared.select(*keys).withColumn("declared", F.lit(True)), stored.select(*keys).withColumn("stored", F.lit(True))
    return d.join(s, keys, "full").filter("declared IS NULL OR stored IS NULL")


def assessment_tables(outcomes: DataFrame, links: DataFrame, policy_version: str) -> dict[str, DataFrame]:
    """SNK-12: the stored shape of an assessment run: requirement rows, assessments and evidence links."""
    requirement_id = F.concat_ws("/", "holding_id", "period_id", "requirement")
    requirements = outcomes.select(requirement_id.alias("requirement_id"), "holding_id", "period_id", "requirement", (F.col("verdict") != "not_applicable").alias("applicable"))
    assessments = outcomes.select(requirement_id.alias("requirement_id"), "verdict", "reasons", "next_actions", F.lit(policy_version).alias("policy_version"))
    evidence = links.select(requirement_id.alias("requirement_id"), "claim_id", "is_subsequent")
    return {"requirement": requirements, "assessment": assessments, "evidence_link": evidence}
