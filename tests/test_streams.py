"""Streams whose batches arrive one by one, late, repeated and replayed."""

import dataclasses
import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from attestor.operators import packets, rules
from attestor.sources.derived import DerivedFrames
from attestor.sources.ledger import from_derived
from attestor.streaming import streams

EVENT = "run_id string, idempotency_key string, occurred_at timestamp"
DOCUMENT = "document_id string, content_hash string"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def event(run, key, month):
    return run, key, datetime.datetime(2024, month, 1)


def run_events(spark, folder, root):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = streams.log_to_end(streams.store_events(stream), str(root))
    return query, sorted(((r.run_id, r.idempotency_key) for r in spark.read.schema(EVENT).parquet(f"{root}/log").collect()), key=repr)


def test_a_key_is_stored_once_however_late_it_comes_again(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    arrive(spark, folder, [event("r", "k", 6), event("r", "k", 7), event("r", None, 1)], EVENT)
    run_events(spark, folder, root)
    arrive(spark, folder, [event("r", "k", 12), event("r", "l", 1), event("s", "k", 2), event("r", None, 3)], EVENT)
    _, got = run_events(spark, folder, root)
    assert sorted(got, key=repr) == sorted([("r", "k"), ("r", None), ("r", "l"), ("s", "k")], key=repr)


def test_a_batch_reads_its_own_rows_and_state_only(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    for batch in range(6):
        arrive(spark, folder, [event("r", f"k{batch}-{n}", 1) for n in range(50)], EVENT)
        query, got = run_events(spark, folder, root)
    assert len(got) == 300
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    state = last["stateOperators"][0]
    # The state holds every key; the batch that added fifty looked up fifty.
    assert state["numRowsTotal"] == 300 and last["numInputRows"] == 50 and state["numRowsUpdated"] == 50
    assert state["customMetrics"]["rocksdbGetCount"] <= 2 * 50


def replay_last(root):
    """As if the stream had died after its batch was written and before it was committed."""
    commits = sorted((p for p in (pathlib.Path(root) / "checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    crc.unlink(missing_ok=True)


def test_a_replayed_batch_stores_nothing_twice(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    arrive(spark, folder, [event("r", "a", 1)], EVENT)
    run_events(spark, folder, root)
    arrive(spark, folder, [event("r", "a", 2), event("r", "b", 2)], EVENT)
    _, first = run_events(spark, folder, root)
    replay_last(root)
    _, second = run_events(spark, folder, root)
    assert first == second == [("r", "a"), ("r", "b")]


def documents_of(spark, folder, root):
    stream = spark.readStream.schema(DOCUMENT).parquet(str(folder))
    return sorted(map(tuple, streams.store_documents(stream, str(root)).collect()))


def test_documents_batch_by_batch(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    arrive(spark, folder, [("a", "h2"), ("a", "h1"), ("b", "h1"), (None, "h5"), ("z", None)], DOCUMENT)
    want = [("a", "h1", "new"), ("a", "h2", "collision"), ("b", "h1", "already_stored")]
    assert documents_of(spark, folder, root) == sorted(want)
    arrive(spark, folder, [("a", "h2"), ("a", "h1"), ("b", "h7"), ("c", "h1"), ("e", "h3"), ("d", "h3")], DOCUMENT)
    want += [("a", "h1", "already_stored"), ("a", "h2", "collision"), ("b", "h7", "collision"), ("c", "h1", "already_stored"), ("d", "h3", "new"), ("e", "h3", "already_stored")]
    assert documents_of(spark, folder, root) == sorted(want)
    for half in ("versions", "arrivals"):
        replay_last(root / half)
        assert documents_of(spark, folder, root) == sorted(want)


def test_many_copies_of_one_content_in_one_batch(spark, tmp_path):
    arrive(spark, tmp_path / "in", [(f"d{n:05d}", "same") for n in range(25_000)], DOCUMENT)
    got = documents_of(spark, tmp_path / "in", tmp_path / "out")
    assert len(got) == 25_000 and [r for r in got if r[2] == "new"] == [("d00000", "same", "new")]


@pytest.fixture(scope="module")
def ledger(spark):
    return from_derived(DerivedFrames(spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def prints(spark, ledger, tmp_path_factory):
    """Prints of three holdings, taken from an assessment of the whole ledger."""
    path = str(tmp_path_factory.mktemp("prints") / "prints")
    whole = packets.approval_fingerprints(rules.Assessment(ledger), "policy-1").filter("holding_id IN ('h1', 'h4', 'h25')")
    whole.select("holding_id", "period_id", "fingerprint").write.parquet(path)
    return spark.read.parquet(path)


def test_prints_of_some_holdings_are_those_of_the_whole_ledger(spark, ledger, prints):
    want = {(r.holding_id, r.period_id): r.fingerprint for r in prints.collect()}
    moved = spark.createDataFrame([("h1",), ("h4",), ("h25",)], "holding_id string")
    part = packets.approval_fingerprints(rules.Assessment(streams.of_holdings(ledger, moved)), "policy-1")
    assert want and {(r.holding_id, r.period_id): r.fingerprint for r in part.collect()} == want


def test_a_change_that_is_taken_back_makes_the_approval_current_again(spark, ledger, prints, tmp_path):
    held = sorted(prints.filter("holding_id <> 'h25'").collect())
    approvals = spark.createDataFrame([(n, r.holding_id, r.period_id, r.fingerprint) for n, r in enumerate(held)], "decision_id bigint, holding_id string, period_id string, recorded string")
    target = min(n for n, r in enumerate(held) if r.holding_id == "h1")
    period = held[target].period_id
    other = F.when((F.col("holding_id") == "h1") & (F.col("period_id") == period), F.col("reported_amount") + 1).otherwise(F.col("reported_amount"))
    changed = dataclasses.replace(ledger, mark=ledger.mark.withColumn("reported_amount", other.cast("decimal(24,4)")))
    change = spark.createDataFrame([("h1", period), ("h4", None)], "holding_id string, period_id string")
    log = str(tmp_path / "log")
    for batch_id, now in enumerate((changed, ledger)):
        streams.moving_prints(lambda now=now: now, approvals, "policy-1")(change, batch_id, log)
        stale = {r.decision_id for r in streams.stale_now(spark.read.parquet(log)).collect()}
        assert stale == ({target} if batch_id == 0 else set())
