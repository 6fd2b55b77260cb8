"""Append-only logs as Structured Streaming jobs.

What must be known of all earlier batches (which keys, versions and contents are held) is keyed state in RocksDB, beside the
checkpoint of the stream: a batch reads and writes the state of its own keys, so its work does not grow with the log. Sinks
are Spark's file sink, which lists a batch once however often it is replayed, or folders named by the batch id.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestor.operators import packets, temporal
from attestor.operators.rules import Assessment
from attestor.sources.ledger import Ledger, of_holdings
from attestor.sources.publish import staged_copy, staging_path

#: Where keyed state lives, and that a batch uploads its changes and not the whole store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_starting = threading.Lock()


def run_to_end(stream: DataFrame, name: str, write, mode: str = "append") -> str:
    """Drain what has arrived and stop; the checkpoint lies beside the output in the shared folder."""
    root = staging_path(stream.sparkSession, f"stream-{name}")
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda batch, batch_id: write(batch, batch_id, f"{root}/log"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{root}/log"


def log_to_end(stream: DataFrame, root: str):
    """Drain a stream with keyed state into ``root``/log by the file sink; started again, it goes on where it stopped."""
    conf = stream.sparkSession.conf
    with _starting:  # a query takes the settings that hold when it starts
        before = {key: conf.get(key, None) for key in STATE_STORE}
        try:
            for key, value in STATE_STORE.items():
                conf.set(key, value)
            query = stream.writeStream.format("parquet").option("path", f"{root}/log").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
    query.awaitTermination()
    return query


def append_batch(batch: DataFrame, batch_id: int, log: str) -> None:
    """Overwriting the folder of this batch id makes a replay harmless."""
    batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")


def store_events(events: DataFrame) -> DataFrame:
    """STR-01: one event per run and idempotency key, for ever.

    No watermark bounds how late an event or its repetition may be; the state is one entry a key, and a batch looks up its own
    keys. A null counts as a value.
    """
    return events.dropDuplicates(["run_id", "idempotency_key"])


def versions(arrivals: DataFrame) -> DataFrame:
    """First half of STR-02, keyed by document: `first` content of an id, the same `again`, or another (`collision`).

    An id has one version for ever: the stored one, or within its first batch the least content hash.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hashes: set[str] = set()
        for frame in frames:
            hashes.update(frame["content_hash"])
        known = state.exists
        version = state.get[0] if known else min(hashes)
        if not known:
            state.update((version,))
        told = [(key[0], h, "collision" if h != version else "again" if known else "first") for h in sorted(hashes)]
        yield pd.DataFrame(told, columns=["document_id", "content_hash", "seen"])

    keyed = arrivals.filter("document_id IS NOT NULL AND content_hash IS NOT NULL").select("document_id", "content_hash").groupBy("document_id")
    return keyed.applyInPandasWithState(step, "document_id string, content_hash string, seen string", "version string", "append", GroupStateTimeout.NoTimeout)


def arrivals(seen: DataFrame) -> DataFrame:
    """Second half of STR-02, keyed by content: content is `new` once, for the least id of the batch that brings it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, rest = state.exists, None, []
        for frame in frames:
            for document, seen_as in zip(frame["document_id"], frame["seen"], strict=True):
                if seen_as == "collision":
                    rest.append((document, "collision"))
                elif held or seen_as == "again":
                    rest.append((document, "already_stored"))
                elif first is None or document < first:
                    if first is not None:
                        rest.append((first, "already_stored"))
                    first = document
                else:
                    rest.append((document, "already_stored"))
                if len(rest) >= 10_000:
                    yield _told(rest, key[0])
                    rest = []
        if first is not None:
            state.update((first,))
            rest.append((first, "new"))
        if rest:
            yield _told(rest, key[0])

    return seen.groupBy("content_hash").applyInPandasWithState(
        step, "document_id string, content_hash string, arrival string", "first_id string", "append", GroupStateTimeout.NoTimeout)


def _told(rows: list[tuple[str, str]], content_hash: str) -> pd.DataFrame:
    return pd.DataFrame([(document, content_hash, arrival) for document, arrival in rows], columns=["document_id", "content_hash", "arrival"])


def store_documents(documents: DataFrame, root: str) -> DataFrame:
    """STR-02: new content is appended, content already held is told, the same id with other content is reported.

    Two streams, one keyed by document and one by content; the file sink between them hands every row on once. Returns the log:
    document_id, content_hash, arrival.
    """
    spark = documents.sparkSession
    log_to_end(versions(documents), f"{root}/versions")
    seen = spark.readStream.schema("document_id string, content_hash string, seen string").parquet(f"{root}/versions/log")
    log_to_end(arrivals(seen), f"{root}/arrivals")
    return spark.read.schema("document_id string, content_hash string, arrival string").parquet(f"{root}/arrivals/log")


def latest_decisions(batch: DataFrame, batch_id: int, log: str) -> None:
    """STR-03: each batch appends its latest decision per mark; readers take the latest over the log."""
    rows = batch.filter("mark_id IS NOT NULL").select("mark_id", "decision_id", "decided_at", "status")
    append_batch(temporal.latest(rows, ["mark_id"], "decided_at", "decision_id"), batch_id, log)


def current_decisions(log: DataFrame) -> DataFrame:
    return temporal.latest(log.select("mark_id", "decision_id", "decided_at", "status"), ["mark_id"], "decided_at", "decision_id")


def reprint(now: Ledger, approvals: DataFrame, moved: DataFrame, policy_version: str) -> DataFrame:
    """The prints that a change can have moved, and whether each approval on them still rests on what it was given on.

    ``moved``: (holding_id, period_id); a null period means every date of the holding, as for a claim or a lot. Only the ledger's
    rows of these holdings are assessed, and only approvals at these dates are compared: holdings are assessed by themselves,
    so their prints are those of the whole ledger. What moved and the frames that the rules share are written once per batch.
    """
    touched = staged_copy(moved.distinct(), "moved")
    holdings = touched.select("holding_id").distinct()
    prints = packets.approval_fingerprints(Assessment(of_holdings(now, holdings), store=staged_copy), policy_version)
    at = approvals.join(touched.withColumnRenamed("period_id", "_period"), "holding_id").filter("_period IS NULL OR _period = period_id").drop("_period").distinct()
    return packets.stale_approvals(at, prints)


def moving_prints(ledger: Callable[[], Ledger], approvals: DataFrame, policy_version: str):
    """STR-04: for a stream of changes (holding_id, period_id?), append the approvals whose print each batch of them has moved.

    ``ledger`` gives the ledger as it stands when the batch is handled; ``approvals``: decision_id, holding_id, period_id, recorded. An
    approval is listed with its print of that batch, `current` or not, so a change that is taken back makes it current again.
    """

    def write(batch: DataFrame, batch_id: int, log: str) -> None:
        told = reprint(ledger(), approvals, batch.select("holding_id", "period_id"), policy_version)
        append_batch(told.select("decision_id", "holding_id", "period_id", "fingerprint", "current"), batch_id, log)

    return write


def stale_now(log: DataFrame) -> DataFrame:
    """The approvals whose latest print in the log is not the recorded one."""
    last = log.groupBy("decision_id").agg(F.max_by(F.struct("holding_id", "period_id", "fingerprint", "current"), F.col("batch")).alias("last"))
    return last.select("decision_id", "last.*").filter("NOT current").drop("current")
