"""Best-fit packing by minimum bin slack: documents become token pieces, pieces are packed into sequences of fixed capacity.

A document is its token ids and one end id. Only a document longer than the capacity is cut, into full pieces and a
rest. Full pieces are sequences of their own. For all others only the number of pieces of each length matters, a
histogram with fewer entries than the capacity: the driver takes the longest length left, finds by a bitset of reachable
sums over the lengths left the combination that fills its sequence most, and uses that combination as often as the counts
allow. Each combination exhausts a length, so the plan has at most ``capacity`` combinations whatever the input. Spark numbers
the pieces of each length (in salted slices, so a very common length is not one task) and reads their places off the plan.

Defined cases: a null or empty text is one piece of one id (the end). Repeated rows and null ids are packed one by one.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import texts
from attestor.llm.wordids import WordIds, default_vocabulary
from attestor.session import cut_lineage

CAPACITY = 4096
END_ID = 1
CHUNK_BYTES = 1 << 19
ROWS_PER_SLICE = 5_000


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """row (a number of its own), doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    vocabulary = vocabulary or default_vocabulary()
    kinds = [T.StructField(c, t()) for c, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType))]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *kinds])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(vocabulary)  # for this task alone: workers of a pipeline live on, and the table would too
        for batch in batches:
            for a, _, data, offsets in texts.chunks(batch.column("text"), CHUNK_BYTES):
                ids, bounds = ids_of.encode(data, offsets)
                owner, piece, start, length, crc = [], [], [], [], []
                for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = ids[low:high].tobytes() + end
                    for k in range(0, len(own), 4 * capacity):
                        part = own[k : k + 4 * capacity]
                        owner.append(a + i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [f.name for f in schema.fields])

    return docs.select("doc_id", "text").mapInArrow(texts.tidied(run), schema).withColumn("row", F.monotonically_increasing_id())


def fullest(counts: list[int], room: int, longest: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes nearest to ``room`` without passing it; long lengths are tried first."""
    reachable = 1
    within = (1 << (room + 1)) - 1
    steps = []
    for length in range(min(room, longest), 0, -1):
        left = min(counts[length], room // length)
        times = 1
        while left:
            times = min(times, left)
            steps.append((reachable, length, times))
            reachable |= (reachable << (length * times)) & within
            left -= times
            times *= 2
        if reachable >> room & 1:
            break
    total = reachable.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= length * times
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, their combination of (length, times)) until every piece has a place."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        rest = dict(fullest(counts, capacity - longest, longest))
        counts[longest] += 1
        combination = {longest: rest.pop(longest, 0) + 1} | rest
        times = min(counts[length] // n for length, n in combination.items())
        for length, n in combination.items():
            counts[length] -= n * times
        out.append((times, list(combination.items())))


def places(planned: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """A row for each length of each combination: length, first rank, first sequence, times in a sequence, offset of the first."""
    rows, ranks, sequence = [], {}, 0
    for sequences, combination in planned:
        offset = 0
        for length, times in combination:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            ranks[length] = rank + times * sequences
            offset += length * times
        sequence += sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = cut_lineage(pieces(docs, vocabulary, capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    counts.pop(capacity, None)
    table = places(plan(counts, capacity))
    slices = max(1, sum(counts.values()) // ROWS_PER_SLICE)
    short = cut.where(F.col("length") < capacity).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = short.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("row")) - 1).join(offsets, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    out = [c for c in ranked.columns if c != "rank"]
    schema = T.StructType([*(ranked.schema[c] for c in out), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            k = rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(table[at, 2] + k // table[at, 3]), pa.array(table[at, 4] + k % table[at, 3] * length)],
                                             [*out, "sequence_id", "offset"])

    full = cut.where(F.col("length") == capacity).select(*out, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, schema).unionByName(full)
