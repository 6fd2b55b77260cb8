"""Sum-of-squares online packing: documents become sequences of token windows as they stream by.

A document is its token ids and one end id. Whole windows are cut off it first; the rest goes to the fill level that makes
the sum, over all levels, of the squared number of windows at that level least (a new window is level 0; ties take the
fullest level). Only the level array and the windows still open are held, at most ``open_windows`` of them: where the rule
asks for one more, the best open level that holds the rest takes it, and if none does, the fullest window is closed by the
head of the document and the tail is placed anew. At the end of a stream the emptiest open windows are cut up to fill the
fullest; the one window left is dealt out to sequences whose lengths are powers of two, which need no padding. So no
sequence holds padding, and few documents are cut.

A stream is one partition as Spark deals it: a task holds ``open_windows`` windows whatever its input, nothing is shuffled,
and a lost executor's partitions are packed anew. Sequence ids begin with the partition's number; they say which pieces
lie together and nothing more, and another partitioning packs other documents together.

Defined cases: a null or empty text is one piece of one id (the end). Repeated rows and null ids are packed one by one.
An empty table gives no rows. Other columns are ignored, whatever their names. A text is held whole, with its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestor.llm import texts
from attestor.llm.wordids import default_vocabulary, word_ids

CAPACITY = 4096
END_ID = 2
OPEN_WINDOWS = 64
CHUNK_BYTES = 1 << 19
OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def chosen(levels: np.ndarray, size: int, room_for_new: bool = True) -> int:
    """The level from which a piece of ``size`` makes the squared counts least; 0: a new window, -1: none holds it.

    ``levels[h]`` counts the open windows filled to h; the last index is the capacity, whose windows are closed.
    """
    capacity = len(levels) - 1
    here = levels[1 : capacity - size + 1]
    # A window leaves level h and comes to h + size: the sum changes by 1 - 2 n(h) and by 1 + 2 n(h + size), if that is not full.
    change = 2 * (levels[1 + size :] - here) + 2
    if len(change):
        change[-1] = 1 - 2 * here[-1]
    change = np.where(here > 0, change, np.iinfo(np.int64).max)
    best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
    held = best >= 0 and here[best] > 0
    if room_for_new and not (held and change[best] <= 1 + 2 * levels[size]):
        return 0
    return best + 1 if held else -1


class Stream:
    """Windows being filled. ``closed`` has a (owner, start, length, crc, tokens of the document, sequence, offset) row a piece."""

    def __init__(self, capacity: int, open_windows: int, first_sequence: int):
        self.capacity, self.most, self.next = capacity, open_windows, first_sequence
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.open, self.closed = 0, []

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for owner, tokens, start, ids in window:
            self.closed.append((owner, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def _put(self, level: int, piece: tuple) -> None:
        """One more piece into a window of ``level``."""
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        level += len(piece[3]) // 4
        if level == self.capacity:
            self.open -= 1
            self._close(window)
        else:
            self.windows.setdefault(level, []).append(window)
            self.levels[level] += 1

    def add(self, owner, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= self.capacity:
            self._close([(owner, tokens, start, ids[4 * start : 4 * (start + self.capacity)])])
            start += self.capacity
        while start < tokens:
            size = tokens - start
            level = chosen(self.levels, size, self.open < self.most)
            if level < 0:
                level = int(np.flatnonzero(self.levels)[-1])
                size = self.capacity - level
            self._put(level, (owner, tokens, start, ids[4 * start : 4 * (start + size)]))
            start += size

    def finish(self) -> None:
        """Close what is open: the fullest are filled from the emptiest, the last is dealt out in powers of two."""
        rest = [(level, window) for level, windows in sorted(self.windows.items(), reverse=True) for window in windows]
        while len(rest) > 1:
            level, window = rest.pop(0)
            while level < self.capacity and rest:
                last, donor = rest[-1]
                piece, left = _split(donor.pop(), self.capacity - level)
                if left:
                    donor.append(left)
                moved = len(piece[3]) // 4
                window.append(piece)
                level += moved
                rest[-1] = (last - moved, donor)
                if last == moved:
                    rest.pop()
            if level == self.capacity:
                self._close(window)
            else:
                rest = [(level, window)]
        for level, window in rest:
            queue = window[::-1]
            for power in range(level.bit_length() - 1, -1, -1):
                if level >> power & 1:
                    room, dealt = 1 << power, []
                    while room:
                        piece, left = _split(queue.pop(), room)
                        if left:
                            queue.append(left)
                        dealt.append(piece)
                        room -= len(piece[3]) // 4
                    self._close(dealt)
        self.windows, self.open = {}, 0
        self.levels[:] = 0


def _split(piece: tuple, room: int) -> tuple[tuple, tuple | None]:
    """The first ``room`` ids of a piece, and the piece of the ids behind them, if any."""
    owner, tokens, start, ids = piece
    if len(ids) <= 4 * room:
        return piece, None
    return (owner, tokens, start, ids[: 4 * room]), (owner, tokens, start + room, ids[4 * room :])


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    vocabulary = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in OUT)])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        stream = Stream(capacity, open_windows, TaskContext.get().partitionId() << 33)
        kind = None

        def out() -> pa.RecordBatch:
            owners, *columns = zip(*stream.closed, strict=True)
            stream.closed = []
            return pa.RecordBatch.from_arrays([pa.array(owners, kind), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *OUT])

        for batch in batches:
            kind = batch.column("doc_id").type
            owners = batch.column("doc_id").to_pylist()
            for a, _, data, offsets in texts.chunks(batch.column("text"), CHUNK_BYTES):
                ids, bounds = ids_of.encode(data, offsets)
                for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    stream.add(owners[a + i], ids[low:high].astype("<u4").tobytes() + end)
                if stream.closed:
                    yield out()
        stream.finish()
        if stream.closed:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
