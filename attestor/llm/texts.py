"""Texts as bytes: chunks of an Arrow column, vectorised word hashes and 5-word shingles.

All functions work on UTF-8 bytes, because lowering A-Z and cutting at ASCII white space give the same words on bytes as
on code points. A null text is read as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def fold(doc_id: Column | str, parts: int) -> Column:
    """The fold of a document: crc32 of its id written as text, modulo ``parts``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % parts


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) of runs of whole texts of about ``limit`` bytes."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, after, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def tidied(run):
    """``run`` over Arrow batches, giving back to the system what its task no longer uses: workers live on for other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers[:] = np.ones(0, np.uint64), np.ones(0, np.uint64)
            give_back()

    return wrapped


def give_back() -> None:
    """Hands memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums become evenly spread keys."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for slot, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[slot] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``, cut where a text ends."""
    n = len(inside)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    opens[cuts] |= inside[cuts]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    closes[lasts] |= inside[lasts]
    return starts, np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, by sums of byte values times powers of an odd base."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP[7])


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`, by default after lowering A-Z: (64-bit hash, start, end, first word of each text and the
    total). ``space``: 256 flags, the bytes that separate words."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    data = _LOWER[data] if lower else data
    starts, ends = spans(~space[data], offsets)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


class Tally:
    """Counts of 64-bit keys within a task; hands them over whenever ``limit`` distinct keys are held."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.keys, self.counts, self.size = limit, [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        own, n = np.unique(keys, return_counts=True)
        self.keys.append(own)
        self.counts.append(n.astype(np.int64))
        self.size += len(own)
        if self.size > self.limit:
            self.merge()
        return self.size > self.limit // 2

    def merge(self) -> None:
        if len(self.keys) > 1:
            own, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, at, np.concatenate(self.counts))
            self.keys, self.counts, self.size = [own], [n], len(own)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size``: the whole sequence is the one shingle."""
    hashes, _, _, bounds = words(data, offsets)
    run = max(0, len(hashes) - size + 1)
    sums = np.zeros(run, np.uint64)
    for j in range(size):
        sums += hashes[j : j + run] * _STEP[j]
    sums = mixed(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(sums[a : b - size + 1]))
        elif b > a:
            part = (hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + _STEP[6] * np.array([b - a], np.uint64)
            out.append(mixed(part))
        else:
            out.append(np.empty(0, np.uint64))
    return out
