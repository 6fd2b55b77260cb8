"""Prediction by partial matching over bytes: a frozen context trie with escape estimation and symbol exclusion.

A symbol is 0 (the end of a text, and the filling before its start) or 1 + a byte; an n-gram of ``order + 1`` symbols is
one unsigned 64-bit key, 9 bits a symbol. A trie is the counts of all n-grams up to that length; every shorter count is
the sum over the longer ones. In a context with total T over D distinct symbols a seen symbol has n / (T + D), and the
escape D / (T + D); after an escape the symbols of the longer context are left out of T and D of the shorter one. Below
the empty context every symbol not yet left out is equally likely.
"""

from __future__ import annotations

import copy
import math
from collections import defaultdict

import numpy as np

BITS = np.uint64(9)
SYMBOLS = 257


def grams(data: np.ndarray, offsets: np.ndarray, order: int, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key of every byte (and of the end) of each text, and the first key of each text with the total."""
    lengths = np.diff(offsets)
    gap = order + 1
    n = len(lengths)
    symbols = np.zeros(len(data) + gap * n + order, np.uint64)
    place = np.repeat(np.arange(n, dtype=np.int64) * gap + order, lengths) + np.arange(len(data), dtype=np.int64)
    symbols[place] = data.astype(np.uint64) + np.uint64(1)
    total = len(symbols) - order
    keys = symbols[:total].copy()
    for j in range(1, order + 1):
        keys <<= BITS
        keys |= symbols[j : j + total]
    if ends:
        bounds = offsets + np.arange(n + 1)
        wanted = np.repeat(np.arange(n, dtype=np.int64) * order, lengths + 1) + np.arange(len(data) + n, dtype=np.int64)
    else:
        bounds = offsets.copy()
        wanted = place - order
    return keys[wanted], bounds


def mask(symbols: int) -> np.uint64:
    """The bits of the last so many symbols of a key."""
    return np.uint64((1 << (9 * symbols)) - 1)


class Slots:
    """Exact positions of 64-bit keys: three rounds of hashed slots, then a sorted rest. Built once, read vectorised."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.rounds = []
        left = np.arange(len(keys), dtype=np.int32)
        for multiplier in self.MULTIPLIERS:
            shift = 64 - max(4, len(left).bit_length() + 1)
            held = np.full(1 << (64 - shift), -1, np.int32)
            slot = self._slot(keys[left], multiplier, shift)
            held[slot] = left
            self.rounds.append((multiplier, shift, held))
            left = left[held[slot] != left]
        order = np.argsort(keys[left], kind="stable")
        self.rest, self.rest_at = keys[left][order], left[order]

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: int, shift: int) -> np.ndarray:
        return ((keys * np.uint64(multiplier)) >> np.uint64(shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        open_ = None
        for multiplier, shift, held in self.rounds:
            asked = keys if open_ is None else keys[open_]
            at = held[self._slot(asked, multiplier, shift)]
            hit = (at >= 0) & (self.keys[at] == asked)
            if open_ is None:
                out[hit] = at[hit]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.rest_at[at[hit]]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Whole counts in 32 bits where they fit, so that a model takes less room; lookups turn them to floats again."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


class Trie:
    """Frozen statistics of one corpus. ``levels``: for each length from 1 the distinct n-gram keys in order and their counts;
    a level may leave out rare n-grams if every longer level does so too."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.nodes = [(np.asarray(keys, np.uint64), _narrow(np.asarray(counts))) for keys, counts in levels]
        self.contexts = []
        for k, (node, n) in enumerate(self.nodes):
            context, at = np.unique(node >> BITS, return_inverse=True)
            total, distinct = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context)).astype(np.float64)
            if k:
                # What is left of the next shorter context once this one's symbols are left out.
                parent = _find(self.contexts[k - 1][0], context & mask(k - 1))
                shorter = self.nodes[k - 1][1][_find(self.nodes[k - 1][0], node & mask(k))]
                rest = self.contexts[k - 1][1][parent] - np.bincount(at, shorter, len(context))
                rest_distinct = self.contexts[k - 1][2][parent] - distinct
            else:
                rest = rest_distinct = np.zeros(len(context))
            self.contexts.append((context, *map(_narrow, (total, distinct, rest, rest_distinct))))

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Trie:
        """From counts of the longest n-grams alone: shorter counts are their sums."""
        levels = []
        for k in range(order + 1):
            own, at = np.unique(np.asarray(keys, np.uint64) & mask(k + 1), return_inverse=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, at, np.asarray(counts, np.int64))
            levels.append((own, sums))
        return cls(levels)

    def without_longest(self) -> Trie:
        """The trie for n-grams that it does not have: all but the longest n-grams themselves."""
        out = copy.copy(self)
        out.nodes = [*self.nodes[:-1], (np.empty(0, np.uint64), np.empty(0, np.uint32))]
        return out

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The exact code length of the last symbol of each key in the context before it."""
        keys = np.asarray(keys, np.uint64)
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        left_total = np.full(len(keys), np.nan)
        left_distinct = np.full(len(keys), np.nan)
        for k in range(self.order, -1, -1):
            if not len(open_):
                return out
            own = keys[open_]
            context, total, distinct, rest, rest_distinct = self.contexts[k]
            at = _find(context, (own >> BITS) & mask(k))
            seen = at >= 0
            t = np.where(np.isnan(left_total[open_]), np.where(seen, total[at] if len(total) else 0, 0), left_total[open_])
            d = np.where(np.isnan(left_distinct[open_]), np.where(seen, distinct[at] if len(distinct) else 0, 0), left_distinct[open_])
            node, n = self.nodes[k]
            hit = _find(node, own & mask(k + 1))
            found = (hit >= 0) & seen
            out[open_[found]] += np.log2((t + d)[found] / n[hit[found]])
            escaped = seen & ~found & (d > 0)
            out[open_[escaped]] += np.log2((t + d)[escaped] / d[escaped])
            at, miss = at[~found], seen[~found]
            open_ = open_[~found]
            left_total[open_] = np.where(miss, rest[at] if len(rest) else 0, np.nan)
            left_distinct[open_] = np.where(miss, rest_distinct[at] if len(rest) else 0, np.nan)
        known = self.contexts[0][2][0] if len(self.contexts[0][0]) else 0
        out[open_] += math.log2(max(SYMBOLS - known, 1))
        return out


class Scorer:
    """Code lengths of texts under several tries at once: a table for all seen n-grams, back-off for the others."""

    def __init__(self, tries: list[Trie]):
        self.order = tries[0].order
        keys = tries[0].nodes[-1][0] if len(tries) == 1 else np.unique(np.concatenate([t.nodes[-1][0] for t in tries]))
        self.slots = Slots(keys)
        self.table = np.zeros((max(1, len(keys)), len(tries)))
        for a in range(0, len(keys), 1 << 16):
            for j, trie in enumerate(tries):
                self.table[a : a + (1 << 16), j] = trie.bits(keys[a : a + (1 << 16)])
        # The longest n-grams of all tries are in the table; an n-gram that is not there is in none of them.
        self.tries = [trie.without_longest() for trie in tries]

    def texts(self, data: np.ndarray, offsets: np.ndarray, ends: bool = True) -> np.ndarray:
        """Bits of each text (rows) under each trie (columns)."""
        keys, bounds = grams(data, offsets, self.order, ends)
        out = np.zeros((len(offsets) - 1, len(self.tries)))
        if not len(keys):
            return out
        at = self.slots.find(keys)
        cost = self.table[np.maximum(at, 0)]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            own, back = np.unique(keys[missed], return_inverse=True)
            cost[missed] = np.stack([t.bits(own) for t in self.tries], axis=1)[back]
        full = np.flatnonzero(np.diff(bounds) > 0)
        out[full] = np.add.reduceat(cost, bounds[full], axis=0)
        return out


def adaptive_bits(text: bytes, order: int) -> float:
    """The code length of one text under a trie that starts empty and learns each symbol after coding it."""
    trie: dict[bytes, dict[int, int]] = defaultdict(dict)
    bits = 0.0
    history = b""
    for symbol in [*text, 256]:
        left_out: set[int] = set()
        for k in range(min(order, len(history)), -1, -1):
            table = {s: n for s, n in trie.get(history[len(history) - k :], {}).items() if s not in left_out}
            total, distinct = sum(table.values()), len(table)
            if symbol in table:
                bits += math.log2((total + distinct) / table[symbol])
                break
            if distinct:
                bits += math.log2((total + distinct) / distinct)
                left_out |= table.keys()
        else:
            bits += math.log2(SYMBOLS - len(left_out))
        for k in range(min(order, len(history)) + 1):
            table = trie[history[len(history) - k :]]
            table[symbol] = table.get(symbol, 0) + 1
        if symbol < 256:
            history = (history + bytes([symbol]))[-order:] if order else b""
    return bits
