"""Token ids of many texts at once, from a tokenizers file whose tokens never cross white space.

Where the file lower-cases, drops white space and cuts letters, single digits and marks apart (`NORMALIZER`, `CUTS`), the
cuts of a chunk of texts are found on its bytes by numpy, and only cuts not held yet go to the tokenizer, many in one
text with blanks between. A white-space word with any character outside ASCII and the letters U+00C0 to U+024F goes to the
tokenizer whole. A text that holds an added token as it is written, and every text under any other file, is encoded by the
tokenizer alone, so the ids are the tokenizer's own in all cases.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from attestor.llm import texts

SLOTS = 1 << 20
HELD_IDS = 1 << 22

# The normaliser and the cut pattern that `_cuts` finds on bytes.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"

SPACE, LETTER, DIGIT, MARK = range(4)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = LETTER
#: First bytes of characters of which the tables above say nothing.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xC9, 0xF5)]] = True
#: Two-byte characters among the letters that are none, or whose lower case is two characters.
_ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """The tokenizer of a file, and a table of fixed size with the ids of cuts met lately (a later cut takes the slot of an earlier one)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        # Tasks already use every core; threads of the library only add CPU time and memory that stays with each of them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            told = json.load(file)
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.cuts_known = (
            told["normalizer"] == NORMALIZER and len(splits) == 2 and splits[0].get("pattern") == {"Regex": CUTS} and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
            and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex") and told["post_processor"] is None
            and told["model"].get("end_of_word_suffix") == WORD_END and not told["model"].get("dropout") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        )
        self.added = [t["content"].encode() for t in told["added_tokens"]]
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(self.tokenizer.get_vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.places = np.zeros((SLOTS, 2), np.int32)
        self.values, self.held = np.empty(1 << 16, np.uint32), 0

    def _plain(self, own: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]

    def _append(self, ids: np.ndarray) -> None:
        if self.held + len(ids) > len(self.values):
            grown = np.empty(max(2 * len(self.values), self.held + len(ids)), np.uint32)
            grown[: self.held] = self.values[: self.held]
            self.values = grown
        self.values[self.held : self.held + len(ids)] = ids
        self.held += len(ids)

    def _learn(self, fresh: list[bytes], odd: np.ndarray) -> np.ndarray:
        """(first, number) among the held ids of each fresh cut, or odd word."""
        counts = np.zeros(len(fresh), np.int64)
        plain = np.flatnonzero(~odd).tolist()
        order = [*plain, *np.flatnonzero(odd).tolist()]
        first = self.held
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, ids in zip(groups, self._plain([b" ".join([fresh[i] for i in g]).decode() for g in groups]), strict=True):
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == len(group):
                counts[group] = np.diff(last, prepend=-1)
                self._append(ids)
            else:
                self._each(fresh, group, counts)
        self._each(fresh, order[len(plain) :], counts)
        own = counts[order]
        places = np.empty((len(fresh), 2), np.int64)
        places[order, 0], places[order, 1] = first + np.cumsum(own) - own, own
        return places

    def _each(self, fresh: list[bytes], which: list[int], counts: np.ndarray) -> None:
        encoded = self._plain([fresh[i].decode() for i in which])
        for i, ids in zip(which, encoded, strict=True):
            counts[i] = len(ids)
            self._append(ids)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the cuts, and which are odd words; ``data`` has its A-Z lowered."""
        kind = _CLASS[data]
        odd_bytes = _ODD[data]
        for head, tail in _ODD_PAIRS:
            odd_bytes[:-1] |= (data[:-1] == head) & (data[1:] == tail)
        at = np.flatnonzero(odd_bytes)
        odd_starts = np.empty(0, np.int64)
        if len(at):
            starts, ends = texts.spans(kind != SPACE, offsets)
            word = np.unique(np.searchsorted(starts, at, side="right") - 1)
            odd_starts = starts[word]
            change = np.zeros(len(data) + 1, np.int8)
            change[odd_starts] = 1
            change[ends[word]] -= 1
            kind[np.cumsum(change[:-1], dtype=np.int8) > 0] = LETTER
        begins = np.empty(len(data), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= kind != SPACE
        self._contractions(data, kind, begins, offsets)
        lasts = kind != SPACE
        lasts[:-1] &= begins[1:] | (kind[1:] == SPACE)
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(lasts) + 1, np.isin(starts, odd_starts) if len(odd_starts) else np.zeros(len(starts), bool)

    @staticmethod
    def _contractions(data: np.ndarray, kind: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> None:
        """An apostrophe that no mark stands before or behind takes the s, t, m, d, re, ve or ll behind it."""
        n = len(data)
        at = np.flatnonzero((data[:-2] == 39) & begins[:-2] & (kind[:-2] == MARK)) if n > 2 else np.empty(0, np.int64)
        if n > 1 and data[-2] == 39 and begins[-2] and kind[-2] == MARK:
            at = np.r_[at, n - 2]
        at = at[(kind[at + 1] == LETTER) & begins[at + 1]]
        bounds = offsets[np.searchsorted(offsets, at, side="right").clip(max=len(offsets) - 1)] if len(at) else at
        first = data[np.minimum(at + 1, n - 1)]
        second = np.where(at + 2 < bounds, data[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < bounds)
        two = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)
        for found, size in ((one, 2), (two, 3)):
            i = at[found]
            begins[i + 1] = False
            after = i + size
            after = after[after < bounds[found]]
            begins[after] |= kind[after] != SPACE

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the first id of each text with the total."""
        offsets = np.asarray(offsets, np.int64)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if not self.cuts_known or any(token in raw for token in self.added):
            return self._apart(raw, data, offsets)
        data = _LOWER[data]
        starts, ends, odd = self._cuts(data, offsets)
        keys = texts.span_hashes(data, starts, ends) | np.uint64(1)
        if self.held > HELD_IDS:
            self.clear()
        slots = (keys >> np.uint64(44)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slots] != keys)
        places = self.places[slots].astype(np.int64)
        if len(missing):
            lowered = data.tobytes()
            distinct, first, at = np.unique(keys[missing], return_index=True, return_inverse=True)
            own = missing[first]
            learned = self._learn([lowered[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], odd[own])
            places[missing] = learned[at]
            self.keys[slots[own]] = distinct
            # Two fresh cuts may share a slot: the last written key and the last written place are the same cut's.
            self.places[slots[own]] = learned
        counts = places[:, 1]
        total = np.r_[0, np.cumsum(counts)]
        ids = self.values[np.repeat(places[:, 0] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def _apart(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with added tokens, or all texts of a file whose cuts are not known, go to the tokenizer whole."""
        parts = []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = raw[low:high]
            if not self.cuts_known or any(token in own for token in self.added):
                parts.append(self._plain([own.decode()])[0])
            else:
                parts.append(self.encode(data[low:high], np.array([0, high - low]))[0])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.cumsum([0, *map(len, parts)])


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One table of cuts for all tasks of a Python worker."""
    return WordIds(vocabulary)
