"""Licence scans: exact phrases by words, and short notices found with a bounded number of edits.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z; the search text is the words joined by one blank. A
notice that may have k edits is cut into k + 1 pieces; one of them must stand exactly (pigeonhole), so only the places
around exact pieces are candidates. The regex library then verifies each candidate within k edits and
the span is told in words and in characters of the whole text. A verified place begins and ends with whole words,
no word in it tells another licence, short codes stand in it as they are, and of notices that overlap the one with the fewest edits counts, of equals the longest.

Defined cases: a null text is read as the empty text: no words, no labels, score 0. A phrase is counted at each place where
its words begin. Repeated rows and null ids give a row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of the method: words as the search text has them, and the label that each stands for.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("either version 3 of the license or at your option any later version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
# Words that tell licences apart. The short ones must stand as they are, since one edit makes another of them; a long one may be
# misspelt, but none may stand where another licence is meant.
CODES = frozenset(b"cc by nc nd sa".split())
TELLING = CODES | frozenset(b"mit apache lesser affero noncommercial noderivatives sharealike mozilla".split())
#: One edit for so many characters of a notice.
CHARACTERS_PER_EDIT = 14

_TO_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label = text.encode(), label
        self.edits = max(1, len(text) // CHARACTERS_PER_EDIT)
        cuts = [round(i * len(text) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.codes = [w for w in self.text.split() if w in CODES]
        self.pattern = regex.compile(rb"(?e)(?:" + regex.escape(self.text) + rb"){e<=" + str(self.edits).encode() + rb"}")

    def matches(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the verified places in the joined words, none overlapping another."""
        windows: list[list[int]] = []
        for piece, at in self.pieces:
            i = words.find(piece)
            while i >= 0:
                windows.append([max(0, i - at - self.edits), i - at + len(self.text) + self.edits])
                i = words.find(piece, i + 1)
        windows.sort()
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out = []
        for a, b in merged:
            b = min(b, len(words))
            while a < b and (m := self.pattern.search(words, a, b)):
                place = self.whole(words, m.start(), m.end())
                if place:
                    out.append(place)
                a = max(m.end(), a + 1)
        return out

    def whole(self, words: bytes, a: int, b: int) -> tuple[int, int, int] | None:
        """The place as whole words, a word cut at either end taken in or left out, whichever needs fewer edits; none where that
        takes too many, a short code is not as it should be, or another licence's word stands in it."""
        a, b = a + len(words[a:b]) - len(words[a:b].lstrip()), a + len(words[a:b].rstrip())
        before, behind = words.rfind(b" ", 0, a) + 1, words.find(b" ", b)
        begins = {before} if before == a else {before, words.find(b" ", a) + 1}
        ends = {len(words) if behind < 0 else behind}
        if b not in ends:
            ends.add(words.rfind(b" ", 0, b))
        best = None
        for begin in sorted(begins):
            for end in sorted(ends):
                own = words[begin:end]
                if begin >= end or abs(len(own) - len(self.text)) > self.edits:
                    continue
                parts = own.split()
                if [w for w in parts if w in CODES] != self.codes or TELLING.intersection(parts).difference(self.text.split()):
                    continue
                m = self.pattern.fullmatch(own)
                if m and (best is None or sum(m.fuzzy_counts) < best[2]):
                    best = (begin, end, sum(m.fuzzy_counts))
        return best


def foremost(found: list[tuple]) -> list[tuple]:
    """Of (notice, start, end, edits) that overlap, those with the fewest edits, of equals the longest."""
    out: list[tuple] = []
    for place in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1], x[0].label)):
        if all(place[2] <= other[1] or other[2] <= place[1] for other in out):
            out.append(place)
    return sorted(out, key=lambda x: (x[1], x[2]))


_NOTICES = [Notice(*n) for n in NOTICES]
_PHRASES = [(p.encode().split(), label) for p, label in PHRASES.items()]


def scan_text(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
    """Number of words; (word, label) of every base place; (label, first word, start, end, likeness) of every notice, in characters."""
    raw = text.encode()
    low = raw.lower()
    words = low.translate(_TO_WORDS).split()
    base = []
    if b"license" in low:
        for i, w in enumerate(words):
            if w == b"license":
                for phrase, label in _PHRASES:
                    if i + 1 >= len(phrase) and words[i + 1 - len(phrase) : i + 1] == phrase:
                        base.append((i + 1 - len(phrase), label))
    joined = b" ".join(words)
    found = foremost([(n, *m) for n in _NOTICES for m in n.matches(joined)])
    notices = []
    if found:
        places = [m.span() for m in _WORD.finditer(low)]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        for n, a, b, edits in found:
            first = int(np.searchsorted(starts, a, side="right")) - 1
            last = min(int(np.searchsorted(starts, max(a, b - 1), side="right")) - 1, len(places) - 1)
            begin, end = places[first][0], places[last][1]
            notices.append((n.label, first, len(raw[:begin].decode()), len(raw[:end].decode()), 1 - edits / len(n.text)))
    return len(words), base, notices


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: words, base places and labels, all labels, the best likeness, and the verified notices."""
    notice = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("likeness", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
                           T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
                           T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("notices", T.ArrayType(notice))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in notice.fields]
        kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("likeness", pa.float64())]))
        for batch in batches:
            out: list[list] = [[] for _ in schema.fields[1:]]
            for text in batch.column("text"):
                n, base, notices = scan_text(text.as_py() or "")
                own = sorted({label for _, label in base})
                every = sorted({*own, *(x[0] for x in notices)})
                best = max([1.0 if base else 0.0, *(x[4] for x in notices)])
                places = [i for i, _ in base]
                row = (n, len(base), min(places, default=None), max(places, default=None), ",".join(own), ",".join(every), best, [dict(zip(names, x, strict=True)) for x in notices])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [f.name for f in schema.fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
