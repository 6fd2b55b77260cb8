"""SentencePiece models on the tokenizers library: encode and decode whole tables, with parity against SentencePiece.

The model file is a protobuf message; its pieces, scores, model type, byte fallback and normaliser are read from the wire
format. They are rebuilt as a tokenizers pipeline: the precompiled character map if there is one, the space marker, a
Unigram model with the pieces' scores or a BPE model whose merges are the pairs that make up a piece, best score first. No piece holds the
marker after another character, so a text falls into independent segments, each a marker run and what follows. Where every run is one
marker, the library's own marker cut makes them; texts with longer runs, or of a model that has such a piece, are cut here. Whole texts are
encoded in batches, by one thread a task. Each whole text is encoded by the SentencePiece library too and the ids are compared, so
parity covers normaliser, cut and merges; the ids of each whole text are decoded to bytes and compared with the normalised text.

Defined cases: a null text is read as the empty text, which has no tokens. Repeated rows and null ids get a row each. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import texts

MARKER = "▁"
BATCH_BYTES = 1 << 19
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, everything else as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a protobuf message: wire type {kind}")
        yield tag >> 3, value


@dataclass
class Proto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> Proto:
        out = cls()
        with open(path, "rb") as file:
            message = file.read()
        for number, value in fields(message):
            if number == 1:
                own = dict(fields(value))
                out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                out.model_type, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                out.charsmap = own.get(2, b"")
                out.dummy_prefix, out.remove_extra, out.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make up a piece, in the order of its score; equal scores in the order of the pieces."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for piece, i in sorted(ids.items(), key=lambda x: (-pieces[x[1]][1], x[1])):
        pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        out += sorted(pairs, key=lambda pair: (ids[pair[0]], ids[pair[1]]))
    return out


class Codec:
    """A SentencePiece model rebuilt on the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        proto = Proto.read(path)
        self.proto = proto
        unknown = next((i for i, p in enumerate(proto.pieces) if p[2] == UNKNOWN), None)
        if proto.model_type == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in proto.pieces], unknown, proto.byte_fallback)
        elif proto.model_type == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(proto.pieces)}, merges(proto.pieces), unk_token=None if unknown is None else proto.pieces[unknown][0],
                               fuse_unk=True, byte_fallback=proto.byte_fallback)
        else:
            raise ValueError(f"model type {proto.model_type} is neither unigram nor BPE")
        self.tokenizer = Tokenizer(model)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
        steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
        if proto.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if proto.dummy_prefix:
            steps.append(normalizers.Prepend(MARKER if proto.escape else " "))
        if proto.escape:
            steps.append(normalizers.Replace(" ", MARKER))
        self.normalizer = normalizers.Sequence(steps)
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in proto.pieces if kind in (NORMAL, USER_DEFINED))
        self.crossing = crossing or not proto.escape
        self.segment = re.compile(r"(?s).+" if self.crossing else f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        # The same model behind the library's marker cut, for texts in which no two markers stand together.
        self.whole = Tokenizer(model)
        if not self.crossing:
            self.whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARKER, prepend_scheme="never", split=True)
        spelled = [_spelled(piece, kind) for piece, _, kind in proto.pieces]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_to = np.cumsum([0, *map(len, spelled)])

    def normalized(self, text: str) -> str:
        if self.proto.charsmap or self.proto.remove_extra or not text:
            return self.normalizer.normalize_str(text) if text else ""
        # Without a character map only the marker is left to do.
        text = text.replace(" ", MARKER) if self.proto.escape else text
        return (MARKER if self.proto.escape else " ") + text if self.proto.dummy_prefix else text

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(self.normalized(text))

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]

    def decode_segments(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def encode_batch(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        plain = [i for i, text in enumerate(normal) if text and (self.crossing or MARKER * 2 not in text)]
        out: list[list[int]] = [[] for _ in normal]
        for i, encoding in zip(plain, self.whole.encode_batch_fast([normal[i] for i in plain], add_special_tokens=False), strict=True):
            out[i] = encoding.ids
        for i in set(range(len(normal))).difference(plain):
            if normal[i]:
                out[i] = [t for ids in self.encode_segments(self.segment.findall(normal[i])) for t in ids]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([self.normalized(text)])[0]

    def spell_rows(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes that each row of ids stands for, markers as blanks."""
        if not rows:
            return []
        ids = np.concatenate(rows).astype(np.int64)
        starts, counts = self.spelled_to[ids], self.spelled_to[ids + 1] - self.spelled_to[ids]
        ends = np.cumsum(counts)
        spelled = self.spelling[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.r_[0, ends][np.cumsum([0, *map(len, rows)])].tolist()
        return [spelled[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.stripped(self.tokenizer.decode(ids, skip_special_tokens=False)) if ids else ""

    def stripped(self, text: str) -> str:
        return text[1:] if self.proto.dummy_prefix and text.startswith(" ") else text


def _spelled(piece: str, kind: int) -> bytes:
    return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARKER, " ").encode()


class Held:
    """The rebuilt model and the SentencePiece library's own, for one another."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.codec, self.original = Codec(path), SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=1)
def models_held(path: str) -> Held:
    """One pair of models for all tasks of a Python worker."""
    return Held(path)


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, round_trip (the decoded ids are the normalised text), parity (SentencePiece agrees)."""
    path = model or default_model()
    kinds = [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    kinds += [("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType()), ("parity", T.BooleanType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks already use every core; threads of the libraries only add CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = models_held(path)
        codec = held.codec
        for batch in batches:
            for a, b, _, _ in texts.chunks(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                whole = [t or "" for t in part.column("text").to_pylist()]
                normal = [codec.normalized(t) for t in whole]
                encoded, originals = codec.encode_batch(normal), [held.original.encode(t) for t in whole]
                rows = [np.array(own, "<u4") for own in encoded]
                ids, n, crc, back, same = [], [], [], [], []
                for text, own, row, spelled, original in zip(normal, encoded, rows, codec.spell_rows(rows), originals, strict=True):
                    n.append(len(row))
                    crc.append(zlib.crc32(row.tobytes()))
                    back.append(spelled == (text.replace(MARKER, " ") if codec.proto.escape else text).encode())
                    same.append(own == original)
                    if with_ids:
                        ids.append(row.astype(np.int32))
                columns = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                columns += [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [f.name for f in schema.fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with token ids; null ids give a null text."""
    path = model or default_model()
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            decoded = iter(codec.tokenizer.decode_batch([i for i in ids if i is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else codec.stripped(next(decoded)) for i in ids], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def parity(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and parity of whole texts: the rebuilt tokenizer and the SentencePiece library encode each text alike."""
    path = model or default_model()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("parity", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(path)
        for batch in batches:
            same = [held.codec.encode(t or "") == held.original.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.bool_())], ["doc_id", "parity"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
