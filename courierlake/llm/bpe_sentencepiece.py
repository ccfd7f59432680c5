"""Byte-level BPE encoding and decoding through a sentencepiece BPE model.

The model is serialised directly from the rank file: every token's bytes are
written as mapped characters (one visible character a byte), scored by its
negative rank, with identity normalisation, no dummy prefix and white space
left alone. sentencepiece then merges exactly as the ranks say. Each match of
the split pattern is encoded separately; decoding maps the pieces of the model
back to bytes.

One pass over the rows with no shuffle; a worker holds the model, a bounded
cache of pre-tokens and about a megabyte of text. Nothing depends on a key.

Defined results: a null or empty text has no tokens and decodes to no bytes;
repeated rows repeat; very long texts, and pre-tokens of any length, are encoded
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text, rows_of, slices

#: Pre-tokens whose ids a worker keeps; beyond that it starts afresh. Longer ones than LONG characters are not kept.
CACHE, LONG = 200_000, 64
SCHEMA = "doc_id long, ids binary"


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (pieces = 1, trainer = 2, normaliser = 3) whose piece ids are the ranks."""
    letters = byte_characters()
    out = [_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank))) for rank, token in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(40, len(tokens))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.find = regex.compile(pattern).findall
        self.letters = {b: ord(c) for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = self.model.id_to_piece(list(range(len(self.tokens))))
        self.pieces = [bytes(back[c] for c in piece) for piece in pieces]
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = self.find(text)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = [t for t in set(found) if t not in cache]
        if new:
            mapped = [t.encode().decode("latin-1").translate(self.letters) for t in new]
            for t, ids in zip(new, self.model.encode(mapped, num_threads=1), strict=True):
                cache[t] = np.asarray(ids, dtype="<u4").tobytes()
        out = b"".join(map(cache.__getitem__, found))
        for t in new:
            if len(t) > LONG:
                del cache[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches):
            yield rows_of(schema, doc_id=b.column("doc_id"), ids=[c.encode(t) for t in b.column("text").to_pylist()])

    return id_text(docs).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "ids", 4 << 20):
            yield rows_of(schema, doc_id=b.column("doc_id"), ids=b.column("ids"), decoded=[c.decode(i or b"") for i in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, made in one worker pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches):
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            yield rows_of(
                schema,
                doc_id=b.column("doc_id"),
                n_tokens=[len(i) // 4 for i in ids],
                ids_sha256=[hashlib.sha256(i).hexdigest() for i in ids],
                decoded_sha256=[hashlib.sha256(c.decode(i)).hexdigest() for i in ids],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
