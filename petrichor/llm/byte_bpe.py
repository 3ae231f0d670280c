"""Operator 8: byte-level BPE through a sentencepiece model written straight from a rank vocabulary.

Every byte is mapped to one printable character, so a rank's byte string becomes a piece of ordinary text. A piece's
score is its negative rank: the best-scored merge first is the lowest-ranked merge first. The model is written as
protobuf bytes with identity normalisation, and nothing is trained. Pre-tokens are encoded one by one; ids are piece
numbers, which equal ranks. Decoding maps ids to pieces and their characters back to bytes.

Defined cases: null and empty text give no ids and empty bytes; ids of repeated rows repeat; control strings in a text
are ordinary text; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .text import slices

#: Distinct pre-tokens that a worker remembers before the older generation of them is let go.
KEPT = 250_000
#: In texts without any other character, the standard library's classes equal the Unicode properties of the pattern.
PLAIN = re.compile("[^\\t\\n\\r\x20-\x5e\x60-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    """One protobuf field: integers as varint, floats as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        rows = dict((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if sorted(rows) != list(range(len(rows))):
        raise ValueError("ranks must run from 0 without gaps")
    return [rows[i] for i in range(len(rows))]


def model_bytes(ranks: list[bytes]) -> bytes:
    """Serialised sentencepiece BPE model: pieces in rank order, then one unknown piece that no text reaches."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
              for rank, token in enumerate(ranks)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(2, _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, 2**64 - 1)
                     + _field(42, 2**64 - 1) + _field(43, 2**64 - 1))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normaliser


def plain_pattern(pattern: str) -> str | None:
    """The same pattern with the standard library's classes, right for texts in which ``PLAIN`` finds nothing."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\s\w]").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return None if r"\p" in out else out


class Codec:
    """Encoder and decoder of whole texts; remembers the ids of pre-tokens as packed bytes."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(ranks)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.chars = byte_characters()
        back = {c: i for i, c in enumerate(self.chars)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.findall = regex.compile(pattern).findall
        plain = plain_pattern(pattern)
        self.findall_plain = re.compile(plain).findall if plain else self.findall
        self.table = {i: c for i, c in enumerate(self.chars)}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.findall(text) if PLAIN.search(text) else self.findall_plain(text)

    def learn(self, tokens: set[str]) -> dict[str, bytes]:
        """Packed ids of all ``tokens``; those not met before go to the model in one call."""
        new = []
        for t in tokens:
            packed = self.older.get(t)
            if packed is None:
                rank = self.whole.get(t.encode())
                packed = None if rank is None else struct.pack("<I", rank)
            if packed is None:
                new.append(t)
            else:
                self.seen[t] = packed
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in new]
        for t, ids in zip(new, self.model.encode(mapped, num_threads=1)):
            self.seen[t] = struct.pack(f"<{len(ids)}I", *ids)
        return self.seen

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t) for t in texts]
        missing = set().union(*parts).difference(self.seen)
        get = (self.learn(missing) if missing else self.seen).__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        if len(self.seen) > KEPT or any(len(t) > 4096 for t in missing):
            self.older, self.seen = {t: i for t, i in self.seen.items() if len(t) <= 64}, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def digests(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        c = codec(path, pattern)
        for part in slices(batches, "text"):
            n, a, b = zip(*((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
                            for ids in c.encode_all([t or "" for t in part.column(1).to_pylist()])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encoded(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        c = codec(path, pattern)
        for part in slices(batches, "text"):
            packed = c.encode_all([t or "" for t in part.column(1).to_pylist()])
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in packed]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return run


def decoded(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])
    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(encoded(path, pattern), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of every row of ``ids`` (doc_id, ids)."""
    return ids.select("doc_id", "ids").mapInArrow(decoded(path, pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of ids and of the bytes decoded from them, without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(digests(path, pattern), SCHEMA)
