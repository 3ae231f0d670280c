"""Byte-level helpers shared by the text operators: slices of Arrow batches, words, shingles, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows handled at a time inside a task, and the bytes of text at which such a slice ends earlier.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (split-mix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of bounded rows and bounded text bytes; a longer single text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without the six ASCII white-space bytes) and the word count of each text.

    A word's hash is a polynomial of random byte values modulo 2**64, then mixed. A-Z are taken as given: lower-case before.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    solid = np.concatenate(([False], ~space, [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    length = end - start
    power = np.empty(int(length.max()), dtype=np.uint64)
    power[0] = 1
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    at = np.flatnonzero(~space)
    within = at - np.repeat(start, length)
    value = _BYTE[buf[at]] * power[within]
    return mix(np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))), counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles; fewer words: the whole sequence is one."""
    lowered = [t.lower() for t in texts]  # bytes.lower() changes A-Z only
    h, counts = words(lowered)
    factor = mix((np.arange(width, dtype=np.uint64) + np.uint64(7)) * _GOLD) | np.uint64(1)
    out, at = [], 0
    if len(h) >= width:
        rolled = h[: len(h) - width + 1] * factor[0]
        for k in range(1, width):
            rolled = rolled + h[k: len(h) - width + 1 + k] * factor[k]
        rolled = mix(rolled)
    for n in counts:
        if n >= width:
            s = np.sort(rolled[at: at + n - width + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix((h[at: at + n] * factor[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
