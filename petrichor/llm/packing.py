"""Operator 10: vector bin packing of tokenised examples.

Every example has three sizes: tokens, segments (one a piece) and loss-bearing tokens. Sequences are filled under limits
on all three. The next piece is the one that fits and whose size vector has the largest dot product with what is left of
the sequence, both in units of the limits. A piece longer than a sequence is cut at the limit before; where
nothing fits any more, the piece with most tokens is cut to fill the gap exactly. A task packs its rows in groups of
bounded size, so nothing is shuffled; the last, partly filled sequences of a group are cut into lengths that are powers
of two, which need no padding.

Defined cases: null and empty text is the closing id alone; a row of any length is read whole; repeated rows and rows
without an id are packed like all others; null or too many loss-bearing tokens are all tokens, fewer than none are none; sequence ids are unique over the whole result, and the same again when a task
is run again; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import PLAIN, byte_characters, plain_pattern
from .text import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Distinct chunks that a worker remembers before the older generation of them is let go.
KEPT = 250_000
#: Distinct words inside longer chunks that it remembers besides.
WORDS = 100_000
#: Rows and token ids of a packing group.
GROUP_ROWS, GROUP_IDS = 1024, 4 << 20
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]|[^\S \t\n\r]")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2047


class Ids:
    """Ids of whole texts. White space ends a token, so a text is encoded chunk by chunk and chunks are remembered.

    Words of plain Latin chunks go straight to the tokenizer's model; anything else takes the tokenizer's own way.
    """

    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.table = dict(enumerate(byte_characters()))
        self.findall = self._quick_pattern(path)

    def _quick_pattern(self, path: str):
        """How plain words are cut before the model, or None where the file's steps aren't the ones known here."""
        steps = json.loads(Path(path).read_text())
        kinds = [x["type"] for part, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
                 for x in (steps[part] or {}).get(many, [])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            return None
        pattern = plain_pattern(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}"))
        return re.compile(pattern).findall if pattern else None

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of a plain word, straight from the model; ASCII stands for itself there."""
        known = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(known)]).tobytes()

    def part(self, word: str) -> bytes:
        """Ids of a plain word inside a longer chunk: as a chunk of its own it may be known already."""
        packed = self.words.get(word) or self.seen.get(word) or self.older.get(word)
        if packed is None:
            packed = self.words[word] = self.word(word)
        return packed

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of ``chunks``; plain ones are lower-cased already or are so here."""
        slow, part = [], self.part
        for c in chunks:
            ids = self.older.get(c)
            if ids is not None:
                self.seen[c] = ids
            elif self.findall and not PLAIN.search(c):
                c_words = self.findall(c.lower())
                if len(c_words) == 1:
                    self.seen[c] = self.words.get(c) or self.word(c_words[0])
                else:
                    self.seen[c] = b"".join([part(w) for w in c_words])
            else:
                slow.append(c)
        if slow:
            self.seen.update(zip(slow, self.fresh(slow)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts, odd = [], []
        for i, t in enumerate(texts):
            if not PLAIN.search(t):
                parts.append(t.lower().split())
            elif ODD_SPACE.search(t):  # str.split() would split where the tokenizer doesn't, or the other way round
                odd.append(i)
                parts.append([])
            else:
                parts.append(t.split())
        missing = set().union(*parts).difference(self.seen)
        if missing:
            self.learn(missing)
        get = self.seen.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        if odd:
            for i, ids in zip(odd, self.fresh([texts[i] for i in odd])):
                out[i] = ids
        if len(self.seen) > self.kept or any(len(t) > 4096 for t in missing):
            self.older, self.seen = {t: i for t, i in self.seen.items() if len(t) <= 64}, {}
        if len(self.words) > WORDS:
            self.words = {}
        return out


@lru_cache(maxsize=2)
def ids_of(path: str, kept: int = KEPT) -> Ids:
    return Ids(path, kept)


def pack(tokens: list[int], loss: list[int], limits: Limits = Limits()) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length).

    ``loss``: loss-bearing tokens, the last ones of each example. A piece's first token has nothing before it in its
    sequence, so it never bears loss.
    """
    quiet = [n - m for n, m in zip(tokens, loss)]  # leading tokens without loss

    def bearing(i: int, start: int, length: int) -> int:
        return max(0, start + length - max(start + 1, quiet[i]))

    def longest(i: int, start: int, room: int, bear: int) -> int:
        """Longest piece from ``start`` with at most ``room`` tokens and ``bear`` loss-bearing ones."""
        return min(room, max(start + 1, quiet[i]) - start + bear)

    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(tokens):
        at = 0
        while (cut := longest(i, at, limits.tokens, limits.loss)) < n - at:
            sequences.append([(i, at, cut)])
            at += cut
        if n > at:
            rest.append((i, at, n - at))
    units = np.array([[limits.tokens], [limits.segments], [limits.loss]], dtype=np.float64)
    size = np.array([[n, 1, bearing(i, at, n)] for i, at, n in rest], dtype=np.float64).reshape(-1, 3).T / units
    used = 2.0  # more than a whole sequence: a placed piece fits nowhere
    left, opened, waiting = np.ones(3), [], len(rest)
    tiny = 1e-9
    while waiting:
        fit = (size[0] <= left[0] + tiny) & (size[1] <= left[1] + tiny) & (size[2] <= left[2] + tiny)
        k = int(np.argmax(np.where(fit, left @ size, -1.0)))
        if fit[k]:
            opened.append(rest[k])
            left = left - size[:, k]
            size[:, k] = used
            waiting -= 1
            continue
        gap = limits.tokens - sum(n for _, _, n in opened)
        k = int(np.argmax(np.where(size[0] < used, size[0], -1.0)))
        i, start, n = rest[k]
        bears = limits.loss - sum(bearing(*x) for x in opened)
        cut = min(longest(i, start, gap, bears), n - 1)
        if len(opened) < limits.segments and cut > 0:
            opened.append((i, start, cut))
            rest[k] = (i, start + cut, n - cut)
            size[:, k] = np.array([n - cut, 1, bearing(*rest[k])]) / units[:, 0]
        sequences.append(opened)
        left, opened = np.ones(3), []
    if opened:
        sequences.append(opened)
    return sequences


def powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One sequence cut into sequences whose lengths are powers of two, the longest first."""
    total, out, at = sum(n for _, _, n in sequence), [], 0
    pieces = list(sequence)
    for bit in reversed(range(total.bit_length())):
        want, part = total & (1 << bit), []
        while want:
            i, start, n = pieces[at]
            took = min(n, want)
            part.append((i, start, took))
            want -= took
            if took == n:
                at += 1
            else:
                pieces[at] = (i, start + took, n - took)
        if part:
            out.append(part)
    return out


def _packed(path: str, closing: int, limits: Limits, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([closing], dtype="<u4").tobytes()

    def emit(names: list, ids: list[bytes], loss: list, base: int, made: int) -> tuple[pa.RecordBatch, int]:
        tokens = [len(x) // 4 for x in ids]
        found = pack(tokens, [n if m is None else min(n, max(0, m)) for n, m in zip(tokens, loss)], limits)
        sequences = []
        for s in found:
            total = sum(n for _, _, n in s)
            sequences += [s] if total >= limits.tokens * 63 // 64 or total & (total - 1) == 0 else powers(s)
        rows = []
        for k, s in enumerate(sequences):
            offset = 0
            for i, start, n in s:
                rows.append((names[i], start, n, zlib.crc32(ids[i][4 * start: 4 * (start + n)]), tokens[i], base + made + k, offset))
                offset += n
        cols = list(zip(*rows))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                           names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return batch, made + len(sequences)

    def run(batches):
        t, base, made = ids_of(path, kept), TaskContext.get().partitionId() << 33, 0
        names, ids, loss, held = [], [], [], 0
        for part in slices(batches, "text", size=1 << 20):
            names += part.column(0).to_pylist()
            new = [x + end for x in t.encode_all([x or "" for x in part.column(1).to_pylist()])]
            ids += new
            loss += part.column(2).to_pylist()
            held += sum(map(len, new)) // 4
            if len(names) >= GROUP_ROWS or held >= GROUP_IDS:
                batch, made = emit(names, ids, loss, base, made)
                yield batch
                names, ids, loss, held = [], [], [], 0
        if names:
            yield emit(names, ids, loss, base, made)[0]
    return run


def packed(docs: DataFrame, path: str, closing: int = 1, limits: Limits = Limits(), loss: str | None = None,
           kept: int = KEPT) -> DataFrame:
    """One row a piece of every row of ``docs`` (doc_id, text); each sequence lies in one task.

    ``loss`` names a column with the number of loss-bearing tokens of each row, its last ones, the closing id among them.
    Null, or no such column, means all tokens; then a loss limit of ``limits.tokens - 1`` or more never binds. ``kept`` is the
    number of distinct chunks that a worker remembers: more take memory and save time, and the result is the same.
    """
    bearing = F.col(loss) if loss else F.lit(None)
    return docs.select("doc_id", "text", bearing.cast("long").alias("loss")).mapInArrow(_packed(path, closing, limits, kept), SCHEMA)
