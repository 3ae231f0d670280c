"""Operator 7: license scan by fuzzy short-notice search.

Exact base: places where a phrase's words stand consecutively. Fuzzy part: a notice that occurs with at most ``errors``
edits contains one of ``errors + 1`` pieces of it unchanged (pigeonhole), so one Aho-Corasick pass over the text finds all
places that can hold it. Each is a window as long as the notice and the edits around it; windows that start within the edits
of each other are one. A bounded-error pattern confirms the edits in a window and gives the span. Finds of a notice don't overlap:
the one with fewest edits stands, and what it leaves of another's window is searched again. Windows have a fixed length, so the work is in
proportion to the text. Matching runs on text with A-Z lower-cased and each run of ASCII white space as one blank.

Defined cases: null and empty text have no word, no place and no label, and score 0; a text of any length is read whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import as_bytes, slices

# fixed values: phrases and labels of the exact base
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# fixed values: short notices, their labels and allowed edits
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge", "mit", 4),
    ("licensed under the apache license", "apache", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by", "cc-by", 2),
    ("all rights reserved", "reserved", 2),
    ("public domain dedication", "public-domain", 2),
    ("spdx-license-identifier:", "spdx", 2),
)
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
SPACE = re.compile("[\\x20\\x09-\\x0D]+")
#: Stretches of text that a worker remembers.
KNOWN = 1 << 16
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors + 1`` consecutive pieces of nearly equal length."""
    cut = [i * len(notice) // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class Scanner:
    """Compiled notices and the automaton of their seeds."""

    def __init__(self, notices=NOTICES, base=BASE):
        self.notices = notices
        self.base = [(tuple(phrase.split()), label) for phrase, label in base]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, errors) in enumerate(notices):
            for offset, piece in seeds(notice, errors):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?be)(?:{regex.escape(notice)}){{e<={errors}}}") for notice, _, errors in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        self.size = [len(n) for n, _, _ in notices]

    def best(self, k: int, stretch: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of notice ``k`` in a short stretch of text; stretches are remembered, as they come again."""
        if len(stretch) < self.size[k] - self.notices[k][2]:
            return None
        known = self.known.get((k, stretch), ())
        if known == ():
            m = self.patterns[k].search(stretch)
            known = (sum(m.fuzzy_counts), m.start(), m.end()) if m else None
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[k, stretch] = known
        return known

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Stretches of ``text`` that can hold each notice."""
        out: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                errors = self.notices[k][2]
                lo = end - length + 1 - offset - errors
                spans = out.setdefault(k, [])
                near = next((w for w in spans[-3:] if abs(lo - w[2]) <= errors), None)  # the same occurrence, by another piece
                if near:
                    near[0], near[1] = min(near[0], lo), max(near[1], lo + self.size[k] + 2 * errors)
                else:
                    spans.append([lo, lo + self.size[k] + 2 * errors, lo])
        return out

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of confirmed notices in ``text`` as ``flat`` gives it; finds of one notice don't overlap."""
        out = []
        for k, spans in self.windows(text).items():
            todo: list[tuple[int, int, int, int, int]] = []

            def search(lo: int, hi: int, k=k, todo=todo):
                lo, hi = max(0, lo), min(len(text), hi)
                if lo < hi and (m := self.best(k, text[lo:hi])):
                    heapq.heappush(todo, (m[0], lo + m[1], lo + m[2], lo, hi))
            for lo, hi, _ in spans:
                search(lo, hi)
            starts, ends = [], []  # of what stands, in order
            while todo:
                edits, start, end, lo, hi = heapq.heappop(todo)
                first, last = bisect.bisect_right(ends, start), bisect.bisect_left(starts, end)
                if first == last:
                    starts.insert(first, start)
                    ends.insert(first, end)
                    out.append((start, end, self.notices[k][1], edits))
                elif (starts[first], ends[first]) != (start, end):
                    search(lo, starts[first])
                    search(ends[last - 1], hi)
        return sorted(out)

    def exact(self, words: list[str]) -> list[tuple[int, str]]:
        """(first word, label) of every exact base phrase."""
        out = []
        for phrase, label in self.base:
            n, at = len(phrase), -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if tuple(words[at: at + n]) == phrase:
                    out.append((at, label))
        return out

    def scan(self, raw: bytes) -> tuple:
        lowered = raw.lower().decode()  # bytes.lower() changes A-Z only
        words = WORD.findall(lowered)
        exact = self.exact(words)
        fuzzy = self.fuzzy(flat(lowered))
        base_labels = {label for _, label in exact}
        best = max((1 - edits / (2 * max(1, end - start)) for start, end, _, edits in fuzzy), default=0.0)
        return (len(words), len(exact), min((a for a, _ in exact), default=None), max((a for a, _ in exact), default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x[2] for x in fuzzy})),
                1.0 if exact else max(0.0, best), fuzzy)


def flat(lowered: str) -> str:
    return SPACE.sub(" ", lowered)


@lru_cache(maxsize=4)
def scanner(notices=NOTICES, base=BASE) -> Scanner:
    return Scanner(notices, base)


def _run(notices, base, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        s = scanner(notices, base)
        for part in slices(batches, "text"):
            rows = [s.scan(t) for t in as_bytes(part.column(1))]
            cols = list(zip(*rows))
            arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()),
                      pa.array(cols[5], pa.string()), pa.array(cols[6], pa.float64())]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
                arrays.append(pa.array([[dict(zip(("start", "end", "label", "edits"), x)) for x in f] for f in cols[7]], kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def scan(docs: DataFrame, notices=NOTICES, base=BASE, spans: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base columns, labels, score, and the spans of fuzzy finds.

    Spans are character offsets in the lower-cased text whose white space is folded to single blanks (``flat``).
    """
    schema = SCHEMA + (", spans array<struct<start: long, end: long, label: string, edits: long>>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(_run(tuple(notices), tuple(base), spans), schema)
