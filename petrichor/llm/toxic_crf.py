"""Operator 1: toxic spans and document scores by a linear-chain conditional random field.

A chain is a sentence: words up to a line end or closing mark, cut after ``CHAIN`` words. Each word has two states. A
state's potential comes from hashed features: the word, its beginnings and end, and both neighbours; transitions are
learned too. Forward-backward gives each word's marginal of being toxic. A document's score is a logistic function of its
largest marginal and the sum of its marginals; words with a marginal of one half or more are reported as spans.

Fit, on a bounded sample of labelled documents (``SAMPLE`` of each class, the first by a hash of the id): words and word
beginnings that are found far more often in toxic than in other documents mark the toxic tokens of toxic documents; with
these token labels the field is fitted on two thirds of the sample, and the logistic function on the last third.

Defined cases: null and empty text has no words and gets the score of a document without evidence; whole texts are read,
whatever their length; labels that are null, or of ids without a document, teach nothing, and of several labels of an id the
toxic one holds; a sample without both classes gives score 0 everywhere; repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

SAMPLE, CHAIN, BITS, ROUNDS = 1500, 64, 18, 30
#: Chains without a toxic token that the fit uses for each chain with one.
QUIET = 3
KEPT = 300_000
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")
SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, p: double>>"


def _slot(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


def own_features(word: str) -> list[int]:
    parts = [f"w={word}", f"e={word[-3:]}", "any"] + [f"b{n}={word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n]
    return [_slot(p) for p in parts]


def neighbour_features(word: str) -> tuple[int, int]:
    """Slots of a word as the one before and as the one after."""
    return _slot(f"before={word}"), _slot(f"after={word}")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def layout(stop: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word positions, chain number of each, place in its chain) from stop marks and document numbers of all tokens."""
    word = np.flatnonzero(~stop)
    if not len(word):
        return word, word, word
    broken = np.cumsum(stop)[word]
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (broken[1:] != broken[:-1]) | (doc[word][1:] != doc[word][:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0))
    place = np.arange(len(word)) - start
    fresh |= place % CHAIN == 0
    return word, np.cumsum(fresh) - 1, place % CHAIN


@dataclass
class Field:
    weights: np.ndarray  # hashed feature weights of the toxic state; the other state's potential is zero
    transitions: np.ndarray  # [from, to]
    logistic: np.ndarray  # bias, weight of the largest marginal's log odds, weight of the log of the sum
    usable: bool = True


def marginals(e: np.ndarray, chain: np.ndarray, place: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Marginal of the toxic state of every word; with ``pairs`` also expected transition counts and the log partition sum."""
    n = int(chain[-1]) + 1 if len(chain) else 0
    out = np.zeros(len(e))
    expected, total = np.zeros((2, 2)), 0.0
    if not n:
        return (out, expected, total) if pairs else out
    length = np.bincount(chain, minlength=n)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    steps = int(length.max())
    alive = np.searchsorted(-length[order], -np.arange(1, steps + 1), side="right")  # chains with more than t words
    grid = np.zeros((steps, n))
    grid[place, rank[chain]] = e
    m = np.exp(transitions)
    factor = np.exp(np.clip(grid, -30, 30))
    forward, scale = np.zeros((steps, n, 2)), np.ones((steps, n))
    for t in range(steps):
        k = alive[t]
        a = forward[t - 1, :k] @ m if t else np.ones((k, 2))
        a = a * np.stack((np.ones(k), factor[t, :k]), axis=1)
        scale[t, :k] = a.sum(axis=1)
        forward[t, :k] = a / scale[t, :k, None]
    backward = np.ones((n, 2))
    gamma = np.zeros((steps, n))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        g = forward[t, :k] * backward[:k]
        gamma[t, :k] = g[:, 1] / g.sum(axis=1)
        if t:
            b = backward[:k] * np.stack((np.ones(k), factor[t, :k]), axis=1) / scale[t, :k, None]
            if pairs:
                xi = forward[t - 1, :k, :, None] * m * b[:, None, :]
                expected += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[:k] = b @ m.T
    out = gamma[place, rank[chain]]
    return (out, expected, float(np.log(scale).sum())) if pairs else out


def fit_field(chains: list[tuple[list[str], list[int]]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions that maximise the conditional likelihood of (words, states), by adaptive gradient steps."""
    weights, transitions = np.zeros(1 << BITS), np.zeros((2, 2))
    known: dict[str, list[int]] = {}
    slots, owner, states, chain, place = [], [], [], [], []
    at = 0
    for c, (words, y) in enumerate(chains):
        for i, w in enumerate(words):
            own = known.get(w)
            if own is None:
                own = known[w] = own_features(w)
            f = own + [neighbour_features(x)[0] for x in words[max(0, i - 1): i]] + [neighbour_features(x)[1] for x in words[i + 1: i + 2]]
            slots += f
            owner += [at] * len(f)
            at += 1
        states += y
        chain += [c] * len(words)
        place += range(len(words))
    slots, owner, states, chain, place = (np.array(x) for x in (slots, owner, states, chain, place))
    seen = np.bincount(slots, weights=states[owner], minlength=len(weights))
    follows = np.flatnonzero((place[1:] > 0))
    observed = np.zeros((2, 2))
    np.add.at(observed, (states[follows], states[follows + 1]), 1)
    g1, g2 = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        e = np.bincount(owner, weights=weights[slots], minlength=at)
        p, expected, _ = marginals(e, chain, place, transitions, pairs=True)
        d1 = seen - np.bincount(slots, weights=p[owner], minlength=len(weights)) - 0.05 * weights
        d2 = observed - expected - 0.05 * transitions
        g1 += d1 * d1
        g2 += d2 * d2
        weights += 0.5 * d1 / np.sqrt(g1)
        transitions += 0.5 * d2 / np.sqrt(g2)
    return weights, transitions


class Tagger:
    """A field with the potentials of the words met so far; a worker keeps a bounded number of them."""

    def __init__(self, field: Field):
        self.field, self.index, self.rows = field, {}, np.zeros((1024, 3))

    def learn(self, words) -> None:
        if len(self.index) > KEPT:
            self.index = {}
        w = self.field.weights
        need = len(self.index) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), 3))))
        for x in words:
            k = self.index[x] = len(self.index)
            before, after = neighbour_features(x)
            self.rows[k] = w[own_features(x)].sum(), w[before], w[after]

    def tag(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text; and of all words: token position in the whole, text number, marginal."""
        parts = [tokens(t) for t in texts]
        flat = [x for p in parts for x in p]
        unique = set(flat)
        missing = unique.difference(self.index)
        if missing:
            if len(self.index) + len(missing) > KEPT:
                self.index, missing = {}, unique
            self.learn(missing)
        ids = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        stop_ids = [self.index[s] for s in _STOPS if s in self.index]
        stop = np.isin(ids, stop_ids) if stop_ids else np.zeros(len(ids), dtype=bool)
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        word, chain, place = layout(stop, doc)
        rows = self.rows[ids[word]]
        e = rows[:, 0].copy()
        if len(e) > 1:
            joined = place[1:] > 0
            e[1:] += np.where(joined, rows[:-1, 1], 0)
            e[:-1] += np.where(joined, rows[1:, 2], 0)
        return parts, word, doc[word], marginals(e, chain, place, self.field.transitions)


def evidence(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, log odds of its largest marginal, log of the sum of its marginals."""
    top, total = np.zeros(n), np.bincount(doc, weights=p, minlength=n)
    np.maximum.at(top, doc, p)
    top = np.clip(top, 1e-5, 1 - 1e-5)
    return np.stack((np.ones(n), np.log(top / (1 - top)), np.log(np.maximum(total, 1e-4))), axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def markers(docs: list[tuple[list[str], int]]) -> set[str]:
    """Words (``=word``) and word beginnings (``^beg``) that single out toxic documents: seen there at least 50 times as often as
    elsewhere, and in so many of them that for a word without meaning this has a chance of at most 3 in 100,000."""
    toxic, other = Counter(), Counter()
    for words, y in docs:
        keys = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}
        (toxic if y else other).update(keys)
    n1 = max(1, sum(y for _, y in docs))
    n0 = max(1, len(docs) - n1)
    least = max(3, int(np.ceil(np.log(1e5 / 3) / np.log((n1 + n0) / n1))))
    return {k for k, c in toxic.items() if c >= least and (c / n1) / ((other[k] + 0.02 * least) / n0) >= 50}


def marked(word: str, keys: set[str]) -> int:
    return int(f"={word}" in keys or any(f"^{word[:n]}" in keys for n in (4, 5, 6) if len(word) > n))


def fit(sample: list[tuple[int, str, int]], rounds: int = ROUNDS, share: float | None = None) -> Field:
    """Field from (id, text, toxic) rows; ``share``: of toxic ones among all labelled documents, if the sample's differs."""
    rows = sorted(sample, key=lambda r: zlib.crc32(str(r[0]).encode()) ^ 0x5BD1E995)
    none = Field(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([-35.0, 0, 0]), usable=False)
    if len({r[2] for r in rows}) < 2:
        return none
    first = [r for k, r in enumerate(rows) if k % 3]
    split = [(tokens(t), y) for _, t, y in first]
    keys = markers([([w for w in ts if w not in _STOPS], y) for ts, y in split])
    loud, quiet = [], []
    for ts, y in split:
        stop = np.array([t in _STOPS for t in ts], dtype=bool)
        word, chain, _ = layout(stop, np.zeros(len(ts), dtype=np.int64))
        if not len(word):
            continue
        for part in np.split(word, np.flatnonzero(np.diff(chain)) + 1):
            words = [ts[i] for i in part]
            states = [marked(w, keys) if y else 0 for w in words]
            (loud if any(states) else quiet).append((words, states))
    if not loud:
        return none
    quiet.sort(key=lambda c: zlib.crc32(" ".join(c[0]).encode()))
    weights, transitions = fit_field(loud + quiet[: QUIET * len(loud)], rounds)
    field = Field(weights.astype(np.float32), transitions, np.zeros(3))
    rest = [r for k, r in enumerate(rows) if not k % 3] or rows
    tagger, x = Tagger(field), []
    for k in range(0, len(rest), 256):
        texts = [t for _, t, _ in rest[k: k + 256]]
        _, _, doc, p = tagger.tag(texts)
        x.append(evidence(p, doc, len(texts)))
    x, y = np.concatenate(x), np.array([r[2] for r in rest], dtype=np.float64)
    part = min(max(y.mean(), 1e-3), 1 - 1e-3)
    share = part if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / part, (1 - share) / (1 - part))
    beta = np.zeros(3)
    for _ in range(30):
        q = logistic(x @ beta)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (weight * (y - q)) - 1e-2 * beta)
    field.logistic = beta
    return field


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Field:
    """Field from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); both already without what must not teach.

    At most ``each`` documents of either class reach the driver.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(each) for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1])  # at most 2 * each rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return fit([(r["doc_id"], r["text"], int(r["toxic"])) for r in rows], share=counts.get(1, 0) / max(1, sum(counts.values())))


def _tagged(field: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        tagger = Tagger(field)
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            parts, word, doc, p = tagger.tag(texts)
            score = logistic(evidence(p, doc, len(texts)) @ field.logistic)
            spans: list[list[dict]] = [[] for _ in texts]
            begin = np.cumsum([0] + [len(x) for x in parts])
            hit = np.flatnonzero(p >= 0.5)
            for d in np.unique(doc[hit]):
                at = [m.span() for m in TOKEN.finditer(texts[d].lower())]
                spans[d] = [{"start": at[word[h] - begin[d]][0], "end": at[word[h] - begin[d]][1], "p": float(p[h])} for h in hit[doc[hit] == d]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                                             names=["doc_id", "score", "predicted", "spans"])
    return run


def tagged(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted, spans of every row of ``docs`` (doc_id, text); spans are character offsets in the lower-cased text."""
    return docs.select("doc_id", "text").mapInArrow(_tagged(field), SCHEMA)
