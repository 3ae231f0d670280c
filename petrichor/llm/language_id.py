"""Operator 5: language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted once and then frozen. The code length of a byte
under its longest context comes from that context's counts if it was seen there, else from the escape probability and the
next shorter context, down to a uniform order -1 (method C: an escape counts as often as there are distinct successors).
The trees are over all 256 bytes, none of them merged but A-Z with a-z and each run of white space with one blank. They
are sparse: of each order the sorted (context, byte) cells that were seen, so that memory follows the sample and a further
language leaves the others as they are. Scoring looks up each different cell of a block of text once, escaping down where
it is absent. The language with the shortest code wins, ties to the smaller name.

Fit: at most ``TRAIN_DOCS`` different labelled documents of each language, the first by a hash of id and text, of those
with at most ``TRAIN_BYTES`` bytes, so that the driver's sample is bounded in bytes too. Longer texts are scored like all others.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn from every text is
``und``; null languages teach nothing; repeated rows are one document of the sample; whole texts are scored, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import as_bytes, slices

ORDER, TRAIN_DOCS, TRAIN_BYTES = 3, 400, 1 << 18
#: Bytes are symbols; a context of ``ORDER`` of them and the next one fill 32 bits.
SYMBOLS = 256
#: Positions of a text looked up at a time.
BLOCK = 1 << 20
#: Name of the column that ``flagged`` adds.
LANGUAGE = "_lang_pred"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


@dataclass
class Model:
    """Frozen counts: per language the seen (context, byte) cells of each order, as sorted flat indices with counts."""

    languages: list[str]
    alphabet: np.ndarray  # 256 bytes to folded bytes
    symbols: int
    cells: list[list[tuple[np.ndarray, np.ndarray]]]  # [language][order]: indices, counts
    name: str = ""  # digest of the counts: a worker keeps the table of the model that it used last

    @property
    def table(self) -> Table:
        """Code lengths in bits: [context of ``ORDER`` symbols and byte, language]."""
        if self.name not in _TABLES:
            _TABLES.clear()
            _TABLES[self.name] = Table(self.cells, self.symbols)
        return _TABLES[self.name]


class Table:
    """Code lengths of the seen cells and escapes of the seen contexts of each language and order; nothing else is stored."""

    def __init__(self, cells: list[list[tuple[np.ndarray, np.ndarray]]], size: int):
        self.size = size
        self.languages = [[code_lengths(index, count, size) for index, count in c] for c in cells]

    def __getitem__(self, at: tuple[int, int]) -> float:
        return float(self.bits(np.array([at[0]], dtype=np.uint32), at[1])[0])

    def bits(self, index: np.ndarray, language: int) -> np.ndarray:
        """Bits of each (longest context, byte): from the longest order down to -1, as far as each must escape."""
        out = np.zeros(len(index), dtype=np.float32)
        left = np.arange(len(index))
        for order in range(ORDER, -1, -1):
            cells, lengths, contexts_seen, escapes = self.languages[language][order]
            key = index[left] & np.uint32(self.size ** (order + 1) - 1)
            at, hit = _find(cells, key)
            out[left[hit]] += lengths[at[hit]]
            left, key = left[~hit], key[~hit]
            at, hit = _find(contexts_seen, key // np.uint32(self.size))
            out[left[hit]] += escapes[at[hit]]
        out[left] += np.float32(np.log2(self.size))
        return out


_TABLES: dict[str, Table] = {}


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(among):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def symbols_of(texts: list[bytes], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``ORDER`` blanks that stand for its beginning, and each text's start."""
    pad = b" " * ORDER
    starts = np.cumsum([0] + [len(t) + ORDER for t in texts[:-1]])
    return alphabet[np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)], starts


def contexts(symbols: np.ndarray, size: int, order: int) -> np.ndarray:
    """Index of (``order`` symbols, next symbol) at each position from ``ORDER`` on."""
    n = max(0, len(symbols) - ORDER)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(order, -1, -1):
        out *= np.uint32(size)
        out += symbols[ORDER - k: ORDER - k + n]
    return out


def code_lengths(index: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seen cells of one order, their bits, their contexts, and the bits of an escape from each; an unseen one escapes free."""
    seen, first, distinct = np.unique(index // np.uint32(size), return_index=True, return_counts=True)
    total = np.add.reduceat(count, first) if len(count) else count
    bits = np.log2(np.repeat(total + distinct, distinct) / count).astype(np.float32)
    return index, bits, seen, np.log2((total + distinct) / distinct).astype(np.float32)


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Count the context trees of each language's sample texts."""
    languages = sorted(samples)
    counted = []
    for language in languages:
        s, starts = symbols_of([fold(t) for t in samples[language]], _FOLD)
        inside = np.ones(max(0, len(s) - ORDER), dtype=bool)
        for k in range(ORDER):  # padding is context only
            at = starts + k - ORDER
            inside[at[(at >= 0) & (at < len(inside))]] = False
        parts = [np.unique(contexts(s, SYMBOLS, k)[inside], return_counts=True) for k in range(ORDER + 1)]
        counted.append(parts)
    digest = hashlib.sha256(repr((languages, SYMBOLS)).encode())
    for parts in counted:
        for index, count in parts:
            digest.update(index.tobytes() + count.tobytes())
    return Model(languages, _FOLD, SYMBOLS, counted, digest.hexdigest())


def fold(text: bytes) -> bytes:
    return b" ".join(text.split())


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """Total code length in bits of each text under each language."""
    folded = [fold(t) + b" " for t in texts]
    s, starts = symbols_of(folded, model.alphabet)
    out = np.zeros((len(texts), len(model.languages)))
    table = model.table
    edges = np.stack([starts, starts + [len(t) for t in folded]], axis=1).ravel()  # a text, then the padding before the next
    for begin in range(0, int(edges[-1]), BLOCK):
        end = min(begin + BLOCK, int(edges[-1]))
        index, place = np.unique(contexts(s[begin: end + ORDER], model.symbols, ORDER), return_inverse=True)
        parts = np.arange(np.searchsorted(edges, begin, "right") - 1, np.searchsorted(edges, end))
        cuts, texts_only = np.maximum(edges[parts], begin) - begin, parts % 2 == 0
        for k in range(len(model.languages)):
            sums = np.add.reduceat(table.bits(index, k)[place], cuts, dtype=np.float64)
            out[parts[texts_only] // 2, k] += sums[texts_only]
    return out


def judged(model: Model, texts: list[bytes], strict: bool = False) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; ``strict``: ``und`` if no language codes the text better than order -1 alone."""
    named, sure = ["und"] * len(texts), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if model.languages and LETTER.search(t.decode())]
    if real:
        bits = score(model, [texts[i] for i in real])
        best = bits.argmin(axis=1)
        weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
        for i, b, p, least in zip(real, best, weight.max(axis=1) / weight.sum(axis=1), bits.min(axis=1)):
            if not strict or least < np.log2(model.symbols) * (len(fold(texts[i])) + 1):
                named[i], sure[i] = model.languages[b], p
    return named, sure


def _scored(model: Model, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``keep``: all columns and the language, judged strictly; else id, language and score. Slices share the batch's memory."""
    def run(batches):
        for part in slices(batches, "text", size=1 << 20):
            at = part.schema.get_field_index("text")
            named, sure = judged(model, as_bytes(part.column(at)), strict=keep)
            lang = pa.array(named, pa.string())
            if keep:
                yield pa.RecordBatch.from_arrays([*part.columns, lang], names=[*part.schema.names, LANGUAGE])
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), lang, pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])
    return run


def train(labelled: DataFrame, docs_each: int = TRAIN_DOCS) -> Model:
    """Model from ``labelled`` (doc_id, text, lang): ids of the sample are chosen first, then only their texts are read.

    The sample is the ``docs_each`` smallest distinct keys (hashes of id and text) of each language: a bounded set, whatever the
    table's size, and repeated rows count once. Keys are spread evenly, so an estimate of their number tells below which
    one the sample lies; only keys below it are sorted, four times the sample or so, and more where that was too few.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.octet_length("text").between(1, TRAIN_BYTES))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text")
    keyed = known.select("lang", key.alias("_key"))
    numbers = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("_key").alias("n")).collect()}
    share = {lang: 4 * docs_each / max(1, n) for lang, n in numbers.items()}
    last: dict[str, int] = {}
    while share:
        below = None
        for lang, part in share.items():
            one = (F.col("lang") == lang) & (F.col("_key") <= F.lit(min((1 << 63) - 1, int((min(part, 1.0) - 0.5) * 2**64))))
            below = one if below is None else below | one
        ranked = keyed.filter(below).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_key")))
        found = ranked.filter(F.col("_rank") <= docs_each).groupBy("lang").agg(F.max("_key").alias("last"), F.count(F.lit(1)).alias("n")).collect()
        last |= {r["lang"]: r["last"] for r in found if r["n"] == docs_each or share[r["lang"]] >= 1}
        share = {lang: 4 * part for lang, part in share.items() if lang not in last}
    if not last:
        return Model([], np.zeros(256, np.uint8), 1, [])
    take = None
    for lang, upto in last.items():
        one = (F.col("lang") == lang) & (key <= F.lit(upto))
        take = one if take is None else take | one
    samples: dict[str, list[bytes]] = {}
    for lang, text in known.filter(take).select("lang", F.col("text").cast("binary")).distinct().collect():
        samples.setdefault(lang, []).append(bytes(text))
    return fit(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model, False), "doc_id long, lang_pred string, score double")


def flagged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and the predicted language of each row as ``LANGUAGE``: ``und`` also for an unknown one."""
    return docs.mapInArrow(_scored(model, True), StructType([*docs.schema.fields, StructField(LANGUAGE, StringType())]))
