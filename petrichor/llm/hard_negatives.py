"""Operator 13: hard-negative mining with a multiway hyperplane tree.

1. A tree is grown on a bounded sample (``gnat``); every row goes down to a leaf, and the ranges of distances that the nodes
   store are taken over all rows.
2. A search asks, for each anchor, for the best rows inside windows of inner products. It looks into the anchor's own leaf
   first; the k-th best find there raises a window's lower end. Then each anchor goes down the tree once more, siblings
   whose ranges miss the annuli of all its windows are eliminated, and the leaves that remain are searched exactly.
3. Positives are the best rows of the anchor's label in an open window; each positive opens a window for negatives.

Anchors and rows meet by leaf. A leaf with many rows, or one that many anchors visit, is cut in blocks by hash, and a task gets one block
of each: so its memory doesn't grow with a hot leaf or a hot label. A block's product is exact in integers, and every block
returns at most k rows a window; one window function merges them. Sizes of leaves are all that the driver sees.

Defined cases: a row without id or label, or whose vector is null or holds a null or non-finite component, takes no part;
missing components count as 0, those beyond 2**27 as that (vectors of more than 64 components are held within less, so that
products fit a long); rows that repeat an id are all candidates, but never for an anchor of that id, and the least of them in (label, vector) is the anchor; an anchor without
positives, a positive below 0 and one without rows in its window give nothing; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from . import vectors as V
from .gnat import Tree

#: Sample rows of the tree, children of a node, levels of nodes, sample rows at which a node is a leaf.
SAMPLE, FANOUT, DEPTH, LEAST = 4096, 8, 2, 64
#: Most rows and anchors of the blocks that a task compares.
BLOCK_ROWS, BLOCK_ANCHORS, STRIP = 32768, 2048, 128
FAR = 1 << 62
QUERY = "anchor_id long, label long, q array<int>, home int, keys array<long>, low array<long>, high array<long>"


def _leaves(tree: Tree, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            _, leaf = tree.walk(V.matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "label", "q", "leaf"])
    return run


RANGES = "node int, point int, child int, low long, high long, norm_low long, norm_high long"


def _ranges(tree: Tree, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranges of each node's points to what is below each child, one row a (node, point, child) and task."""
    def run(batches):
        held: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            x = V.matrix(batch.column(0), width)
            norm = (x * x).sum(axis=1)
            for node, at, d, to in tree.walk(x)[0]:
                for j in np.unique(to):
                    here = to == j
                    n = norm[at[here]]
                    for i, (low, high) in enumerate(zip(d[here].min(axis=0), d[here].max(axis=0))):
                        now = [int(low), int(high), int(n.min()), int(n.max())]
                        old = held.setdefault((node.number, i, int(j)), now)
                        held[node.number, i, int(j)] = [min(old[0], now[0]), max(old[1], now[1]), min(old[2], now[2]), max(old[3], now[3])]
        if held:
            cols = list(zip(*[(*k, *v) for k, v in held.items()]))
            kinds = [pa.int32()] * 3 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["node", "point", "child", "low", "high", "norm_low", "norm_high"])
    return run


class Index:
    """All rows under a leaf each, as a written table, and the tree with the ranges of all of them."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, depth: int = DEPTH, least: int = LEAST):
        rows = written(rows)
        self.width = rows.agg(F.max(F.size("q")).alias("n")).first()["n"] or 0
        drawn = [r["q"] for r in rows.select("q", F.xxhash64("vec_id", "q").alias("_h")).orderBy("_h", "q").limit(sample).collect()]
        x = np.zeros((len(drawn), self.width), dtype=np.int64)
        for line, q in zip(x, drawn):
            line[: len(q)] = q
        self.tree = Tree(x, fanout, depth, least)
        self.rows = written(rows.mapInArrow(_leaves(self.tree, self.width), "vec_id long, label long, q array<int>, leaf int"))
        found = self.rows.select("q").mapInArrow(_ranges(self.tree, self.width), RANGES).groupBy("node", "point", "child").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"))
        self.tree.ranges([tuple(r) for r in found.collect()])  # at most nodes x fanout x fanout
        self.sizes = self._by_leaf(self.rows)

    def _by_leaf(self, df: DataFrame) -> list[int]:
        out = [0] * self.tree.leaves
        for r in df.groupBy("leaf").count().collect():
            out[r["leaf"]] = r["count"]
        return out


def _visits(tree: Tree, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with the leaves that elimination leaves over, their own leaf apart."""
    def run(batches):
        for batch in batches:
            x = V.matrix(batch.column(2), width)
            low, high = _windows(batch, 5, 1), _windows(batch, 6, 0)
            seen = tree.visited(x, low, high)
            seen[np.arange(len(x)), np.asarray(batch.column(3))] = False
            row, leaf = np.nonzero(seen)
            ends = np.concatenate(([0], np.cumsum(seen.sum(axis=1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "leaves"])
    return run


def _windows(batch, column: int, fill: int) -> np.ndarray:
    """Window ends as a matrix; a row with fewer windows gets empty ones (low 1, high 0)."""
    lists = batch.column(column)
    n = np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.full((len(n), int(n.max(initial=0))), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.asarray(lists.flatten(), dtype=np.int64)
    return out


FOUND = "anchor_id long, key long, other_id long, score long"


def _best(line: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of ``at`` with the largest values in ``line``, ties to smaller ids."""
    if len(at) > k:
        cut = np.partition(line[at], len(at) - k)[len(at) - k]
        at = at[line[at] >= cut]
    return at[np.lexsort((ids[at], -line[at]))][:k]


def _compare(same: bool, k: int, width: int):
    """A block of queries against a block of rows: the best k of each window."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and rows.num_rows:
            q, r = queries.combine_chunks().to_batches()[0], rows.combine_chunks().to_batches()[0]
            name = lambda b, c: b.column(b.schema.get_field_index(c))
            ids, labels, x = np.asarray(name(r, "vec_id")), np.asarray(name(r, "label")), V.matrix(name(r, "q"), width)
            mine, label, a = np.asarray(name(q, "anchor_id")), np.asarray(name(q, "label")), V.matrix(name(q, "q"), width)
            keys, lows, highs = name(q, "keys").to_pylist(), name(q, "low").to_pylist(), name(q, "high").to_pylist()
            for start in range(0, len(a), STRIP):
                scores = V.product(a[start: start + STRIP], x)
                for line, i in zip(scores, range(start, start + len(scores))):
                    fit = ((labels == label[i]) == same) & (ids != mine[i])
                    for key, low, high in zip(keys[i], lows[i], highs[i]):
                        at = _best(line, ids, np.flatnonzero(fit & (line >= low) & (line <= high)), k)
                        out.append((np.full(len(at), mine[i]), np.full(len(at), key), ids[at], line[at]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "key", "other_id", "score"])
    return run


def _meet(index: Index, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """Each visit (a query and a leaf) against the rows of its leaf, block by block."""
    every = F.lit(0).cast("int")

    def blocks(counts: list[int], most: int) -> Column:
        return F.get(F.array(*[F.lit(max(1, -(-n // most))) for n in counts]), F.col("leaf"))

    visits = written(visits)
    counts = index._by_leaf(visits)
    nr, na = blocks(index.sizes, BLOCK_ROWS), blocks(counts, BLOCK_ANCHORS)
    left = visits.withColumn("part", F.pmod(F.xxhash64("anchor_id"), na).cast("int")).withColumn("block", F.explode(F.sequence(every, nr - 1)))
    right = index.rows.filter(F.col("leaf").isin([i for i, n in enumerate(counts) if n])).withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), nr).cast("int")).withColumn("part", F.explode(F.sequence(every, na - 1)))
    by = ["leaf", "block", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare(same, k, index.width), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _queries(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors (anchor_id, label, q, home) with their windows (anchor_id, key, low, high) as arrays: a few a row."""
    w = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("key", "low", "high"))).alias("w"))
    return anchors.join(w, "anchor_id").select("anchor_id", "label", "q", "home", F.col("w.key").alias("keys"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def search(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, key, other_id, score, rank: the k best rows of every window, of the anchor's label (``same``) or of others."""
    windows = written(windows)
    own = written(_meet(index, _queries(anchors, windows).withColumn("leaf", F.col("home")), same, k))
    raised = _ranked(own, k).filter(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("_raised"))
    narrow = windows.join(raised, ["anchor_id", "key"], "left").select("anchor_id", "key", F.greatest("low", "_raised").alias("low"), "high")
    visits = (_queries(anchors, narrow).mapInArrow(_visits(index.tree, index.width), QUERY + ", leaves array<int>")
              .withColumn("leaf", F.explode("leaves")).drop("leaves"))
    return _ranked(own.unionByName(_meet(index, visits, same, k)), k)


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), **tree) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor of ``rows`` (vec_id, label, embedding).

    A negative's score lies between ``low`` and ``high`` (fractions) of the positive's. ``is_anchor`` is a condition on vec_id.
    """
    held = V.kept(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL"), also=("label",)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "q")
    index = Index(held, **tree)
    anchors = written(index.rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q", "leaf")).alias("r")).select(
        F.col("vec_id").alias("anchor_id"), "r.label", "r.q", F.col("r.leaf").alias("home")))
    whole = anchors.select("anchor_id", F.lit(0).cast("long").alias("key"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    found = written(search(index, anchors, whole, True, positives).select(
        "anchor_id", F.col("rank").cast("long").alias("key"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(38,0)")
    window = found.filter("positive_score >= 0").select(
        "anchor_id", "key", F.ceil(score * low[0] / low[1]).cast("long").alias("low"), F.floor(score * high[0] / high[1]).cast("long").alias("high"))
    result = search(index, anchors, window, False, negatives)
    return result.join(found, ["anchor_id", "key"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
                                                          "positive_score", F.col("score").alias("negative_score"))
