"""Operator 6: exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A term is a dimension and a posting is (row, weight) of a non-zero component. Queries are dealt into blocks of about ``BLOCK``
rows and candidates into slices of about ``SLICE`` rows, both by hash, and every block meets every slice in a task of its own:
neither side is collected, and a task's memory doesn't grow with the tables. A task scores its rows a few thousand at a
time: the non-zero components of the queries are walked dimension by dimension, and each posting list is scattered,
weighted, into the dense score array. A partition selection keeps each query's best k of the rows so far, and the
tasks' lists are merged by one window per query.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, neither does a row without
an id; an empty vector scores 0 with everything; where lengths differ, missing components count as 0; components beyond 2**27
count as that, so that the product of two vectors of up to 256 of them fits a long. A candidate with the query's own id is
never its answer, repeated rows each count, and of queries that repeat an id the least vector asks. Components are
integers after scaling and scores are exact 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import vectors as V

BLOCK, SLICE, ROWS = 4096, 32768, 2048
CELLS = 1 << 21


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and integer components floor(scale * x) of every row that takes part."""
    return V.kept(rows.filter("vec_id IS NOT NULL"), scale=scale)


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores, one line a query: term at a time over the postings of ``rows``."""
    scores = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        using, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(rows[:, term])
        if not len(using) or not len(posting):
            continue
        weights = rows[posting, term]
        whole = len(posting) == len(rows)
        for q in using:
            if whole:
                scores[q] += queries[q, term] * weights
            else:
                scores[q, posting] += queries[q, term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best (ids, scores), ties to the smaller id; partition selection first, then a small sort."""
    out = []
    for line, me in zip(scores, own):
        at = np.flatnonzero(ids != me)
        if len(at) > k:
            cut = np.partition(line[at], len(at) - k)[len(at) - k]
            above = at[line[at] > cut]
            level = at[line[at] == cut]
            if len(above) + len(level) > k:
                level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
            at = np.concatenate((above, level))
        at = at[np.lexsort((ids[at], -line[at]))][:k]
        out.append((ids[at], line[at]))
    return out


def scorer(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of queries against a slice of rows: the best k rows of each query."""
    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids = np.asarray(block["vec_id"], dtype=np.int64)
        ids = np.asarray(rows["vec_id"], dtype=np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
        if len(query_ids) and len(ids):
            widths = [int(np.asarray(t["q"].combine_chunks().value_lengths()).max(initial=0)) for t in (block, rows)]
            queries = V.matrix(block["q"].combine_chunks(), max(widths))
            step = max(64, min(ROWS, CELLS // len(query_ids)))
            for start in range(0, len(ids), step):
                part = V.matrix(rows["q"].slice(start, step).combine_chunks(), max(widths))
                for q, (i, s) in enumerate(best(accumulate(queries, part), ids[start: start + step], query_ids, k)):
                    i, s = np.concatenate((held[q][0], i)), np.concatenate((held[q][1], s))
                    keep = np.lexsort((i, -s))[:k]
                    held[q] = (i[keep], s[keep])
        n = [len(i) for i, _ in held]
        lists = [np.concatenate([x[c] for x in held]) if held else np.zeros(0, np.int64) for c in (0, 1)]
        return pa.table([pa.array(np.repeat(query_ids, n)), pa.array(lists[0]), pa.array(lists[1])], names=["query_id", "vec_id", "score"])
    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query (both: vec_id, q as ``quantised`` gives them)."""
    asked = written(queries.groupBy("vec_id").agg(F.min("q").alias("q")))
    blocks, slices = max(1, -(-asked.count() // block)), max(1, -(-candidates.count() // rows))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("slice", numbers(slices))
    right = candidates.select("vec_id", "q").withColumn("slice", F.pmod(F.xxhash64("vec_id", "q"), F.lit(slices)).cast("int")).withColumn("block", numbers(blocks))
    every = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(scorer(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
