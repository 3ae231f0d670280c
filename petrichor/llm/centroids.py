"""Operator 12: centroid clustering on a persistent matrix of exact integer dot products.

The state of a vector is its components and its dot product with every centroid. A round changes few components of a centroid
once clusters settle, so dots are updated by the non-zero component changes alone: x.c' = x.c + sum of x[j] * (c'[j] - c[j]).
The argmin of |c|^2 - 2 x.c is then taken again; |x|^2 is the same for all centroids. The first round starts from centroids
at zero, with all dots zero. A round is one map over the state, which writes the new state as a table, and one aggregation
of component sums that tasks have added up per centroid before. The driver holds centroids and their sums only: ``k`` times the dimensions,
whatever the number of vectors. A round's table replaces the one before it.

Everything is an integer, so the result depends neither on layout nor on order. A cluster of any size is spread over tasks.

Defined cases: a vector that is null, has another number of components, or holds a null or non-finite one takes no part; components
beyond 2**27 count as that; ties go to the smaller centroid number; with fewer vectors than ``k`` each is a centroid;
an empty centroid stays; repeated rows each count; rows without an id take part but start a centroid only where ids are too
few; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from . import vectors as V

STATE = "vec_id long, q array<int>, dots array<long>"
SUMS = "cluster int, n long, sums array<long>"
#: Vectors handled at a time inside a task.
ROWS = 4096


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(m.ravel(), kind))


def updated(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dots after each centroid moved by its row of ``change``: only changed components of changed centroids are read."""
    out = dots.copy()
    for c in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[c])
        out[:, c] += x[:, at] @ change[c, at]
    return out


def nearest(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector, ties to the smaller one."""
    return (norms[None, :] - 2 * dots).argmin(axis=1) if len(dots) else np.zeros(0, dtype=np.int64)


def _parts(batches: Iterator[pa.RecordBatch], dimensions: int, k: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = V.matrix(part.column(1), dimensions)
            dots = V.matrix(part.column(2), k) if part.num_columns > 2 else np.zeros((len(x), k), dtype=np.int64)
            yield part, x, dots


def _update(change: np.ndarray, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part, x, dots in _parts(batches, dimensions, len(change)):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(updated(x, dots, change), pa.int64())], names=["vec_id", "q", "dots"])
    return run


def _sums(norms: np.ndarray, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and component sums of each centroid's vectors, one row a centroid and task."""
    def run(batches):
        n, sums = np.zeros(len(norms), dtype=np.int64), np.zeros((len(norms), dimensions), dtype=np.int64)
        for _, x, dots in _parts(batches, dimensions, len(norms)):
            cluster = nearest(dots, norms)
            n += np.bincount(cluster, minlength=len(norms))
            np.add.at(sums, cluster, x)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), _lists(sums[at], pa.int64())], names=["cluster", "n", "sums"])
    return run


def _assigned(norms: np.ndarray, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part, x, dots in _parts(batches, dimensions, len(norms)):
            cluster = nearest(dots, norms)
            distance = (x * x).sum(axis=1) + norms[cluster] - 2 * dots[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    return run


def started(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id`` in order of it; repeated ids by their components, no id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in vectors.select("q", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def moved(centroids: list[list[int]], state: DataFrame, dimensions: int) -> list[list[int]]:
    """Exact floors of component means; an empty centroid stays. Sums pass 38 digits, so a long sum can't run over."""
    c = np.array(centroids, dtype=np.int64)
    per_task = state.mapInArrow(_sums((c * c).sum(axis=1), dimensions), SUMS)
    each = per_task.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out = [list(x) for x in centroids]
    for r in each.collect():  # k times the dimensions
        out[r["cluster"]][r["at"]] = int(r["sum"]) // r["n"]
    return out


def clustered(rows: DataFrame, k: int = 40, dimensions: int = 64, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector of ``rows`` (vec_id, embedding)."""
    spark, old = rows.sparkSession, []
    state = written(V.kept(rows, dimensions), old)
    centroids = started(state, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = [[0] * dimensions for _ in centroids]
    for turn in range(rounds + 1):
        change = np.array(centroids, dtype=np.int64) - np.array(at, dtype=np.int64)
        new: list[str] = []
        state = written(state.mapInArrow(_update(change, dimensions), STATE), new)
        dropped(spark, old)
        old, at = new, centroids
        if turn < rounds:
            centroids = moved(centroids, state, dimensions)
    c = np.array(centroids, dtype=np.int64)
    found = written(state.mapInArrow(_assigned((c * c).sum(axis=1), dimensions), "vec_id long, cluster int, distance long"))
    dropped(spark, old)
    each = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda n: min(n, (1 << 63) - 1)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]
    table = spark.createDataFrame([(i, held(each.get(i, 0)), held(sum(each.values())), names[i]) for i in range(len(names))],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
