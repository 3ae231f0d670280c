"""Availability on fixed-width slots: runs, issue times, relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as T
from .events import merge_intervals

CHUNK_SLOTS = 2048


def distinct_slots(df: DataFrame, ts: str, minutes: int, by=()) -> DataFrame:
    """One row per (by, slot); all later slot work is on this small table, never on raw rows."""
    return df.select(*by, T.slot_index(ts, minutes).alias("slot")).distinct()


def runs(slots: DataFrame, by=(), chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """WN01: maximal runs of adjacent slots; ``slots`` must be distinct on (by, slot)."""
    by = list(by)
    points = slots.select(*by, F.col("slot").alias("run_start"), F.col("slot").alias("run_end"))
    return (merge_intervals(points, 1, by, "run_start", "run_end", chunk_slots)
            .withColumnRenamed("n_seeds", "run_len"))


def strict_issue_slots(slots: DataFrame, history: int = 12, horizon: int = 72, by=()) -> DataFrame:
    """WN02: issue slots whose whole dependency lies in one run.

    Derived from the runs alone: a run of n slots gives n - (history + horizon - 1) issue slots.
    """
    by = list(by)
    span = history + horizon
    return (runs(slots, by).filter(F.col("run_len") >= span)
            .select(*by, F.explode(F.sequence(F.col("run_start") + (history - 1),
                                              F.col("run_end") - horizon)).alias("slot")))


def available(issues: DataFrame, slots: DataFrame, required, by=(), keys=("slot",)) -> DataFrame:
    """JN01: keep issue rows all of whose required slots exist (relational division).

    ``required`` is an ARRAY<BIGINT> expression over ``issues``.
    """
    by, keys = list(by), list(keys)
    need = (issues.select(*by, *keys, F.size(required).alias("_need"), F.explode(required).alias("_slot")))
    have = slots.select(*by, F.col("slot").alias("_slot"))
    ok = (need.join(have, [*by, "_slot"], "left_semi")
          .groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_have"), F.first("_need").alias("_need"))
          .filter("_have = _need").select(*by, *keys))
    return issues.join(ok, [*by, *keys], "left_semi")


def availability_stats(slots: DataFrame, window: int = 84, by=()) -> DataFrame:
    """AG05: counts over the runs."""
    by = list(by)
    n = F.col("run_len")
    return (runs(slots, by).groupBy(*by).agg(
        F.sum(n).alias("timestamps"),
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.greatest(n - (window - 1), F.lit(0))).alias("windows"),
        F.sum((n >= window).cast("long")).alias("supporting_runs"),
        F.sum(F.call_function("div", n, F.lit(window))).alias("disjoint_blocks")))


def order_violations(items: DataFrame, position: str, keys, chunk: int = 1 << 20, by=()) -> DataFrame:
    """WN12: stored rows whose key is not strictly above the key of the row before.

    ``position`` is a dense index; each chunk of it is one task, and the last key of a chunk goes to the next.
    """
    keys, by = list(keys), list(by)
    here = items.withColumn("_chunk", F.floor(F.col(position) / chunk))
    w = W.partitionBy(*by, "_chunk").orderBy(position)
    edge = (here.groupBy(*by, "_chunk").agg(F.max_by(F.struct(*keys), position).alias("_edge"))
            .withColumn("_chunk", F.col("_chunk") + 1))
    prev = F.coalesce(F.lag(F.struct(*keys)).over(w), F.col("_edge"))
    return (here.join(edge, [*by, "_chunk"], "left").withColumn("_prev", prev)
            .filter(F.col("_prev").isNotNull() & (F.struct(*keys) <= F.col("_prev")))
            .select(*by, position, *keys))
