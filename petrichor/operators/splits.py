"""Chronological splits as configuration: at most four named ranges, compiled to one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: legal names, highest priority first
PRIORITY = ("final_test", "calibration", "model_selection", "outer_train")


@dataclass(frozen=True)
class Split:
    name: str
    start: str  # ISO text, UTC, inclusive
    end: str    # exclusive


def check_splits(splits) -> list[tuple[str, str]]:
    """VA01: rule and name of every broken split rule (configuration, not rows)."""
    bad = [("unknown_name", s.name) for s in splits if s.name not in PRIORITY]
    bad += [("empty", s.name) for s in splits if s.start >= s.end]
    names = [s.name for s in splits]
    bad += [("duplicate_name", n) for n in sorted(set(names)) if names.count(n) > 1]
    ordered = sorted(splits, key=lambda s: s.start)
    bad += [("overlap", b.name) for a, b in zip(ordered, ordered[1:]) if b.start < a.end]
    return bad


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def assign_split(dep_start, dep_end, splits) -> Column:
    """JN03: split holding the whole dependency; null = embargoed. No join: the ranges are literals."""
    out = F.lit(None).cast("string")
    for s in splits:
        inside = (dep_start >= _ntz(s.start)) & (dep_end < _ntz(s.end))
        out = F.when(inside, F.lit(s.name)).otherwise(out)
    return out


def priority_rank(split) -> Column:
    out = F.lit(len(PRIORITY))
    for i, name in enumerate(PRIORITY):
        out = F.when(split == name, F.lit(i)).otherwise(out)
    return out


def resolve_event_split(rows: DataFrame, block: str = "block_id", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """JN04: one split per event by priority; returns (kept, dropped)."""
    best = rows.groupBy(block).agg(F.min_by(split, priority_rank(F.col(split))).alias("_best"))
    joined = rows.join(best, block)
    same = F.col(split) == F.col("_best")
    return joined.filter(same).drop("_best"), joined.filter(~same).drop("_best")
