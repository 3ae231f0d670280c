"""Set algebra on key tables and projections of the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifest import expand_items


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def coverage_gap(expected: DataFrame, found: DataFrame, keys) -> DataFrame:
    """JN20: keys missing from ``found`` and keys nobody expected."""
    keys = list(keys)
    missing = expected.select(*keys).join(found.select(*keys), keys, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(*keys).join(expected.select(*keys), keys, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def coverage_report(expected: DataFrame, found: DataFrame, keys) -> DataFrame:
    total = expected.agg(F.count(F.lit(1)).alias("_n"))  # one row
    gap = coverage_gap(expected, found, keys).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return gap.join(F.broadcast(total)).select("side", "n", (F.col("n") / F.col("_n")).alias("fraction"))


def combine_support(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """SE02: expanded training rows and untouched holdout rows."""
    return train.unionByName(holdout)


def draw_candidates(items: DataFrame, split: str) -> DataFrame:
    """SE03: one split in sampler columns; ``empty_split`` tells whether it has any."""
    return items.filter(F.col("split") == split).select(
        "sample_id", "t0_utc", "lead_hours", "condition_signature", "block_id", "stratum", "split", "p_target", "fold_id")


def empty_split(items: DataFrame, split: str) -> DataFrame:
    """Violation row of a split without items."""
    n = items.filter(F.col("split") == split).agg(F.count(F.lit(1)).alias("n"))
    return n.filter("n = 0").select(F.lit("empty_split").alias("rule"), F.lit(split).alias("key"), F.lit("").alias("detail"))


def eligible_ids(index: DataFrame) -> DataFrame:
    """SE04: identity universe derived from the compact index alone."""
    return expand_items(index).select("sample_id").distinct()
