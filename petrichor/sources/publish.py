"""Sinks and checked reads of the published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import draw_violations
from ..operators.validate import require_clean

INDEX_SCHEMA = "t0_utc timestamp_ntz, block_id string, split string, condition_signature string, available_leads_mask int"
DRAW_SCHEMA = ("global_example_index bigint, sample_id string, t0_utc timestamp_ntz, lead_hours double, condition_signature string, block_id string, "
               "stratum string, split string, p_target double, p_draw double, omega double, fold_id int")
STATS_SCHEMA = "grp string, channel string, ord int, n bigint, mean double, variance double, sd double, min double, max double"


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def index_audit_row(index: DataFrame) -> DataFrame:
    """Counts that a reader re-derives: rows, expanded items, blocks, splits."""
    return index.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.bit_count("available_leads_mask").cast("long")).alias("items"),
                     F.count_distinct("block_id").alias("blocks"), F.count_distinct("split").alias("splits"))


def write_event_index(index: DataFrame, path: str) -> None:
    """SC07: compact index, sorted inside files by time, with its audit row next to it."""
    (index.select(*_columns(INDEX_SCHEMA)).sortWithinPartitions("t0_utc", "condition_signature")
     .write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/index"))
    index_audit_row(index).write.mode("errorifexists").parquet(f"{path}/audit")


def read_event_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, mismatches): the columns must be exactly the schema, the counts must equal the audit row."""
    raw = spark.read.parquet(f"{path}/index")
    if raw.columns != _columns(INDEX_SCHEMA):
        raise ValueError(f"event index columns {raw.columns}")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    now, then = index_audit_row(index), spark.read.parquet(f"{path}/audit")
    return index, now.exceptAll(then)


def write_draws(draws: DataFrame, path: str) -> None:
    """SC08: JSON lines, splittable."""
    draws.select(*_columns(DRAW_SCHEMA)).write.mode("errorifexists").json(path)


def read_draws(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    draws = spark.read.schema(DRAW_SCHEMA).json(path)
    return draws, draw_violations(draws)


def write_candidates(items: DataFrame, meta: DataFrame, path: str) -> None:
    items.write.mode("errorifexists").parquet(f"{path}/items")
    meta.write.mode("errorifexists").parquet(f"{path}/meta")


def scan_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC09: (items, one-row metadata)."""
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/meta")


def write_stats(stats: DataFrame, path: str) -> None:
    """SC16: statistics with an explicit channel order."""
    stats.select(*_columns(STATS_SCHEMA)).coalesce(1).write.mode("errorifexists").json(path)  # one row per channel


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def publish_bundle(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> DataFrame:
    """SC10: all tables or none. They are written under a staging folder beside the target; one rename publishes.

    An existing target is refused. Returns rows per table, read back from the published files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(target)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(target)
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        if fs.exists(place) or not fs.rename(hadoop.Path(staging), place):
            raise FileExistsError(target)
    finally:
        if fs.exists(hadoop.Path(staging)):
            fs.delete(hadoop.Path(staging), True)
    out = None
    for name in tables:
        one = spark.read.parquet(f"{target}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["write_event_index", "read_event_index", "write_draws", "read_draws", "write_candidates", "scan_candidates", "write_stats",
           "read_stats", "publish_bundle", "require_clean"]
