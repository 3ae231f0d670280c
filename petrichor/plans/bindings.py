"""How the driver tables feed the operators; every binding has its SQL twin next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T
from ..operators.splits import Split
from ..session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    """Compared doubles are rounded to six decimals on both sides; + 0.0 removes a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- events as slots -------------------------------------------------------------------------------
def slots(spark, sf, minutes: int) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), T.slot_index("ts", minutes).alias("slot")).distinct()


def slots_sql(minutes: int) -> str:
    return (f"slots as (select distinct event_type as source, epoch_us(ts) // {minutes * 60_000_000} as slot "
            f"from events)")


def all_slots(spark, sf, minutes: int) -> DataFrame:
    return table(spark, sf, "events").select(T.slot_index("ts", minutes).alias("slot")).distinct()


def all_slots_sql(minutes: int) -> str:
    return f"slots as (select distinct epoch_us(ts) // {minutes * 60_000_000} as slot from events)"


def whole_slots(spark, sf, minutes: int) -> DataFrame:
    """Slots whose frame is whole: one that begins and ends with an error message is broken. Some slots are broken at
    every scale, so there are always several runs and events."""
    e = table(spark, sf, "events").groupBy(T.slot_index("ts", minutes).alias("slot")).agg(
        F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"))
    return e.filter("not (a = 'error' and b = 'error')").select("slot")


def whole_slots_sql(minutes: int) -> str:
    return (f"slots as (select epoch_us(ts) // {minutes * 60_000_000} as slot from events group by 1 having not "
            f"(arg_min(event_type, event_id) = 'error' and arg_max(event_type, event_id) = 'error'))")


def slot_ts_sql(col: str, minutes: int) -> str:
    return f"(make_timestamp(({col}) * {minutes * 60_000_000}))"


# --- splits over the 30 days of events ---------------------------------------------------------------
SPLITS = (
    Split("outer_train", "2024-01-01 00:00:00", "2024-01-19 00:00:00"),
    Split("model_selection", "2024-01-19 00:00:00", "2024-01-23 00:00:00"),
    Split("calibration", "2024-01-23 00:00:00", "2024-01-27 00:00:00"),
    Split("final_test", "2024-01-27 00:00:00", "2024-01-31 00:00:00"),
)
SPLITS_SQL = "splits(name, s, e, rank) as (values " + ", ".join(
    f"('{s.name}', timestamp '{s.start}', timestamp '{s.end}', {3 - i})" for i, s in enumerate(SPLITS)) + ")"

# --- policy (fixed values) ----------------------------------------------------------------------------
SOURCE_SIG = "era5_oracle:era=1:tp=1:full_trajectory"
TP_OFF_SIG = "era5_oracle:era=1:tp=0:full_trajectory"
NULL_SIG = "null_provider:era=0:tp=0:no_era_access"
POLICY = ((TP_OFF_SIG, 0.25, 0.25), (SOURCE_SIG, 0.5, 0.5), (NULL_SIG, 0.25, 0.25))
POLICY_SQL = "policy(ord, sig, pt, pd) as (values " + ", ".join(
    f"({i}, '{s}', {t}::double, {d}::double)" for i, (s, t, d) in enumerate(POLICY)) + ")"


# --- tables that the pipeline publishes once and reads many times --------------------------------------
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Let go of all published tables: the next query that needs one builds it again."""
    _STORED.clear()


def stored(fn):
    """Materialise a published table (event index, candidates, draws) once per application.

    It is written to the shared checkpoint folder, so later queries read a table instead of planning and
    running the whole pipeline again, and a lost executor does not lose it.
    """
    def run(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, f"{fn.__module__}.{fn.__name__}")
        if key not in _STORED:
            _STORED[key] = cut_lineage(fn(spark, sf))
        return _STORED[key]
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run
