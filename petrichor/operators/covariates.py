"""Hourly covariates: canonical fields, windows with separate masks, cycles, overlap resampling, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signature as SG
from ..functions import time as T
from .ordered import placed, running_last


def canonicalize_fields(fields: DataFrame, channels) -> DataFrame:
    """PR25: fields (short_name, level, units, step_type, valid_time, interval_start, interval_end, value).

    ``channels`` is configuration: (short_name, level or None, channel, units, accumulated) for a few dozen
    channels, compiled to a literal map. ``problem`` names the first broken rule; accumulated metres become mm.
    """
    entries = []
    for short, level, name, units, acc in channels:
        entries += [F.lit(f"{short}@{level or 0}"), F.struct(F.lit(name).alias("name"), F.lit(units).alias("units"), F.lit(acc).alias("acc"))]
    spec = F.create_map(*entries)
    key = F.concat(F.lower(F.trim("short_name")), F.lit("@"), F.coalesce(F.col("level"), F.lit(0)).cast("string"))
    d = fields.withColumn("_s", F.try_element_at(spec, key))
    c, acc = F.col, F.col("_s.acc")
    hour = F.pmod(T.micros("valid_time"), F.lit(3_600_000_000)) == 0
    problem = (F.when(c("_s").isNull(), "unknown_channel").when(~hour, "not_on_hour")
               .when(acc & (c("step_type") != "accum"), "step_type").when(~acc & (c("step_type") != "instant"), "step_type")
               .when(c("units") != c("_s.units"), "units")
               .when(acc & (c("interval_start").isNull() | c("interval_end").isNull()), "no_interval")
               .when(~acc & (c("interval_start").isNotNull() | c("interval_end").isNotNull()), "unexpected_interval")
               .when(acc & ((c("interval_end") != c("valid_time")) | (c("interval_start") != T.add_minutes("valid_time", -60))), "interval")
               .when(acc & (c("value") < 0), "negative").when(c("value").isNull() | F.isnan("value"), "not_finite"))
    return d.select(*fields.columns, c("_s.name").alias("channel"), problem.alias("problem"),
                    F.when(problem.isNull(), F.when(acc, c("value") * 1000.0).otherwise(c("value"))).alias("canonical"))


def covariate_window(draws: DataFrame, hours: DataFrame, lead_minutes: Column, mode: Column, hours_n: int = 8,
                     horizon_minutes: int = 360) -> DataFrame:
    """JN07: eight hours per row, left-joined to (valid_time, inst, tp); masks stay separate.

    Absent source: values are exactly zero and access is closed, but data_valid still tells what exists.
    ``violation`` marks a required hour without instantaneous data.
    """
    need = draws.withColumn("_l", lead_minutes).withColumn("_m", mode).withColumn(
        "_h", F.explode(T.native_hours(F.col("t0_utc"), hours_n)))
    j = need.join(hours.select(F.col("valid_time").alias("_h"), "inst", "tp"), "_h", "left")
    f = SG.fields(F.col("condition_signature"))
    era, tp_on = f["era"], f["era"] & f["tp"]
    inst_ok, tp_ok = F.col("inst").isNotNull(), F.col("tp").isNotNull()
    traj = T.trajectory_mask(F.col("_h"), F.col("t0_utc"), horizon_minutes)
    acc = T.access_mask(F.col("_h"), F.col("t0_utc"), F.col("_l"), F.col("_m"), horizon_minutes)
    return j.select(
        *draws.columns, F.col("_h").alias("valid_time"),
        F.when(era & inst_ok, F.col("inst")).otherwise(F.lit(0.0)).alias("inst"),
        F.when(tp_on & tp_ok, F.col("tp")).otherwise(F.lit(0.0)).alias("tp"),
        inst_ok.alias("data_valid_inst"), tp_ok.alias("tp_valid"), traj.alias("trajectory"), (era & acc).alias("access"),
        era.alias("era_present"), tp_on.alias("tp_present"), (era & traj & acc & ~inst_ok).alias("violation"))


def asof_cycle(issues: DataFrame, cycles: DataFrame, latency: int, partitions: int | None = None, t0: str = "t0_day", cycle: str = "cycle_day",
               lead: str | None = None) -> DataFrame:
    """JN08: the latest cycle c with c + latency <= t0, its age, and what its availability is old.

    ``t0``, ``cycle``, ``latency`` and ``lead`` are whole numbers of one unit, whichever: days, seconds, microseconds. With ``lead``
    there is ``rollout_lead`` too, the time from the cycle to t0 + lead. Cycles at the instants from which they may be used and
    issues go through one global order, range parts of bounded size, and the last cycle is carried along; each issue is read
    once and joined with nothing. Many issues of one instant are told apart by a hash of the row, so they fill several parts.
    An issue without time, or before the first cycle, has no cycle.
    """
    rows = issues.select(F.col(t0).alias("_at"), F.lit(1).alias("_kind"), F.struct(*issues.columns).alias("_row"), F.xxhash64(*issues.columns).alias("_h"), F.lit(None).cast("long").alias("_c"))
    known = cycles.filter(F.col(cycle).isNotNull()).select(F.col(cycle).cast("long").alias("_c")).distinct()
    known = known.select((F.col("_c") + latency).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("_c").alias("_h"), "_c")
    line = placed(known.unionByName(rows), ["_at", "_kind", "_h"], partitions)
    found = running_last(line, [], "_part", "_pos", {"_c": F.col("_c")}).filter("_kind = 1")
    age = F.col("_at") - F.col("_c")
    extra = [] if lead is None else [(age + F.col(f"_row.{lead}")).alias("rollout_lead")]
    return found.select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_c")).alias(cycle), age.alias("cycle_age"), (age - latency).alias("availability_age"), *extra)


def overlap_resample(hourly: DataFrame, windows: DataFrame, key, width: int = 3600) -> DataFrame:
    """JN09: windows (key, wid, ws, we) in seconds against intervals (js, je, amount), also in seconds.

    Amount is shared by overlap; a window not fully covered gives null. Equi-join on the hour bucket of both.
    """
    key = list(key)

    def buckets(a, b):
        return F.sequence(F.call_function("div", a, F.lit(width)), F.call_function("div", b - 1, F.lit(width)))
    left = windows.withColumn("_b", F.explode(buckets(F.col("ws"), F.col("we"))))
    right = hourly.withColumn("_b", F.explode(buckets(F.col("js"), F.col("je"))))
    # a pair that shares several buckets counts only in the bucket of its overlap start
    a, b = F.greatest("ws", "js"), F.least("we", "je")
    j = left.join(right, [*key, "_b"]).withColumn("_o", b - a).filter(
        (F.col("_o") > 0) & (F.call_function("div", a, F.lit(width)) == F.col("_b")))
    g = j.groupBy(*key, "wid").agg(F.sum(F.col("amount") * F.col("_o") / (F.col("je") - F.col("js"))).alias("_a"), F.sum("_o").alias("_cover"))
    return windows.join(g, [*key, "wid"], "left").select(
        *key, "wid", F.when(F.col("_cover") == F.col("we") - F.col("ws"), F.col("_a")).alias("amount"),
        (F.coalesce("_cover", F.lit(0)) / (F.col("we") - F.col("ws"))).alias("cover"))


def expected_sources(found: DataFrame, groups: list[str], first_month: str, last_month: str) -> DataFrame:
    """SC11: (grp, month) calendar against found files; missing, unexpected, duplicate."""
    spark = found.sparkSession
    cal = (spark.range(1).select(F.explode(F.sequence(F.lit(first_month).cast("date"), F.lit(last_month).cast("date"),
                                                      F.expr("interval 1 month"))).alias("month"))
           .withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups]))))
    have = found.groupBy("grp", "month").agg(F.count(F.lit(1)).alias("n"))
    missing = cal.join(have, ["grp", "month"], "left_anti").select("grp", "month", F.lit("missing").alias("rule"))
    extra = have.join(cal, ["grp", "month"], "left_anti").select("grp", "month", F.lit("unexpected").alias("rule"))
    dup = have.filter("n > 1").select("grp", "month", F.lit("duplicate").alias("rule"))
    return missing.unionByName(extra).unionByName(dup)


def message_completeness(messages: DataFrame, channels: DataFrame, start: str, hours: int) -> DataFrame:
    """SC12: every (channel, hour) exactly once. Hours are generated per channel, so the grid grows with the calendar."""
    grid = channels.select("channel", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("_k")).select(
        "channel", F.timestamp_add("HOUR", F.col("_k"), F.lit(start).cast("timestamp_ntz")).alias("valid_time"))
    have = messages.groupBy("channel", "valid_time").agg(F.count(F.lit(1)).alias("n"))
    j = grid.join(have, ["channel", "valid_time"], "left")
    return j.groupBy("channel").agg(
        F.count(F.lit(1)).alias("expected"), F.count("n").alias("found"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.min(F.when(F.col("n").isNotNull(), F.col("valid_time"))).alias("first_time"),
        F.max(F.when(F.col("n").isNotNull(), F.col("valid_time"))).alias("last_time"))


def grid_violations(fields: DataFrame) -> DataFrame:
    """VA07: one field per (channel, hour), one grid over all files."""
    from .manifest import union_all, violation
    dup = fields.groupBy("channel", "valid_time").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    size = fields.agg(F.count_distinct("grid").alias("n")).filter("n > 1")  # over all channels and files
    none = fields.filter("grid is null or valid_time is null or channel is null")
    off = fields.filter(F.pmod(T.micros("valid_time"), F.lit(3_600_000_000)) != 0)
    return union_all([violation(dup, "repeated_field", F.concat_ws("|", "channel", "valid_time"), F.col("n")),
                      violation(size, "grid_changes", F.lit("all"), F.col("n")),
                      violation(none, "incomplete", F.concat_ws("|", "channel", "valid_time")),
                      violation(off, "not_on_hour", F.concat_ws("|", "channel", "valid_time"))])
