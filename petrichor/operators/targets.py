"""Window accumulations, history, persistence, activity and background classes on long pixel frames.

Frames are rows (slot, y, x, r, valid). An absent row is a missing scan, valid = false a masked pixel, r = 0
dry: the three never mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from .manifest import union_all, violation

PIXEL = ("y", "x")


def window_accumulation(frames: DataFrame, step_hours: float, n: int = 7, chunk: int = 4096) -> DataFrame:
    """Trapezoid over the n scans that end at each slot, once per (slot, pixel) for all issue times and leads.

    Scans are cut in time chunks with a halo of n-1 slots, so a pixel's whole history is never one task.
    Rows: end_slot, y, x, raw, scans, all_valid. Only complete windows (n scans) have a meaning.
    """
    at = F.col("slot") - F.pmod(F.col("slot"), F.lit(chunk))
    late = F.pmod(F.col("slot"), F.lit(chunk)) >= chunk - (n - 1)
    both = F.when(late, F.array(at, at + chunk)).otherwise(F.array(at))
    d = frames.withColumn("_chunk", F.explode(both))
    w = W.partitionBy(*PIXEL, "_chunk").orderBy("slot").rangeBetween(-(n - 1), 0)
    r = F.col("r")
    raw = (F.sum(r).over(w) - 0.5 * F.first(r).over(w) - 0.5 * r) * F.lit(step_hours)
    out = d.select(F.col("slot").alias("end_slot"), *PIXEL, "_chunk", raw.alias("raw"),
                   F.count(F.lit(1)).over(w).alias("scans"), F.min("valid").over(w).alias("all_valid"))
    return out.filter(F.col("_chunk") == F.col("end_slot") - F.pmod(F.col("end_slot"), F.lit(chunk))).drop("_chunk")


def accumulate_target(frames: DataFrame, issues: DataFrame, leads: list[int], step_hours: float, n: int = 7,
                      a_wet: float = V.A_WET, a0: float = V.A0) -> DataFrame:
    """AG01: (slot, lead) rows with raw, model, wet, z, valid; incomplete windows are dropped, masked ones kept."""
    acc = window_accumulation(frames, step_hours, n).filter(F.col("scans") == n)
    want = issues.select("slot", F.explode(F.array(*[F.lit(i) for i in leads])).alias("lead")).withColumn(
        "end_slot", F.col("slot") + F.col("lead"))
    valid = F.col("all_valid")
    raw = F.when(valid, F.col("raw"))
    return want.join(acc, "end_slot").select(
        "slot", "lead", *PIXEL, raw.alias("raw"), V.censored(raw, a_wet).alias("model"),
        F.coalesce(V.wet(raw, a_wet), F.lit(False)).alias("wet"), V.log_amount(raw, a_wet, a0).alias("z"), valid.alias("valid"))


def accumulate_trajectory(steps: DataFrame, leads: int = 12, per_lead: int = 6, step_hours: float = 5 / 60) -> DataFrame:
    """AG02: steps (item, step, rate, scan_valid, inflow, residence, confidence) to lead windows.

    A boundary step belongs to two leads; it is emitted once per lead and all sums are partial aggregates.
    """
    last = leads * per_lead
    step = F.col("step")
    own = F.call_function("div", step, F.lit(per_lead))
    lead = F.when((F.pmod(step, F.lit(per_lead)) == 0) & (step > 0) & (step < last), F.array(own - 1, own)
                  ).when(step == last, F.array(own - 1)).otherwise(F.array(own))
    d = steps.withColumn("lead", F.explode(lead)).withColumn(
        "_w", F.when((step == F.col("lead") * per_lead) | (step == (F.col("lead") + 1) * per_lead), 0.5).otherwise(1.0))
    g = d.groupBy("item", "lead").agg(
        F.count(F.lit(1)).alias("steps"), F.min("scan_valid").alias("valid"), F.sum(F.col("_w") * F.col("rate")).alias("_r"),
        (F.sum(F.col("_w") * F.col("inflow").cast("int")) / per_lead).alias("inflow_fraction"),
        F.min("residence").alias("residence"), (F.sum(F.col("_w") * F.col("confidence")) / per_lead).alias("confidence"))
    raw = F.when(F.col("valid"), F.col("_r") * F.lit(step_hours)).otherwise(F.lit(0.0))
    return (g.filter(F.col("steps") == per_lead + 1).withColumn("raw", raw).withColumn("z", V.log_amount(raw))
            .select("item", "lead", "valid", "raw", "z", "inflow_fraction", "residence", "confidence"))


def context_activity(frames: DataFrame, threshold: float = V.CONTEXT_THRESHOLD, min_pixels: int = 64, by=()) -> DataFrame:
    """AG03."""
    n = F.count_if(F.col("valid") & (F.col("r") >= threshold))
    return frames.groupBy(*by, "slot").agg(n.alias("active_pixels"), (n >= min_pixels).alias("active"))


def sentinel_counts(raw: DataFrame, by=(), codes=V.NULL_CODES) -> DataFrame:
    """AG04."""
    return raw.groupBy(*by).agg(*[F.count_if(F.col("raw") == c).alias(f"code_{abs(c)}") for c in codes])


def gather_history(issues: DataFrame, frames: DataFrame, n: int = 12) -> DataFrame:
    """JN05: history rows per issue slot, long; offset 0 is the oldest."""
    need = issues.select("slot", F.posexplode(F.sequence(F.col("slot") - (n - 1), F.col("slot"))).alias("offset", "_at"))
    return need.join(frames.withColumnRenamed("slot", "_at"), "_at").drop("_at")


def attach_label(conditions: DataFrame, labels: DataFrame) -> DataFrame:
    """JN06: join keys of the condition table with labels; label columns stay in their own table."""
    return conditions.select("slot").distinct().join(labels, "slot")


def persistence_baseline(frames: DataFrame, issues: DataFrame, leads: int = 12, window_hours: float = 0.5,
                         a_wet: float = V.A_WET) -> DataFrame:
    """JN25: the rate at issue time held through every lead; an invalid pixel stays invalid."""
    raw = F.when(F.col("valid"), F.col("r") * F.lit(window_hours))
    return (frames.join(issues.select("slot"), "slot", "left_semi")
            .select("slot", *PIXEL, "valid", V.censored(raw, a_wet).alias("model"), V.log_amount(raw, a_wet).alias("z"))
            .withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads)))))


def classify_background(issues: DataFrame, activity: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """IT04 on slot-level tables: activity (slot, active_pixels), targets (slot, any_wet, valid_pixels).

    ``class`` is strict_dry, marginal_background, or null with a ``problem``: a missing slot is not dry.
    """
    need = issues.select("slot", F.explode(F.sequence(F.col("slot") - before, F.col("slot") + after)).alias("_at"))
    seen = (need.join(activity.select(F.col("slot").alias("_at"), "active_pixels"), "_at", "left").groupBy("slot")
            .agg(F.count("active_pixels").alias("_have"), F.max("active_pixels").alias("_peak")))
    d = seen.join(targets, "slot", "left")
    problem = (F.when(F.col("_have") < before + after + 1, "missing_slot")
               .when(F.coalesce(F.col("valid_pixels"), F.lit(0)) == 0, "no_valid_target"))
    dry = ~F.col("any_wet") & (F.col("_peak") == 0)
    return d.select("slot", problem.alias("problem"),
                    F.when(problem.isNull(), F.when(dry, "strict_dry").otherwise("marginal_background")).alias("class"))


def partition_timeline(issues: DataFrame, events_hit: DataFrame, background: DataFrame) -> DataFrame:
    """IT05: every issue slot in exactly one of event, strict_dry, marginal_background, unassigned."""
    e = events_hit.select("slot").distinct().withColumn("_event", F.lit("event"))
    return (issues.select("slot").join(e, "slot", "left").join(background.select("slot", "class"), "slot", "left")
            .select("slot", F.coalesce("_event", "class", F.lit("unassigned")).alias("stratum")))


def timeline_violations(issues: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """IT05: what a partition of the timeline must not do, as rows (rule, key, detail).

    ``items`` (slot, stratum) is the partition of ``issues`` (slot); ``targets`` (slot, any_wet, significant) says what was
    observed. A strict-dry slot with a wet pixel is contaminated; a slot with a significant component outside events isn't covered;
    a slot without a stratum is unassigned, one with several rows is assigned twice. A slot without a target counts as neither wet
    nor significant.
    """
    j = items.join(targets.select("slot", "any_wet", "significant"), "slot", "left")
    per = issues.select("slot").distinct().join(items.groupBy("slot").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce(F.col("stratum") == "unassigned", F.lit(True))).alias("_open")), "slot", "left")
    none = F.coalesce(F.col("_n"), F.lit(0)) == 0
    return union_all([
        violation(j.filter("stratum = 'strict_dry' and any_wet"), "strict_dry_contaminated", F.col("slot")),
        violation(j.filter("significant and coalesce(stratum <> 'event', true)"), "significant_not_covered", F.col("slot"), F.coalesce("stratum", F.lit(""))),
        violation(per.filter(none | F.col("_open")), "unassigned", F.col("slot")),
        violation(per.filter("_n > 1"), "assigned_twice", F.col("slot"), F.col("_n"))])
