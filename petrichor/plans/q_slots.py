"""Runs, issue times, event grouping.

Slot expansions are reported as demand per slot: how many issue slots need it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import events as E
from ..operators import slots as S
from . import bindings as B
from .registry import query

RUNS_SQL = """
runs as (select source, min(slot) as run_start, max(slot) as run_end, count(*) as run_len
         from (select source, slot, slot - row_number() over (partition by source order by slot) as g from slots)
         group by source, g)"""
ALL_RUNS_SQL = """
runs as (select min(slot) as run_start, max(slot) as run_end, count(*) as run_len
         from (select slot, slot - row_number() over (order by slot) as g from slots) group by g)"""


def merge_sql(src: str, gap: int, name: str, n: str = "count(*)") -> str:
    return f"""
{name}_f as (select *, case when s - max(e) over (partition by source order by s, e
               rows between unbounded preceding and 1 preceding) <= {gap} then 0 else 1 end as f from {src}),
{name}_g as (select *, sum(f) over (partition by source order by s, e rows unbounded preceding) as g from {name}_f),
{name} as (select source, min(s) as s, max(e) as e, {n} as n_seeds from {name}_g group by source, g)"""


GAP, GUARD = 6, 1  # slots of five minutes
SEEDS_SQL = "seeds as (select source, run_start as s, run_end as e from runs)"
EVENTS_SQL = (f"{B.slots_sql(5)}, {RUNS_SQL}, {SEEDS_SQL}, {merge_sql('seeds', GAP, 'm1')}, "
              f"wide as (select source, s - {GUARD} as s, e + {GUARD} as e, n_seeds from m1), "
              f"{merge_sql('wide', 0, 'm2', 'sum(n_seeds)')}")


def seeds(spark, sf, minutes=5):
    return S.runs(B.slots(spark, sf, minutes), ["source"]).select(
        "source", F.col("run_start").alias("start"), F.col("run_end").alias("end"))


@query("flagship_merged_events", f"""with {EVENTS_SQL},
ev as (select event_type as source, epoch_us(ts) // 300000000 as slot, value from events)
select m2.source, {B.slot_ts_sql('m2.s', 5)} as start_utc, {B.slot_ts_sql('m2.e', 5)} as end_utc,
  m2.n_seeds::bigint as n_runs, count(*)::bigint as n_events, round(sum(ev.value), 4) as total_value
from m2 join ev on ev.source = m2.source and ev.slot between m2.s and m2.e group by all""")
def flagship(spark, sf):
    ev = B.table(spark, sf, "events").select(
        F.col("event_type").alias("source"), T.slot_index("ts", 5).alias("slot"), "value")
    # raw rows shrink to one per slot before they meet the events
    per_slot = ev.groupBy("source", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    merged = E.event_intervals(seeds(spark, sf), GAP, GUARD, ["source"])
    hit = E.containing_event(per_slot, merged, F.col("slot"), F.col("slot"), 288, ["source"])
    return hit.groupBy("source", "start", "end", "n_seeds").agg(
        F.sum("n").alias("n_events"), F.round(F.sum("v"), 4).alias("total_value")).select(
        "source", T.slot_time("start").alias("start_utc"), T.slot_time("end").alias("end_utc"),
        F.col("n_seeds").alias("n_runs"), "n_events", "total_value")


@query("wn01_runs", f"with {B.slots_sql(5)}, {RUNS_SQL} select source, run_start, run_end, run_len from runs")
def wn01(spark, sf):
    return S.runs(B.slots(spark, sf, 5), ["source"]).select("source", "run_start", "run_end", "run_len")


@query("wn02_strict_issue_times", f"""with {B.all_slots_sql(15)}, {ALL_RUNS_SQL}
select {B.slot_ts_sql('slot', 15)} as t0 from (
 select unnest(range(run_start + 2, run_end - 6 + 1)) as slot from runs where run_len >= 9)""")
def wn02(spark, sf):
    return S.strict_issue_slots(B.all_slots(spark, sf, 15), 3, 6).select(T.slot_time("slot", 15).alias("t0"))


@query("wn03_merge_intervals", f"""with {B.slots_sql(5)}, {RUNS_SQL}, {SEEDS_SQL}, {merge_sql('seeds', GAP, 'm1')}
select source, s as "start", e as "end", n_seeds::bigint as n_seeds from m1""")
def wn03(spark, sf):
    return E.merge_intervals(seeds(spark, sf), GAP, ["source"])


@query("wn04_guard_and_merge",
       f"""with {EVENTS_SQL} select source, s as "start", e as "end", n_seeds::bigint as n_seeds from m2""")
def wn04(spark, sf):
    return E.guard_and_merge(E.merge_intervals(seeds(spark, sf), GAP, ["source"]), GUARD, ["source"])


@query("wn04_event_intervals",
       f"""with {EVENTS_SQL} select source, s as "start", e as "end", n_seeds::bigint as n_seeds from m2""")
def wn04b(spark, sf):
    return E.event_intervals(seeds(spark, sf), GAP, GUARD, ["source"])


@query("wn05_significant_seeds", f"""with {B.slots_sql(5)}, {RUNS_SQL},
big as (select event_type as source, epoch_us(ts) // 300000000 as slot from events group by all
        having max(value) >= 100),
seeds as (select source, run_start as s, run_end as e from runs where run_len >= 2
          union all select source, slot, slot from big), {merge_sql('seeds', 3, 'm1')}
select source, s as "start", e as "end", n_seeds::bigint as n_seeds from m1""")
def wn05(spark, sf):
    active = S.runs(B.slots(spark, sf, 5), ["source"]).filter("run_len >= 2").select(
        "source", F.col("run_start").alias("start"), F.col("run_end").alias("end"))
    ev = B.table(spark, sf, "events")
    big = (ev.groupBy(F.col("event_type").alias("source"), T.slot_index("ts", 5).alias("start"))
           .agg(F.max("value").alias("m")).filter("m >= 100")
           .select("source", "start", F.col("start").alias("end")))
    return E.merge_intervals(active.unionByName(big), 3, ["source"])


@query("ag05_availability_stats", f"""with {B.slots_sql(15)}, {RUNS_SQL}
select source, sum(run_len)::bigint as timestamps, count(*)::bigint as runs,
 sum(greatest(run_len - 9, 0))::bigint as windows, count(*) filter (run_len >= 10)::bigint as supporting_runs,
 sum(run_len // 10)::bigint as disjoint_blocks from runs group by source""")
def ag05(spark, sf):
    return S.availability_stats(B.slots(spark, sf, 15), 10, ["source"])


def _jn01(mode):
    def run(spark, sf):
        sl = B.all_slots(spark, sf, 15)
        issues = sl.withColumn("lead", F.explode(F.array(*[F.lit(i) for i in (2, 4, 6)])))
        if mode == "endpoint":
            need = T.endpoint_slots(F.col("slot"), F.col("lead"), 3, 3)
        else:
            need = F.sequence(F.col("slot") - 2, F.col("slot") + F.col("lead"))
        return S.available(issues, sl, need, keys=("slot", "lead"))
    return run


_JN01_SQL = """with {slots}, iss as (select slot, unnest([2,4,6]) as lead from slots),
need as (select slot, lead, unnest({need}) as req from iss),
tot as (select slot, lead, count(distinct req) as n, count(distinct s2) as h from (
  select need.*, s.slot as s2 from need left join slots s on s.slot = need.req) group by all)
select slot, lead from tot where n = h"""
query("jn01_available_endpoint", _JN01_SQL.format(
    slots=B.all_slots_sql(15), need="list_concat(range(slot-2, slot+1), range(slot+lead-2, slot+lead+1))"))(_jn01("endpoint"))
query("jn01_available_strict", _JN01_SQL.format(
    slots=B.all_slots_sql(15), need="range(slot-2, slot+lead+1)"))(_jn01("strict"))


@query("jn02_containing_event", f"""with {EVENTS_SQL}, p as (select distinct source, slot from slots)
select p.source, p.slot, m2.s as "start", m2.e as "end", m2.n_seeds::bigint as n_seeds
from p join m2 on p.source = m2.source and m2.s <= p.slot - 2 and p.slot + 2 <= m2.e""")
def jn02(spark, sf):
    merged = E.event_intervals(seeds(spark, sf), GAP, GUARD, ["source"])
    return E.containing_event(B.slots(spark, sf, 5), merged, F.col("slot") - 2, F.col("slot") + 2, 288, ["source"])


def _explode_sql(arr, tbl="slots"):
    return (f"with {B.slots_sql(15)} select source, req, count(*) as n_issues from ("
            f"select source, unnest({arr}) as req from {tbl}) group by all")


def _explode_query(name, arr_sql, fn):
    @query(name, _explode_sql(arr_sql))
    def run(spark, sf):
        return (B.slots(spark, sf, 15).select("source", F.explode(fn(F.col("slot"))).alias("req"))
                .groupBy("source", "req").agg(F.count(F.lit(1)).alias("n_issues")))


_explode_query("pr04_explode_history", "range(slot - 11, slot + 1)", lambda s: T.history_slots(s))
_explode_query("pr05_explode_target_slots", "range(slot + 6 - 6, slot + 6 + 1)", lambda s: T.target_slots(s, F.lit(6)))
_explode_query("pr06_explode_dependency", "range(slot - 11, slot + 73)", lambda s: T.dependency_slots(s))
_explode_query("pr07_explode_endpoint_slots", "list_distinct(list_concat(range(slot-11, slot+1), range(slot, slot+7)))",
               lambda s: T.endpoint_slots(s, F.lit(6)))
