"""Frames, accumulation targets, background classes, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import components as CC
from ..operators import events as E
from ..operators import slots as S
from ..operators import targets as TG
from . import bindings as B
from .bindings import r6
from .q_scalars import RAW_SQL, ev, raw_code
from .q_slots import merge_sql
from .registry import query

C = F.col


def frames(spark, sf):
    """Hourly frames of 3x2 pixels: rate = summed value, a pixel is invalid after a large error."""
    e = B.table(spark, sf, "events")
    err = F.max(F.when(C("event_type") == "error", C("value")).otherwise(F.lit(0.0)))
    return (e.groupBy(T.slot_index("ts", 60).alias("slot"), (F.floor(C("user_id") / 3) % 2).alias("y"), (C("user_id") % 3).alias("x"))
            .agg(F.sum("value").alias("r"), (err < 60).alias("valid")))


FRAMES_SQL = """fr as (select epoch_us(ts) // 3600000000 as slot, (user_id // 3) % 2 as y, user_id % 3 as x, sum(value) as r,
 max(case when event_type = 'error' then value else 0 end) < 60 as valid from events group by all)"""
LEADS = [1, 3, 6]
ACC_SQL = f"""{FRAMES_SQL}, sl as (select distinct slot from fr), want as (select slot, lead, slot + lead as end_slot from sl, (select unnest([1,3,6]) as lead)),
acc as (select w.slot, w.lead, y, x, count(*) as scans, bool_and(valid) as valid, sum(r * case when fr.slot in (end_slot, end_slot - 6) then 0.5 else 1 end) * 0.5 as raw
 from want w join fr on fr.slot between end_slot - 6 and end_slot group by all having count(*) = 7),
tgt as (select slot, lead, y, x, valid, case when valid then raw end as raw from acc)"""


def target(spark, sf):
    fr = frames(spark, sf)
    return TG.accumulate_target(fr, fr.select("slot").distinct(), LEADS, 0.5, 7, 300.0)


@query("ag01_accumulate_target", f"""with {ACC_SQL} select slot, lead, y, x, valid, round(raw, 4) as raw, round(case when raw >= 300 then raw when raw is not null then 0 end, 4) as model,
 coalesce(raw >= 300, false) as wet, round(ln(1 + case when raw >= 300 then raw when raw is not null then 0 end), 6) as z from tgt""")
def ag01(spark, sf):
    return target(spark, sf).select("slot", "lead", "y", "x", "valid", F.round("raw", 4).alias("raw"),
                                    F.round("model", 4).alias("model"), "wet", r6(C("z")).alias("z"))


STEPS_SQL = """st as (select l_suppkey as item, l_orderkey % 73 as step, avg(l_quantity) as rate, min(l_discount) < 0.05 as scan_valid,
 max(l_tax) >= 0.05 as inflow, min(l_tax) * 10 as residence, avg(l_discount) * 10 as confidence from lineitem group by all)"""


@query("ag02_accumulate_trajectory", f"""with {STEPS_SQL}, ld as (select st.*, lead, case when step in (lead * 6, lead * 6 + 6) then 0.5 else 1 end as w
 from st, (select unnest(range(12)) as lead) where step between lead * 6 and lead * 6 + 6),
 g as (select item, lead, bool_and(scan_valid) as valid, sum(w * rate) / 12 as raw, sum(w * inflow::int) / 6 as inflow_fraction, min(residence) as residence, sum(w * confidence) / 6 as confidence
 from ld group by all having count(*) = 7)
select item, lead, valid, round(case when valid then raw else 0 end, 6) as raw, round(ln(1 + case when valid then raw else 0 end), 6) as z, round(inflow_fraction, 6) as inflow_fraction,
 round(residence, 6) as residence, round(confidence, 6) as confidence from g""")
def ag02(spark, sf):
    li = B.table(spark, sf, "lineitem")
    st = li.groupBy(C("l_suppkey").alias("item"), (C("l_orderkey") % 73).alias("step")).agg(
        F.avg("l_quantity").alias("rate"), (F.min("l_discount") < 0.05).alias("scan_valid"), (F.max("l_tax") >= 0.05).alias("inflow"),
        (F.min("l_tax") * 10).alias("residence"), (F.avg("l_discount") * 10).alias("confidence"))
    out = TG.accumulate_trajectory(st)
    return out.select("item", "lead", "valid", *[r6(C(c)).alias(c) for c in ("raw", "z", "inflow_fraction", "residence", "confidence")])


@query("ag03_context_activity", f"""with {FRAMES_SQL} select slot, count(*) filter (valid and r >= 100) as active_pixels,
 count(*) filter (valid and r >= 100) >= 2 as active from fr group by slot""")
def ag03(spark, sf):
    return TG.context_activity(frames(spark, sf), 100, 2)


@query("ag04_sentinel_counts", f"""with r as (select event_type, {RAW_SQL} as raw from events) select event_type, count(*) filter (raw = -30000) as code_30000,
 count(*) filter (raw = -25000) as code_25000 from r group by 1""")
def ag04(spark, sf):
    return TG.sentinel_counts(ev(spark, sf).select("event_type", raw_code().alias("raw")), ["event_type"])


@query("jn05_gather_history", f"""with {FRAMES_SQL}, sl as (select distinct slot from fr) select sl.slot, (fr.slot - sl.slot + 2)::int as "offset", y, x, round(r, 4) as r, valid
 from sl join fr on fr.slot between sl.slot - 2 and sl.slot""")
def jn05(spark, sf):
    fr = frames(spark, sf)
    return TG.gather_history(fr.select("slot").distinct(), fr, 3).withColumn("r", F.round("r", 4))


@query("jn06_attach_label", f"""with {ACC_SQL} select slot, lead, count(*) as pixels, count(*) filter (valid) as valid_pixels, round(sum(raw), 6) as total from tgt
 where slot in (select slot from fr where r >= 300) group by all""")
def jn06(spark, sf):
    cond = frames(spark, sf).filter("r >= 300")
    return TG.attach_label(cond, target(spark, sf)).groupBy("slot", "lead").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("valid").alias("valid_pixels"), r6(F.sum("raw")).alias("total"))


@query("jn25_persistence_baseline", f"""with {FRAMES_SQL}, p as (select slot, y, x, valid, case when valid then r * 0.5 end as raw from fr)
select slot, y, x, valid, lead, round(case when raw >= 50 then raw when raw is not null then 0 end, 4) as model,
 round(ln(1 + case when raw >= 50 then raw when raw is not null then 0 end), 6) as z from p, (select unnest(range(1, 13))::int as lead)""")
def jn25(spark, sf):
    fr = frames(spark, sf)
    d = TG.persistence_baseline(fr, fr.select("slot").distinct(), 12, 0.5, 50.0)
    return d.withColumn("model", F.round("model", 4)).withColumn("z", r6(C("z")))


BG_SQL = f"""{ACC_SQL}, act as (select slot, count(*) filter (valid and r >= 250) as a from fr group by slot),
tg as (select slot, bool_or(raw >= 900) filter (valid) as any_wet, count(*) filter (valid) as vp from tgt group by slot),
nd as (select sl.slot, count(act.slot) as have, max(a) as peak from sl left join act on act.slot between sl.slot - 2 and sl.slot + 3 group by sl.slot),
bg as (select nd.slot, case when have < 6 then 'missing_slot' when coalesce(vp, 0) = 0 then 'no_valid_target' end as problem,
 not coalesce(any_wet, false) and peak = 0 as dry from nd left join tg using (slot)),
bgc as (select slot, problem, case when problem is null then case when dry then 'strict_dry' else 'marginal_background' end end as class from bg)"""


def background(spark, sf):
    fr = frames(spark, sf)
    tg = target(spark, sf).groupBy("slot").agg(
        F.coalesce(F.max(F.when(C("valid"), C("raw") >= 900)), F.lit(False)).alias("any_wet"), F.count_if("valid").alias("valid_pixels"))
    return TG.classify_background(fr.select("slot").distinct(), TG.context_activity(fr, 250, 1), tg, 2, 3)


@query("it04_classify_background", f'with {BG_SQL} select slot, problem, class from bgc')
def it04(spark, sf):
    return background(spark, sf)


@query("it05_partition_timeline", f"""with {BG_SQL}, act2 as (select 'all' as source, slot from act where a >= 2),
seeds as (select source, slot as s, slot as e from act2), {merge_sql('seeds', 2, 'm1')}, wide as (select source, s - 1 as s, e + 1 as e, n_seeds from m1), {merge_sql('wide', 0, 'm2', 'sum(n_seeds)')},
hit as (select distinct sl.slot from sl join m2 on s <= sl.slot - 1 and sl.slot + 1 <= e)
select sl.slot, coalesce(case when hit.slot is not null then 'event' end, class, 'unassigned') as stratum from sl left join hit using (slot) left join bgc using (slot)""")
def it05(spark, sf):
    fr = frames(spark, sf)
    issues = fr.select("slot").distinct()
    act = TG.context_activity(fr, 250, 2).filter("active").select(C("slot").alias("start"), C("slot").alias("end"))
    hit = E.containing_event(issues, E.event_intervals(act, 2, 1), C("slot") - 1, C("slot") + 1, 64)
    return TG.partition_timeline(issues, hit, background(spark, sf))


@query("it05_timeline_assertions", f"""with {BG_SQL}, tw as (select slot, coalesce(any_wet, false) as any_wet from tg), pt as (select sl.slot, case when sl.slot % 7 = 0 then 'strict_dry' when sl.slot % 11 = 0 then 'event' else class end as stratum from sl left join bgc using (slot) where sl.slot % 13 <> 0)
select 'strict_dry_contaminated' as rule, count(*) as n from pt join tw using (slot) where any_wet and stratum = 'strict_dry' having count(*) > 0 union all
select 'significant_not_covered', count(*) from pt join tw using (slot) where any_wet and coalesce(stratum <> 'event', true) having count(*) > 0 union all
select 'unassigned', count(*) from sl left join pt using (slot) where stratum is null having count(*) > 0 union all
select 'assigned_twice', count(*) from pt where slot % 17 = 0 having count(*) > 0""")
def it05_assertions(spark, sf):
    """A damaged partition: some slots called dry, some left out, some given twice."""
    issues = frames(spark, sf).select("slot").distinct()
    seen = target(spark, sf).groupBy("slot").agg(F.coalesce(F.max(F.when(C("valid"), C("raw") >= 900)), F.lit(False)).alias("any_wet")).withColumn("significant", C("any_wet"))
    s = F.when(C("slot") % 7 == 0, "strict_dry").when(C("slot") % 11 == 0, "event").otherwise(C("class"))
    parts = issues.join(background(spark, sf), "slot", "left").select("slot", s.alias("stratum")).filter("slot % 13 <> 0")
    twice = parts.filter("slot % 17 = 0").withColumn("stratum", F.lit("event"))
    return TG.timeline_violations(issues, parts.unionByName(twice), seen).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


GRID_SQL = """g as (select epoch_us(ts) // 21600000000 as field, user_id // 15 as y, user_id % 15 as x, max(value) as v from events group by all having max(value) >= 60)"""


def wet_grid(spark, sf, minutes=360, threshold=60.0):
    e = B.table(spark, sf, "events")
    return (e.groupBy(T.slot_index("ts", minutes).alias("field"), F.floor(C("user_id") / 15).alias("y"), (C("user_id") % 15).alias("x"))
            .agg(F.max("value").alias("v")).filter(C("v") >= threshold))


@query("it01_wet_components", f"""with recursive {GRID_SQL}, lab as (select field, y, x, v, y as ly, x as lx from g union
 select n.field, n.y, n.x, n.v, l.ly, l.lx from lab l join g n on n.field = l.field and abs(n.y - l.y) <= 1 and abs(n.x - l.x) <= 1
  and (l.ly, l.lx) <= (n.y, n.x)),
fin as (select field, y, x, v, min((ly, lx)) as root from lab group by field, y, x, v),
c as (select field, root, count(*) as size, round(max(v), 6) as peak, count(*) >= 4 or max(v) >= 150 as significant from fin group by field, root)
select field, size, peak, significant, count(*) as n from c group by all""")
def it01(spark, sf):
    labelled = CC.wet_components(wet_grid(spark, sf), ["field"])
    return (CC.component_stats(labelled, ["field"], 4, 150.0).withColumn("peak", r6(C("peak")))
            .groupBy("field", "size", "peak", "significant").agg(F.count(F.lit(1)).alias("n")))
