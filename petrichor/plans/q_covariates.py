"""Covariate windows, cycles and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import covariates as CV
from . import bindings as B
from .bindings import r6
from .q_manifest import items, items_sql, w
from .registry import query

C = F.col
# fixed values of the query's channel schema: short name, level, channel, units, accumulated
CHANNELS = (("view", None, "t2m", "K", False), ("click", None, "d2m", "K", False), ("purchase", None, "tp", "m", True), ("signup", 500, "z500", "m2", False))


def raw_fields(spark, sf):
    e, t = B.table(spark, sf, "events"), C("event_type")
    hour = T.floor_hour("ts")
    return e.select(
        "event_id", F.upper(t).alias("short_name"), F.when(t == "signup", F.when(C("event_id") % 2 == 0, 500).otherwise(850)).alias("level"),
        F.when(t == "purchase", "m").when(t == "signup", "m2").otherwise(F.when(C("value") < 5, "C").otherwise("K")).alias("units"),
        F.when(t == "purchase", F.when(C("value") < 3, "instant").otherwise("accum")).otherwise("instant").alias("step_type"),
        F.when(C("user_id") % 10 == 0, C("ts")).otherwise(hour).alias("valid_time"),
        F.when(t == "purchase", F.when(C("value") > 100, T.add_minutes(hour, -120)).otherwise(T.add_minutes(hour, -60))).alias("interval_start"),
        F.when(t == "purchase", hour).alias("interval_end"), (C("value") - 2).alias("value"))


FIELDS_SQL = """rf as (select event_id, event_type as t, case when event_type = 'signup' then case when event_id % 2 = 0 then 500 else 850 end end as level,
 case when event_type = 'purchase' then 'm' when event_type = 'signup' then 'm2' when value < 5 then 'C' else 'K' end as units,
 case when event_type = 'purchase' and value >= 3 then 'accum' else 'instant' end as step_type, case when user_id % 10 = 0 then ts else date_trunc('hour', ts) end as valid_time,
 case when event_type = 'purchase' then date_trunc('hour', ts) - case when value > 100 then 2 else 1 end * interval 1 hour end as i0, case when event_type = 'purchase' then date_trunc('hour', ts) end as i1, value - 2 as v, value from events),
cf as (select *, case when t = 'view' then 't2m' when t = 'click' then 'd2m' when t = 'purchase' then 'tp' when t = 'signup' and level = 500 then 'z500' end as channel from rf),
pf as (select *, case when channel is null then 'unknown_channel' when epoch_us(valid_time) % 3600000000 <> 0 then 'not_on_hour' when channel = 'tp' and step_type <> 'accum' then 'step_type'
 when channel in ('t2m', 'd2m') and units <> 'K' then 'units' when channel = 'tp' and (i1 <> valid_time or i0 <> valid_time - interval 1 hour) then 'interval' when channel = 'tp' and v < 0 then 'negative' end as problem from cf)"""


@query("pr25_canonicalize_fields", f"with {FIELDS_SQL} select event_id, channel, problem, round(case when problem is null then v * case when channel = 'tp' then 1000 else 1 end end, 6) as canonical from pf")
def pr25(spark, sf):
    d = CV.canonicalize_fields(raw_fields(spark, sf), CHANNELS)
    return d.select("event_id", "channel", "problem", r6(C("canonical")).alias("canonical"))


HOURLY_SQL = """hr as (select date_trunc('hour', ts) as valid_time, avg(value) filter (event_type in ('view', 'error')) as inst, avg(value) filter (event_type = 'purchase') as tp from events group by 1)"""


def hourly(spark, sf):
    e = B.table(spark, sf, "events")
    return e.groupBy(T.floor_hour("ts").alias("valid_time")).agg(
        F.avg(F.when(C("event_type").isin("view", "error"), C("value"))).alias("inst"), F.avg(F.when(C("event_type") == "purchase", C("value"))).alias("tp"))


@query("jn07_covariate_window", w(items_sql(), f""", {HOURLY_SQL}, x as (select items.*, date_trunc('hour', t0_utc) + k * interval 1 hour as valid_time,
 case when date_trunc('hour', t0_utc) = t0_utc then t0_utc + interval 6 hour else date_trunc('hour', t0_utc) + interval 7 hour end as ce, condition_signature like '%era=1%' as era, condition_signature like '%tp=1%' as tpp
 from items, (select unnest(range(8))::int as k)),
y as (select sample_id, valid_time, round(case when era and hr.inst is not null then hr.inst else 0 end, 6) as inst, round(case when era and tpp and hr.tp is not null then hr.tp else 0 end, 6) as tp, hr.inst is not null as data_valid_inst,
 hr.tp is not null as tp_valid, valid_time <= ce as trajectory, era and valid_time <= ce and valid_time <= t0_utc + (lead_hours * 60)::int * interval 1 minute as access from x left join hr using (valid_time))
select sample_id, valid_time, inst, tp, data_valid_inst, tp_valid, trajectory, access, trajectory and access and not data_valid_inst as violation from y""", True))
def jn07(spark, sf):
    d = CV.covariate_window(items(spark, sf), hourly(spark, sf), C("lead_hours") * 60, F.lit("target_end_causal"))
    return d.select("sample_id", "valid_time", r6(C("inst")).alias("inst"), r6(C("tp")).alias("tp"), "data_valid_inst", "tp_valid", "trajectory", "access", "violation")


@query("jn08_asof_cycle", """with c as (select distinct date_diff('day', date '1970-01-01', o_orderdate::date) as cycle_day from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'),
d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', date '1970-01-01', l_shipdate::date) as t0_day from lineitem), u as (select distinct t0_day from d),
m as (select t0_day, max(cycle_day) as cycle_day from u left join c on cycle_day + 3 <= t0_day group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, t0_day, cycle_day, t0_day - cycle_day as cycle_age, t0_day - cycle_day - 3 as availability_age from d join m using (t0_day)""")
def jn08(spark, sf):
    def day(c):
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    cyc = B.table(spark, sf, "orders").filter((C("o_orderpriority") == "1-URGENT") & (C("o_orderstatus") == "F")).select(day("o_orderdate").alias("cycle_day"))
    iss = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("t0_day"))
    return CV.asof_cycle(iss, cyc, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t0_day", "cycle_day", "cycle_age", "availability_age")


LAT_US = 5 * 3600 * 1_000_000


@query("jn08_asof_instants", f"""with c as (select distinct epoch_us(ts) as c from events where event_type = 'signup' and value >= 30),
e as (select event_id, epoch_us(ts) as t, (event_id % 12 + 1) * 1800000000 as ld from events), a as (select c + {LAT_US}::bigint as at, c from c)
select event_id, a.c as cycle, e.t - a.c as cycle_age, e.t - a.c - {LAT_US}::bigint as availability_age, e.t - a.c + ld as rollout_lead from e asof left join a on e.t >= a.at""")
def jn08_instants(spark, sf):
    """Cycles at any instant of the day, usable five hours later, and the time from the cycle to each event's target."""
    e = B.table(spark, sf, "events")
    cyc = e.filter("event_type = 'signup' and value >= 30").select(T.micros("ts").alias("cycle"))
    iss = e.select("event_id", T.micros("ts").alias("t"), ((C("event_id") % 12 + 1) * F.lit(1_800_000_000)).alias("ld"))
    return CV.asof_cycle(iss, cyc, LAT_US, t0="t", cycle="cycle", lead="ld").select("event_id", "cycle", "cycle_age", "availability_age", "rollout_lead")


@query("jn09_overlap_resample", """with h as (select event_type as source, epoch_us(ts) // 3600000000 * 3600 as js, epoch_us(ts) // 3600000000 * 3600 + 3600 as je, sum(value) as amount from events group by all),
wn as (select distinct event_type as source, epoch_us(ts) // 1800000000 as wid, (epoch_us(ts) // 1800000000) * 1800 + 900 as ws, (epoch_us(ts) // 1800000000) * 1800 + 900 + 2700 as we from events),
o as (select wn.source, wid, ws, we, sum(amount * (least(we, je) - greatest(ws, js)) / 3600.0) as a, sum(least(we, je) - greatest(ws, js)) as c from wn left join h on h.source = wn.source and js < we and je > ws group by all)
select source, wid, round(case when c = we - ws then a end, 5) as amount, round(coalesce(c, 0) / (we - ws), 6) as cover from o""")
def jn09(spark, sf):
    e = B.table(spark, sf, "events").withColumn("source", C("event_type"))
    sec = F.call_function("div", T.micros("ts"), F.lit(1_000_000))
    h = e.groupBy("source", (F.call_function("div", sec, F.lit(3600)) * 3600).alias("js")).agg(F.sum("value").alias("amount")).withColumn("je", C("js") + 3600)
    wn = e.select("source", F.call_function("div", sec, F.lit(1800)).alias("wid")).distinct().withColumn("ws", C("wid") * 1800 + 900).withColumn("we", C("ws") + 2700)
    out = CV.overlap_resample(h, wn, ["source"])
    return out.select("source", "wid", F.round("amount", 5).alias("amount"), r6(C("cover")).alias("cover"))


@query("sc11_expected_sources", """with f as (select l_returnflag as grp, date_trunc('month', l_shipdate)::date as month, count(*) as n from lineitem group by all),
c as (select grp, unnest(generate_series(timestamp '1995-01-01', timestamp '2000-12-01', interval 1 month))::date as month from (select unnest(['A', 'N', 'X']) as grp))
select grp, month, 'missing' as rule from c where (grp, month) not in (select (grp, month) from f) union all select grp, month, 'unexpected' from f where (grp, month) not in (select (grp, month) from c) union all
select grp, month, 'duplicate' from f where n > 1""")
def sc11(spark, sf):
    li = B.table(spark, sf, "lineitem")
    f = li.select(C("l_returnflag").alias("grp"), F.trunc(F.to_date("l_shipdate"), "month").alias("month"))
    return CV.expected_sources(f, ["A", "N", "X"], "1995-01-01", "2000-12-01")


@query("sc12_message_completeness", """with m as (select event_type as channel, date_trunc('hour', ts) as valid_time, count(*) as n from events group by all),
g as (select channel, timestamp '2024-01-01' + k * interval 1 hour as valid_time from (select distinct event_type as channel from events), (select unnest(range(720))::int as k))
select channel, count(*) as expected, count(n) as found, count(*) filter (n > 1) as repeated, min(case when n is not null then valid_time end) as first_time, max(case when n is not null then valid_time end) as last_time
from g left join m using (channel, valid_time) group by channel""")
def sc12(spark, sf):
    m = B.table(spark, sf, "events").select(C("event_type").alias("channel"), T.floor_hour("ts").alias("valid_time"))
    return CV.message_completeness(m, m.select("channel").distinct(), "2024-01-01 00:00:00", 720)


@query("va07_covariate_grid_contracts", """with f as (select event_type as channel, case when value > 150 then ts else date_trunc('hour', ts) end as valid_time, case when event_type = 'view' and user_id % 2 = 0 then 'b' else 'a' end as grid from events)
select 'repeated_field' as rule, count(*) as n from (select 1 from f group by channel, valid_time having count(*) > 1) union all
select 'grid_changes', count(*) from (select channel from f group by 1 having count(distinct grid) > 1) union all select 'not_on_hour', count(*) from f where epoch_us(valid_time) % 3600000000 <> 0""")
def va07(spark, sf):
    f = B.table(spark, sf, "events").select(
        C("event_type").alias("channel"), F.when(C("value") > 150, C("ts")).otherwise(T.floor_hour("ts")).alias("valid_time"),
        F.when((C("event_type") == "view") & (C("user_id") % 2 == 0), "b").otherwise("a").alias("grid"))
    return CV.grid_violations(f).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
