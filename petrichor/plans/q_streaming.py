"""Streaming queries over the events table, run to the end of the available data.

A closing row far in the future is not faked: windows that the watermark has not passed stay open, so the SQL
twins keep only windows that end before the last event minus the delay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..streaming import streams as SM
from . import bindings as B
from .bindings import r6
from .registry import query

C = F.col


def raw(spark, sf):
    s = SM.stream_files(spark, sf, "events.parquet", SM.EVENTS_SCHEMA)
    return s.select("event_id", SM.event_time("ts").alias("t"), "user_id", C("event_type").alias("source"), C("value").alias("r"))


def ntz(c):
    return T.from_micros(F.unix_micros(c))


def floor_t(minutes):
    return F.timestamp_seconds(F.floor(F.unix_seconds("t") / (minutes * 60)) * (minutes * 60))


@query("st01_stream_scans", """select event_type as source, (epoch_us(ts) // 300000000) * 5 as slot_minute, (user_id // 15) as y, user_id % 15 as x, count(*) > 0 as seen from events group by all""")
def st01(spark, sf):
    d = raw(spark, sf).select("source", "t", F.floor(C("user_id") / 15).alias("y"), (C("user_id") % 15).alias("x"))
    out = SM.run_to_table(SM.stream_scans(d, 5, "1 hour"), "st01")
    return out.select("source", (C("slot") * 5).alias("slot_minute"), "y", "x", F.lit(True).alias("seen"))


@query("st02_stream_accumulate", """with sc as (select epoch_us(ts) // 3600000000 as k, user_id % 3 as x, event_id, value as r, value < 250 as valid from events),
pk as (select k, x, arg_min(r, event_id) as r, arg_min(valid, event_id) as valid from sc group by all),
e as (select k // 3 as w, x, r, valid, case when k % 3 = 0 then 0.5 else 1.0 end as wt from pk union all select k // 3 - 1, x, r, valid, 0.5 from pk where k % 3 = 0),
g as (select w, x, sum(r * wt) as s, count(*) as scans, bool_and(valid) as valid from e group by all)
select make_timestamp(w * 3 * 3600000000) as "start", x, scans, scans = 4 as complete, round(case when scans = 4 and valid then s end, 6) as raw from g
where (w + 1) * 3 * 3600 <= (select max(epoch_us(ts) // 3600000000) * 3600 - 3600 from events)""")
def st02(spark, sf):
    # one scan per (hour, pixel): the first in event order within the batch; a file stream is read once
    d = raw(spark, sf).select("event_id", floor_t(60).alias("t"), (C("user_id") % 3).alias("x"), "r", (C("r") < 250).alias("valid"))
    first = d.withWatermark("t", "1 hour").groupBy(F.window("t", "60 minutes").alias("h"), "x").agg(
        F.min_by("r", "event_id").alias("r"), F.min_by("valid", "event_id").alias("valid"))
    scans = SM.run_to_table(first.select(C("h.start").alias("t"), "x", "r", "valid"), "st02a")
    scans_stream = SM.stream_table(spark, scans)
    out = SM.run_to_table(SM.stream_accumulate(scans_stream, 60, 180, "0 seconds", ["x"]), "st02b")
    return out.select(ntz("start").alias("start"), "x", "scans", "complete", r6(C("raw")).alias("raw"))


@query("st03_stream_history", """with x as (select event_type as source, value, epoch_us(ts) as us, unnest(range(12)) as k from events), w as (select source, (us // 300000000 - k) * 300 as s, value from x)
select make_timestamp(s * 1000000) as "start", source, count(*) as n, round(sum(value), 4) as total, max(value) as peak from w
where s + 3600 <= (select max(epoch_us(ts)) // 1000 / 1000 - 600 from events) group by all""")
def st03(spark, sf):
    out = SM.run_to_table(SM.stream_history(raw(spark, sf), "60 minutes", "5 minutes", "10 minutes", ["source"]), "st03")
    return out.select(ntz("start").alias("start"), "source", "n", F.round("total", 4).alias("total"), "peak")


@query("st04_stream_active_runs", f"""with a as (select event_type as source, epoch_us(ts) // 3600000000 as slot from events where value >= 60 group by all having count(*) >= 1),
g as (select source, slot, slot - row_number() over (partition by source order by slot) as g from a), r as (select source, min(slot) as a, max(slot) as b, count(*) as slots from g group by source, g)
select source, {B.slot_ts_sql('a', 60)} as first_slot, {B.slot_ts_sql('b', 60)} as last_slot, slots from r where (b + 1) * 3600000000 - 1 + 3660000000 <= (select max(epoch_us(ts)) // 1000 * 1000 - 600000000 from events)""")
def st04(spark, sf):
    out = SM.run_to_table(SM.stream_active_runs(raw(spark, sf), "60 minutes", "61 minutes", 60.0, 1, "10 minutes"), "st04")
    return out.select("source", ntz("first_slot").alias("first_slot"), ntz("last_slot").alias("last_slot"), "slots")


# --- parts that arrive one after another ------------------------------------------------------------------
QUARTERS = 4
#: Quarter of the time span in which an event happened.
PART_SQL = f"""span as (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events),
ev as (select e.*, least({QUARTERS - 1}, (epoch_us(ts) - a) * {QUARTERS} // greatest(b - a, 1))::bigint as quarter from events e, span)"""
#: The watermark after the last part: whole milliseconds.
MARK_SQL = "(select max(epoch_us(ts)) // 1000 * 1000 - {0} from events)"


def arrivals(spark, sf, late=None):
    """The events in quarters of their time; where ``late`` holds, an event arrives a quarter after its own. In no order within one."""
    e = B.table(spark, sf, "events").select("event_id", SM.event_time("ts").alias("t"), "user_id", C("event_type").alias("source"), C("value").alias("r"))
    us = F.unix_micros("t")
    span = e.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    a, b = span["a"] or 0, span["b"] or 0
    quarter = F.least(F.lit(QUARTERS - 1), F.call_function("div", (us - F.lit(a)) * QUARTERS, F.lit(max(b - a, 1))))
    arrival = quarter if late is None else F.least(F.lit(QUARTERS - 1), quarter + F.when(late, 1).otherwise(0))
    return [e.filter(arrival == q) for q in range(QUARTERS)]


LOOK, NEED, COLLECT, PEAK = 3 * 3600, 1, 9 * 3600, 120


@query("st05_stream_trigger", f"""with recursive h as (select event_type as domain, epoch_us(ts) // 3600000000 * 3600 as t, max(value) >= {PEAK} as active from events group by all),
mk as (select {MARK_SQL.format(600000000)} as mark),
s as (select *, row_number() over (partition by domain order by t) as rn from h, mk where (t + 3600) * 1000000 < mark),
r as (select distinct domain, 0::bigint as rn, []::bigint[] as recent, -1::bigint as opened, -1::bigint as until, 0::bigint as slots, -1::bigint as eo, -1::bigint as ec, 0::bigint as es from s
 union all select domain, rn, case when active then list_append(rec, t) else rec end, o2, case when o2 >= 0 and active then greatest(u2, t + {COLLECT}) else u2 end,
  case when o2 >= 0 then n2 + 1 else 0 end, case when closes then o0 else -1 end, case when closes then u0 else -1 end, case when closes then n0 else 0 end from (
   select *, case when o1 < 0 and len(rec) >= {NEED} then t else o1 end as o2, case when o1 < 0 and len(rec) >= {NEED} then t + {COLLECT} else u1 end as u2, case when o1 < 0 then 0 else n0 end as n2 from (
    select s.domain, s.rn, s.t, s.active, r.opened as o0, r.until as u0, r.slots as n0, r.opened >= 0 and s.t > r.until as closes, list_filter(r.recent, lambda x: x > s.t - {LOOK}) as rec,
     case when r.opened >= 0 and s.t > r.until then -1 else r.opened end as o1, case when r.opened >= 0 and s.t > r.until then -1 else r.until end as u1
    from r join s on s.domain = r.domain and s.rn = r.rn + 1))),
o as (select domain, eo as a, ec as b, es as n from r where eo >= 0 union all
 select domain, opened, until, slots from (select *, row_number() over (partition by domain order by rn desc) as k from r) z, mk where k = 1 and opened >= 0 and (until + 3600) * 1000000 < mark)
select domain, make_timestamp(a * 1000000) as opened, make_timestamp(b * 1000000) as closed, n as slots from o""")
def st05(spark, sf):
    """Collections of each event type; the events arrive in four runs of one query."""
    def build(s):
        return SM.stream_trigger(s.withColumnRenamed("source", "domain"), 3600, "10 minutes", PEAK, LOOK, NEED, COLLECT)
    out = SM.arriving(spark, arrivals(spark, sf), build, "st05")
    return spark.read.schema("domain string, opened timestamp, closed timestamp, slots long").parquet(out).select("domain", ntz("opened").alias("opened"), ntz("closed").alias("closed"), "slots")


@query("st06_stream_late_report", f"""with {PART_SQL}, ar as (select *, least({QUARTERS - 1}, quarter + (event_id % 7 = 0)::int) as arrival from ev),
nw as (select arrival, max(epoch_us(ts)) as newest from ar group by 1)
select make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) as slot, count(*) as "rows",
 count(*) filter (epoch_us(ts) < (select max(newest) from nw where nw.arrival < ar.arrival) - 600000000) as late from ar group by 1""")
def st06(spark, sf):
    """Every seventh event arrives a quarter late; the last part is then run again, as after a failure."""
    parts = arrivals(spark, sf, C("event_id") % 7 == 0)
    sink = SM.arriving(spark, parts, lambda s: s, "st06", lambda out: SM.late_report(out, 60, 600))
    SM.late_report(sink, 60, 600)(parts[-1], QUARTERS - 1)
    return SM.late_table(spark, sink).select(ntz("slot").alias("slot"), "rows", "late")


@query("st07_stream_moments", """select event_type as source, count(*) as n, round(avg(value), 6) as mean, round(var_pop(value), 4) as variance, min(value) as "min", max(value) as "max" from events group by 1""")
def st07(spark, sf):
    out = SM.run_to_table(SM.stream_moments(raw(spark, sf), ["source"]), "st07", "complete")
    return out.select("source", "n", r6(C("mean")).alias("mean"), F.round("variance", 4).alias("variance"), "min", "max")


@query("st08_stream_enrich_static", """select e.event_id, c.c_nationkey as nation from events e left join customer c on c.c_custkey = e.user_id""")
def st08(spark, sf):
    static = B.table(spark, sf, "customer").select(C("c_custkey").alias("user_id"), C("c_nationkey").alias("nation"))
    return SM.run_to_table(SM.stream_enrich(raw(spark, sf), static, "user_id"), "st08").select("event_id", "nation")


@query("st08_stream_pair", """select a.event_id as left_id, b.event_id as right_id from events a join events b on a.user_id = b.user_id and b.event_type = 'click' and a.event_type = 'view'
 and b.ts <= a.ts and b.ts >= a.ts - interval 120 minute""")
def st08b(spark, sf):
    r = raw(spark, sf)
    a = r.filter("source = 'view'").select(C("event_id").alias("left_id"), C("t").alias("lt"), "user_id")
    b = raw(spark, sf).filter("source = 'click'").select(C("event_id").alias("right_id"), C("t").alias("rt"), "user_id")
    return SM.run_to_table(SM.stream_pair(a, b, "10 minutes", "120 MINUTES", "user_id"), "st08b").select("left_id", "right_id")


AGE_H, DELAY_D = 72, 9


@query("st08_stream_latest_cycle", f"""with sc as (select user_id as k, event_id as id, epoch_us(ts) as t from events where event_type in ('view', 'click')),
cy as (select user_id as k, epoch_us(ts) as t, max(value) as v from events where event_type not in ('view', 'click') group by all),
j as (select sc.*, cy.t as c, cy.v from sc asof left join cy on sc.k = cy.k and sc.t >= cy.t)
select k as user_id, id as event_id, make_timestamp(case when t - c <= {AGE_H * 3_600_000_000}::bigint then c end) as cycle, case when t - c <= {AGE_H * 3_600_000_000}::bigint then v end as "value"
from j where t < {MARK_SQL.format(DELAY_D * 86_400_000_000)}""")
def st08c(spark, sf):
    """Views and clicks with the user's last other event of three days; every fifth of these arrives a quarter late."""
    def build(s):
        scans = s.filter("source in ('view', 'click')").select(C("user_id").alias("key"), C("event_id").alias("id"), "t")
        cycles = s.filter("source not in ('view', 'click')").select(C("user_id").alias("key"), "t", C("r").alias("value"))
        return SM.stream_latest_cycle(scans, cycles, f"{DELAY_D} days", AGE_H * 3600)
    late = ~C("source").isin("view", "click") & (C("event_id") % 5 == 0)
    out = SM.arriving(spark, arrivals(spark, sf, late), build, "st08c")
    found = spark.read.schema("key long, id long, t timestamp, cycle timestamp, value double").parquet(out)
    return found.select(C("key").alias("user_id"), C("id").alias("event_id"), ntz("cycle").alias("cycle"), "value")
