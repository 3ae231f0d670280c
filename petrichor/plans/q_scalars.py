"""Scalar expressions over whole driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import hashing as H
from ..functions import members as M
from ..functions import signature as SG
from ..functions import time as T
from ..functions import values as V
from . import bindings as B
from .bindings import r6
from .registry import query

C = F.col
SLOT_TS = "(make_timestamp((epoch_us(ts) // 300000000) * 300000000))"
NV = "least(value / 1000, 1)"


def ev(spark, sf):
    return B.table(spark, sf, "events").withColumn("slot_ts", T.slot_time(T.slot_index("ts", 5), 5)).withColumn(
        "nv", F.least(C("value") / 1000.0, F.lit(1.0)))


@query("pr01_parse_slot_key", f"""select event_id, strptime(strftime({SLOT_TS}, '%Y%m%d%H%M'), '%Y%m%d%H%M')
 - interval 9 hour as t_utc from events""")
def pr01(spark, sf):
    key = F.date_format("slot_ts", "yyyyMMddHHmm")
    return ev(spark, sf).select("event_id", T.parse_slot_key(key).alias("t_utc"))


@query("pr02_format_slot_key", f"""select event_id, strftime({SLOT_TS} + interval 9 hour, '%Y%m%d%H%M') as slot_key
from events""")
def pr02(spark, sf):
    return ev(spark, sf).select("event_id", T.format_slot_key(C("slot_ts")).alias("slot_key"))


@query("pr03_is_slot", f"""select event_id, epoch_us(ts) % 300000000 = 0 as raw_on_slot,
 epoch_us({SLOT_TS}) % 300000000 = 0 as floored_on_slot from events""")
def pr03(spark, sf):
    return ev(spark, sf).select("event_id", T.is_slot(C("ts")).alias("raw_on_slot"),
                                T.is_slot(C("slot_ts")).alias("floored_on_slot"))


@query("pr08_rate_from_normalized", f"""select event_id, round(case when {NV} = 0 then 0 else
 pow(10, (45 * {NV} - 15) / 10) end, 6) as rate from events""")
def pr08(spark, sf):
    return ev(spark, sf).select("event_id", r6(V.rate_from_normalized(C("nv"))).alias("rate"))


@query("pr09_normalized_from_rate", """select event_id, round(case when value <= 0 then 0 else
 least(1, greatest(0, (10 * log10(value) + 15) / 45)) end, 6) as v, value > 1000 * (1 + 1e-6) as above_max from events""")
def pr09(spark, sf):
    return ev(spark, sf).select("event_id", r6(V.normalized_from_rate(C("value"))).alias("v"),
                                (C("value") > 1000.0 * (1 + 1e-6)).alias("above_max"))


@query("pr10_censor", """select event_id, value >= 10 as wet, round(case when value >= 10 then value else 0 end, 6) as model_mm,
 round(ln(1 + case when value >= 10 then value else 0 end), 6) as z from events""")
def pr10(spark, sf):
    return ev(spark, sf).select("event_id", V.wet(C("value"), 10).alias("wet"),
                                r6(V.censored(C("value"), 10)).alias("model_mm"),
                                r6(V.log_amount(C("value"), 10)).alias("z"))


RAW_SQL = ("case when event_type = 'error' then -30000 when event_type = 'signup' and value < 10 then -25000 "
           "when event_type = 'click' and value < 5 then -20000 else (event_id * 37) % 7000 end")


def raw_code():
    return (F.when(C("event_type") == "error", -30000)
            .when((C("event_type") == "signup") & (C("value") < 10), -25000)
            .when((C("event_type") == "click") & (C("value") < 5), -20000)
            .otherwise((C("event_id") * 37) % 7000))


@query("pr11_reflectivity", f"""with r as (select event_id, {RAW_SQL} as raw from events)
select event_id, case when raw not in (-30000, -25000) then round(raw / 100, 6) end as dbz from r""")
def pr11(spark, sf):
    return ev(spark, sf).select("event_id", raw_code().alias("raw")).select(
        "event_id", r6(V.reflectivity(C("raw"), V.raw_valid(C("raw")))).alias("dbz"))


@query("pr12_rate_from_dbz", f"""with r as (select event_id, {RAW_SQL} as raw from events),
d as (select event_id, case when raw not in (-30000, -25000) then raw / 100 end as dbz from r)
select event_id, round(case when dbz < 10 then 0 else pow(pow(10, dbz / 10) / 200, 1 / 1.6) end, 5) as rate from d""")
def pr12(spark, sf):
    dbz = V.reflectivity(C("raw"), V.raw_valid(C("raw")))
    return ev(spark, sf).select("event_id", raw_code().alias("raw")).select(
        "event_id", (F.round(V.rate_from_dbz(dbz), 5) + 0.0).alias("rate"))


@query("pr13_raw_valid", f"""with r as (select event_id, user_id, {RAW_SQL} as raw from events)
select r.event_id, raw not in (-30000, -25000) as raw_valid,
 raw not in (-30000, -25000) and coalesce(c.c_acctbal > 0, false) as valid
from r left join customer c on c.c_custkey = r.user_id""")
def pr13(spark, sf):
    cover = B.table(spark, sf, "customer").select(C("c_custkey").alias("user_id"), (C("c_acctbal") > 0).alias("covered"))
    e = ev(spark, sf).select("event_id", "user_id", raw_code().alias("raw")).join(cover, "user_id", "left")
    ok = V.raw_valid(C("raw"))
    return e.select("event_id", ok.alias("raw_valid"), (ok & F.coalesce("covered", F.lit(False))).alias("valid"))


SIG_TEXT_SQL = """case event_type when 'view' then 'era5_oracle:era=1:tp=1:full_trajectory'
 when 'click' then 'era5_oracle:era=1:tp=0:target_end_causal' when 'purchase' then 'null_provider:era=0:tp=0:no_era_access'
 when 'signup' then 'gfs:era=0:tp=1:full_trajectory' else 'era5_oracle:era=2:tp=1:full_trajectory' end"""


def sig_text():
    t = C("event_type")
    return (F.when(t == "view", "era5_oracle:era=1:tp=1:full_trajectory")
            .when(t == "click", "era5_oracle:era=1:tp=0:target_end_causal")
            .when(t == "purchase", B.NULL_SIG).when(t == "signup", "gfs:era=0:tp=1:full_trajectory")
            .otherwise("era5_oracle:era=2:tp=1:full_trajectory"))


@query("pr14_parse_signature", rf"""with s as (select event_id, {SIG_TEXT_SQL} as sig from events),
p as (select *, string_split(sig, ':') as x from s)
select event_id, case when x[2] in ('era=0','era=1') then x[1] else '' end as provider, x[2] = 'era=1' as era,
 case when x[2] in ('era=0','era=1') then x[3] = 'tp=1' else false end as tp,
 case when x[2] in ('era=0','era=1') then x[4] else '' end as access,
 case when x[2] = 'era=0' then 'null_provider:era=0:tp=0:no_era_access' when x[2] = 'era=1' then sig end as canonical,
 case when x[2] = 'era=0' then sig = 'null_provider:era=0:tp=0:no_era_access' else x[2] = 'era=1' end as is_canonical from p""")
def pr14(spark, sf):
    e = ev(spark, sf).select("event_id", sig_text().alias("sig"))
    return e.select("event_id", *[v.alias(k) for k, v in SG.fields(C("sig")).items()],
                    SG.canonical(C("sig")).alias("canonical"), SG.is_canonical(C("sig")).alias("is_canonical"))


@query("pr15_expand_leads", """select event_id, (user_id % 4096)::int as mask, lead_no, 0.5 * lead_no as lead_hours from (
 select event_id, user_id, unnest(list_filter(range(1, 13), lambda i: ((user_id % 4096) >> (i - 1)) & 1 = 1))::int as lead_no from events)""")
def pr15(spark, sf):
    e = ev(spark, sf).select("event_id", (C("user_id") % 4096).cast("int").alias("mask"))
    return e.select("event_id", "mask", F.explode(T.expand_mask(C("mask"))).alias("lead_no")).withColumn(
        "lead_hours", C("lead_no") * 0.5)


@query("pr16_sample_id", f"""select event_id, substr(sha256(strftime({SLOT_TS}, '%Y-%m-%dT%H:%M:%S') || '+00:00|' ||
 printf('%.1f', 0.5 * (event_id % 12 + 1)) || '|' || event_type), 1, 24) as sample_id from events""")
def pr16(spark, sf):
    return ev(spark, sf).select("event_id", H.sample_id(
        C("slot_ts"), (C("event_id") % 12 + 1) * F.lit(0.5), C("event_type")).alias("sample_id"))


@query("pr17_event_id_block", f"""select event_id, 'event-' || substr(sha256(strftime({SLOT_TS}, '%Y-%m-%dT%H:%M:%S') || '+00:00|' ||
 strftime({SLOT_TS} + interval 1 hour, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 16) as interval_id,
 event_type || ':' || strftime(ts, '%Y-%m-%d') as block_id from events""")
def pr17(spark, sf):
    return ev(spark, sf).select("event_id", H.event_id(C("slot_ts"), T.add_minutes("slot_ts", 60)).alias("interval_id"),
                                H.utc_day_block(C("ts"), C("event_type")).alias("block_id"))


def uniform_sql(seed, purpose, key):
    h = f"sha256('{seed}' || chr(0) || '{purpose}' || chr(0) || ({key})::varchar)"
    le = " || ".join(f"substr(h, {2 * b + 1}, 2)" for b in range(7, -1, -1))
    return f"(select (('0x' || {le})::ubigint >> 11)::double * pow(2::double, -53) from (select {h} as h))"


@query("pr18_hash_uniform", f"select event_id, {uniform_sql(7, 'draw', 'event_id')} as u from events")
def pr18(spark, sf):
    return ev(spark, sf).select("event_id", H.hash_uniform(7, "draw", C("event_id")).alias("u"))


@query("pr19_make_items", f"""with i as (select event_id, {SLOT_TS} as t0, 0.5 * (event_id % 12 + 1) as lead_hours,
 value / 1000 as p_target, 0.5 as p_draw from events)
select event_id, t0, lead_hours, t0 - interval 55 minute as dependency_start, t0 + interval 6 hour as dependency_end,
 round(p_target / p_draw, 6) as omega from i""")
def pr19(spark, sf):
    return ev(spark, sf).select(
        "event_id", C("slot_ts").alias("t0"), ((C("event_id") % 12 + 1) * F.lit(0.5)).alias("lead_hours"),
        T.add_minutes("slot_ts", -55).alias("dependency_start"), T.add_minutes("slot_ts", 360).alias("dependency_end"),
        r6(C("value") / 1000.0 / 0.5).alias("omega"))


LON = 127.5  # degrees east, parameter of the query


@query("pr20_verification_time", f"""with a as (select event_id, {SLOT_TS} + ((event_id % 12 + 1) * 30 - 15)::int * interval 1 minute as tc from events),
b as (select *, tc + interval '{int(LON * 240)} second' as solar from a),
c as (select *, epoch_us(solar) % 86400000000 / 3600000000 as h,
 (dayofyear(solar) - 1 + epoch_us(solar) % 86400000000 / 3600000000 / 24) /
 (case when (year(solar) % 4 = 0 and year(solar) % 100 <> 0) or year(solar) % 400 = 0 then 366.0 else 365.0 end) as ph from b)
select event_id, tc, solar, round(h, 6) as solar_hour, round(ph, 6) as phase, round(sin(2*pi()*h/24), 6) as day_sin,
 round(cos(2*pi()*h/24), 6) as day_cos, round(sin(2*pi()*ph), 6) as year_sin, round(cos(2*pi()*ph), 6) as year_cos from c""")
def pr20(spark, sf):
    tc = T.verification_time(C("slot_ts"), (C("event_id") % 12 + 1) * 30)
    e = ev(spark, sf).select("event_id", tc.alias("tc")).withColumn("solar", T.solar_time(C("tc"), F.lit(LON)))
    e = e.withColumn("h", T.day_fraction_hours(C("solar"))).withColumn("ph", T.annual_phase(C("solar")))
    two_pi = 2 * math.pi
    return e.select("event_id", "tc", "solar", r6(C("h")).alias("solar_hour"), r6(C("ph")).alias("phase"),
                    r6(F.sin(C("h") * two_pi / 24)).alias("day_sin"), r6(F.cos(C("h") * two_pi / 24)).alias("day_cos"),
                    r6(F.sin(C("ph") * two_pi)).alias("year_sin"), r6(F.cos(C("ph") * two_pi)).alias("year_cos"))


@query("pr21_bins", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
 (hour(l_shipdate + (l_partkey % 24)::int * interval 1 hour) // 6)::int as solar_bin,
 case when month(l_shipdate) in (12,1,2) then 'DJF' when month(l_shipdate) in (3,4,5) then 'MAM'
  when month(l_shipdate) in (6,7,8) then 'JJA' else 'SON' end as season,
 ((l_quantity >= 5)::int + (l_quantity >= 20)::int + (l_quantity >= 40)::int)::int as intensity from lineitem""")
def pr21(spark, sf):
    li = B.table(spark, sf, "lineitem")
    t = F.timestamp_add("HOUR", (C("l_partkey") % 24).cast("int"), C("l_shipdate"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     T.solar_bin(T.day_fraction_hours(t)).alias("solar_bin"), T.season(C("l_shipdate")).alias("season"),
                     T.intensity_bin(C("l_quantity"), (5, 20, 40)).alias("intensity"))


HOURS_SQL = f"""h as (select event_id, ts, {SLOT_TS} as t0, date_trunc('hour', ts) as h0,
 date_trunc('hour', {SLOT_TS} + interval 6 hour) as e0, {SLOT_TS} + interval 6 hour as e1 from events),
x as (select event_id, t0, h0 + k * interval 1 hour as valid_time, k,
 case when e0 = e1 then e0 else e0 + interval 1 hour end as ceil_end from h, (select unnest(range(8))::int as k))"""


def hours(spark, sf):
    e = ev(spark, sf).select("event_id", C("slot_ts").alias("t0"))
    return e.select("event_id", "t0", F.posexplode(T.native_hours(C("t0"))).alias("k", "valid_time"))


@query("pr22_native_hours", f"""with {HOURS_SQL} select valid_time, count(*) as n, min(k)::int as first_k, max(k)::int as last_k
from x group by valid_time""")
def pr22(spark, sf):
    return hours(spark, sf).groupBy("valid_time").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"),
                                                      F.max("k").alias("last_k"))


@query("pr23_trajectory_access_masks", f"""with {HOURS_SQL} select event_id,
 count(*) filter (valid_time <= ceil_end) as n_trajectory,
 count(*) filter (case event_id % 3 when 0 then valid_time <= ceil_end
   when 1 then valid_time <= ceil_end and valid_time <= t0 + (event_id % 12 + 1)::int * interval 30 minute else false end) as n_access
from x group by event_id""")
def pr23(spark, sf):
    h = hours(spark, sf)
    mode = (F.when(C("event_id") % 3 == 0, "full_trajectory").when(C("event_id") % 3 == 1, "target_end_causal")
            .otherwise("no_era_access"))
    acc = T.access_mask(C("valid_time"), C("t0"), (C("event_id") % 12 + 1) * 30, mode)
    return h.groupBy("event_id").agg(F.count_if(T.trajectory_mask(C("valid_time"), C("t0"))).alias("n_trajectory"),
                                     F.count_if(acc).alias("n_access"))


@query("pr24_issue_causal_mask", f"""with {HOURS_SQL} select event_id,
 count(*) filter (valid_time <= t0 and valid_time + interval 1 hour <= t0 + interval 1 hour) as n_causal,
 count(*) filter (valid_time <= t0 and valid_time + interval 1 hour <= t0) as n_strict from x group by event_id""")
def pr24(spark, sf):
    h = hours(spark, sf)
    end = T.add_minutes("valid_time", 60)
    return h.groupBy("event_id").agg(
        F.count_if(T.issue_causal_mask(C("valid_time"), end, T.add_minutes("t0", 60)) & (C("valid_time") <= C("t0"))).alias("n_causal"),
        F.count_if(T.issue_causal_mask(C("valid_time"), end, C("t0"))).alias("n_strict"))


_K = G.lcc_constants()


def lcc_sql(lat, lon):
    s = f"({_K['ecc']!r}::double * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) * pow((1 + {s}) / (1 - {s}), {_K['ecc'] / 2!r}::double))"
    rad = f"({_K['scale']!r}::double * pow({t}, {_K['cone']!r}::double))"
    th = f"({_K['cone']!r}::double * radians({lon} - 126.0))"
    return f"{rad} * sin({th})", f"{_K['origin']!r}::double - {rad} * cos({th})"


LAT_SQL, LON_SQL = "(30 + (c_custkey % 1500)::double / 100)", "(120 + abs(c_acctbal) / 800)"


def customer_lcc(spark, sf):
    c = B.table(spark, sf, "customer")
    x, y = G.project_lcc((C("c_custkey") % 1500) / 100.0 + 30.0, F.abs("c_acctbal") / 800.0 + 120.0)
    return c.select("c_custkey", x.alias("x"), y.alias("y"))


@query("pr27_project_lcc", f"""select c_custkey, round({lcc_sql(LAT_SQL, LON_SQL)[0]}, 3) as x_m,
 round({lcc_sql(LAT_SQL, LON_SQL)[1]}, 3) as y_m from customer""")
def pr27(spark, sf):
    return customer_lcc(spark, sf).select("c_custkey", (F.round("x", 3) + 0.0).alias("x_m"), (F.round("y", 3) + 0.0).alias("y_m"))


@query("pr28_shared_coords", f"""with p as (select c_custkey, {lcc_sql(LAT_SQL, LON_SQL)[0]} as x, {lcc_sql(LAT_SQL, LON_SQL)[1]} as y from customer),
c as (select (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy from p)
select c_custkey, round((x - cx) / 100000, 6) as sx, round((y - cy) / 100000, 6) as sy from p, c""")
def pr28(spark, sf):
    p = customer_lcc(spark, sf)
    centre = p.agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"))
    return p.join(F.broadcast(centre)).select(  # one row
        "c_custkey", r6(G.shared_coord(C("x"), C("cx"))).alias("sx"), r6(G.shared_coord(C("y"), C("cy"))).alias("sy"))


# ensemble members: all entries of the embedding but the last, which is the observation
EMB_SQL = "e as (select vec_id, label, list_transform(embedding[1:len(embedding) - 1], lambda v: v::double) as m, embedding[len(embedding)]::double as y from embeddings)"


def members(spark, sf):
    return B.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.slice(F.transform("embedding", lambda v: v.cast("double")), F.lit(1), F.greatest(F.size("embedding") - 1, F.lit(0))).alias("m"),
        F.get("embedding", F.size("embedding") - 1).cast("double").alias("y"))


CAL = dict(scale=2.0, b=0.05, d=0.01, c=1.2, gamma=0.9)


@query("pr32_restore_members", f"""with {EMB_SQL},
f as (select vec_id, y, list_transform(m, lambda v: 0.05 + 0.01 + 1.2 * (v * 2.0)) as q from e),
g as (select vec_id, y, list_transform(q, lambda v: list_avg(q) + 0.9 * (v - list_avg(q))) as q from f),
u as (select vec_id, unnest(q) + abs(y) as z from g),
a as (select vec_id, case when exp(greatest(z, 0)) - 1 >= 0.1 then exp(greatest(z, 0)) - 1 else 0 end as a from u)
select vec_id, round(sum(a), 6) as total_mm, round(max(a), 6) as max_mm, count(*) filter (a = 0) as dry_members from a group by vec_id""")
def pr32(spark, sf):
    k = {n: F.lit(v) for n, v in CAL.items()}
    m = members(spark, sf).withColumn("a", M.restore(C("m"), k["scale"], F.abs("y"), k["b"], k["d"], k["c"], k["gamma"]))
    return m.select("vec_id", r6(M.total(C("a"))).alias("total_mm"), r6(F.array_max("a")).alias("max_mm"),
                    F.size(F.filter("a", lambda x: x == 0)).cast("long").alias("dry_members"))


@query("pr33_lower_median", f"with {EMB_SQL} select vec_id, round(list_sort(m)[(len(m) - 1) // 2 + 1], 6) as med from e")
def pr33(spark, sf):
    return members(spark, sf).select("vec_id", r6(M.lower_median(C("m"))).alias("med"))


@query("pr34_exceed_fraction", f"""with {EMB_SQL} select vec_id, {', '.join(
    f"len(list_filter(m, lambda v: v >= {t})) / len(m) as f_{i}" for i, t in enumerate((0.01, 0.05, 0.1)))} from e""")
def pr34(spark, sf):
    return members(spark, sf).select("vec_id", *[M.exceed_fraction(C("m"), t).alias(f"f_{i}")
                                                 for i, t in enumerate((0.01, 0.05, 0.1))])


LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LIK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
P_SQL = "(l_discount * 10)"
Q_SQL = f"least(1 - 1e-6, greatest(1e-6, {P_SQL}))"
BETA = 0.3


@query("pr35_map_probability", f"""select {LI}, round(1 / (1 + exp(-(0.2 + ({BETA} + ln(1 + exp(-{BETA}))) * (ln({Q_SQL}) - ln(1 - {Q_SQL}))))), 6) as q
from lineitem""")
def pr35(spark, sf):
    return B.table(spark, sf, "lineitem").select(*LIK, r6(V.map_probability(C("l_discount") * 10, F.lit(0.2), F.lit(BETA))).alias("q"))


@query("pr36_clip_weight", f"select {LI}, least(l_quantity, 40.0) as omega from lineitem")
def pr36(spark, sf):
    return B.table(spark, sf, "lineitem").select(*LIK, V.clip_weight(C("l_quantity"), 40).alias("omega"))


@query("pr37_regression_mean", f"""select {LI}, round({P_SQL} * ln(1 + l_quantity), 6) as mu_z,
 round(exp({P_SQL} * ln(1 + l_quantity)) - 1, 6) as point_mm from lineitem""")
def pr37(spark, sf):
    mu = V.regression_mean(C("l_discount") * 10, F.log1p("l_quantity"))
    return B.table(spark, sf, "lineitem").select(*LIK, r6(mu).alias("mu_z"), r6(V.physical_point(mu)).alias("point_mm"))
