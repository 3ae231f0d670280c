"""Moments, normalization, support and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import sampling as SA
from ..operators import stats as SS
from . import bindings as B
from .bindings import r6
from .q_manifest import index, INDEX_SQL, items, items_sql, w
from .registry import query

C = F.col


def chan(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select(C("event_type").alias("channel"), C("value").alias("v"), (C("user_id") % 15 != 3).alias("valid"),
                    F.to_date("ts").alias("d"), "event_id", "user_id")


CHAN_SQL = "ch as (select event_type as channel, value as v, user_id % 15 <> 3 as valid, ts::date as d, event_id, user_id from events)"
MOM = "count(*) as n, round(avg(v), 6) as mean, round(var_pop(v), 4) as variance, round(stddev_pop(v), 5) as sd, min(v) as \"min\", max(v) as \"max\""


def moments_out(df, *keys):
    return df.select(*(keys or ("channel",)), "n", r6(C("mean")).alias("mean"), F.round("variance", 4).alias("variance"), F.round("sd", 5).alias("sd"), "min", "max")


@query("ag09_masked_moments", f"with {CHAN_SQL} select channel, {MOM} from ch where valid group by channel")
def ag09(spark, sf):
    return moments_out(SS.masked_moments(chan(spark, sf), ["channel"]))


DEAD = "count(v2) as n, round(avg(v2), 6) as mean, round(var_pop(v2), 4) as variance, round(stddev_pop(v2), 5) as sd, min(v2) as \"min\", max(v2) as \"max\" from (select *, case when valid and channel <> 'error' then v end as v2 from ch) group by channel"


@query("ag09_dead_channel", f"with {CHAN_SQL} select channel, {DEAD}")
def ag09_dead(spark, sf):
    """A channel without a valid value stays, with n = 0."""
    return moments_out(SS.masked_moments(chan(spark, sf).withColumn("valid", C("valid") & (C("channel") != "error")), ["channel"]))


@query("ag10_dead_channel_merge", f"with {CHAN_SQL} select channel, {DEAD}")
def ag10_dead(spark, sf):
    dead = chan(spark, sf).withColumn("valid", C("valid") & (C("channel") != "error"))
    return moments_out(SS.merge_moments(SS.moments_state(dead, ["channel", "d"]), ["channel"]))


@query("ag12_degenerate_channels", f"with {CHAN_SQL}, s as (select channel, {DEAD}) select channel from s where n = 0 or sd = 0")
def ag12_degenerate(spark, sf):
    dead = chan(spark, sf).withColumn("valid", C("valid") & (C("channel") != "error"))
    return SS.degenerate_channels(SS.masked_moments(dead, ["channel"]), ["channel"])


@query("ag10_merge_moments", f"with {CHAN_SQL} select channel, {MOM} from ch where valid group by channel")
def ag10(spark, sf):
    return moments_out(SS.merge_moments(SS.moments_state(chan(spark, sf), ["channel", "d"]), ["channel"]))


@query("ud04_moments_state_merge", f"with {CHAN_SQL} select channel, {MOM} from ch where valid group by channel")
def ud04(spark, sf):
    once = SS.moments_state(chan(spark, sf), ["channel", "user_id"])
    twice = SS.merge_moments(once.withColumn("part", C("user_id") % 7), ["channel", "part"])
    return moments_out(SS.merge_moments(twice, ["channel"]))


@query("ag11_train_universe", w(items_sql(), """, t as (select distinct t0_utc from items where split = 'outer_train')
select distinct date_trunc('hour', t0_utc) + k * interval 1 hour as valid_time from t, (select unnest(range(8))::int as k)
where date_trunc('hour', t0_utc) + k * interval 1 hour <= case when date_trunc('hour', t0_utc) = t0_utc then t0_utc + interval 6 hour else date_trunc('hour', t0_utc) + interval 7 hour end""", True))
def ag11(spark, sf):
    return SS.train_universe(items(spark, sf))


@query("ag12_fit_normalization", w(items_sql(), f""", hist as (select distinct slot - k as slot from items, (select unnest([0,1,2]) as k) where split = 'outer_train'),
a as (select 'frames' as grp, event_type as channel, value as v from events where epoch_us(ts) // 900000000 in (select slot from hist) and user_id % 15 <> 3),
b as (select 'static' as grp, c as channel, v from (select 'size' as c, p_size::double as v from part union all select 'price', p_retailprice from part))
select grp, channel, {MOM} from (select * from a union all select * from b) group by grp, channel""", True))
def ag12(spark, sf):
    train = items(spark, sf).filter("split = 'outer_train'")
    keys = train.select(F.explode(F.array(*[C("slot") - k for k in range(3)])).alias("slot")).distinct()
    ev = B.table(spark, sf, "events").withColumn("slot", T.slot_index("ts", 15)).join(keys, "slot", "left_semi").select(
        C("event_type").alias("channel"), C("value").alias("v"), (C("user_id") % 15 != 3).alias("valid"))
    part = B.table(spark, sf, "part").select(F.explode(F.map_from_arrays(
        F.array(F.lit("size"), F.lit("price")), F.array(C("p_size").cast("double"), C("p_retailprice")))).alias("channel", "v"))
    st = SS.fit_normalization({"frames": ev, "static": part.withColumn("valid", F.lit(True))})
    return moments_out(st, "grp", "channel")


@query("pr30_zscore", f"""with {CHAN_SQL}, s as (select channel, avg(v) as m, stddev_pop(v) as sd from ch where valid group by 1)
select event_id, channel, valid, round(case when valid then (v - m) / sd else 0 end, 6) as z from ch join s using (channel)""")
def pr30(spark, sf):
    ch = chan(spark, sf)
    z = SS.zscore(ch, SS.masked_moments(ch, ["channel"]), ["channel"], valid=C("valid"))
    return z.select("event_id", "channel", "valid", r6(C("z")).alias("z"))


@query("pr31_zscore_static", """with l as (select p_partkey, 'size' as channel, p_size::double as v from part union all select p_partkey, 'price', p_retailprice from part union all
 select p_partkey, 'flag', (p_brand = 'Brand#2')::int::double from part), s as (select channel, avg(v) as m, stddev_pop(v) as sd from l group by 1)
select p_partkey, channel, round(case when channel in ('size', 'price') then (v - m) / sd else v end, 6) as z from l join s using (channel)""")
def pr31(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.explode(F.map_from_arrays(
        F.array(F.lit("size"), F.lit("price"), F.lit("flag")),
        F.array(C("p_size").cast("double"), C("p_retailprice"), (C("p_brand") == "Brand#2").cast("double")))).alias("channel", "v"))
    st = SS.masked_moments(p.withColumn("valid", F.lit(True)), ["channel"])
    return SS.zscore_named(p, st, ["size", "price"]).select("p_partkey", "channel", r6(C("z")).alias("z"))


@query("ag13_weighted_moments", """with m as (select l_linenumber, sum(l_quantity * l_extendedprice) / sum(l_quantity) as mean from lineitem where l_quantity > 0 group by 1)
select l_linenumber, round(any_value(mean), 5) as mean, round(sum(l_quantity * (l_extendedprice - mean) ** 2) / sum(l_quantity) / 1e6, 6) as variance_e6, sum(l_quantity) as mass
from lineitem join m using (l_linenumber) where l_quantity > 0 group by 1""")
def ag13(spark, sf):
    m = SS.weighted_moments(B.table(spark, sf, "lineitem"), ["l_linenumber"], "l_extendedprice", "l_quantity")
    return m.select("l_linenumber", F.round("mean", 5).alias("mean"), r6(C("variance") / 1e6).alias("variance_e6"), "mass")


BLOCKS_SQL = """bm as (select l_linenumber as lead, strftime(l_shipdate, '%Y-%m') as block_id, sum(l_quantity) as mass, max((l_returnflag = 'R')::int) as pos,
 max((l_returnflag <> 'R')::int) as neg from lineitem group by all)"""


def li_blocks(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        C("l_linenumber").alias("lead"), F.date_format("l_shipdate", "yyyy-MM").alias("block_id"), C("l_quantity").alias("w"),
        (C("l_returnflag") == "R").alias("wet"), "l_returnflag", "l_linestatus")


@query("ag14_block_support", f"""with {BLOCKS_SQL} select lead, count(*) as blocks, round(sum(mass) ** 2 / sum(mass * mass), 6) as ess, sum(pos)::bigint as pos_blocks,
 sum(neg)::bigint as neg_blocks from bm group by lead""")
def ag14(spark, sf):
    m = SS.block_masses(li_blocks(spark, sf), ["lead"], "block_id", "w", C("wet"))
    return SS.block_support(m, ["lead"]).withColumn("ess", r6(C("ess")))


PRED_SQL = """pr as (select l_linenumber as lead, l_returnflag as arm, l_discount * 10 as p, ln(1 + l_quantity) as m, case when l_returnflag = 'R' then l_extendedprice / 1000 else 0 end as obs,
 l_quantity as w from lineitem)"""


def preds(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        C("l_linenumber").alias("lead"), C("l_returnflag").alias("arm"), (C("l_discount") * 10).alias("p"), F.log1p("l_quantity").alias("m"),
        F.when(C("l_returnflag") == "R", C("l_extendedprice") / 1000).otherwise(0.0).alias("obs"), C("l_quantity").alias("w"))


@query("ag24_hurdle_scores", f"""with {PRED_SQL}, q as (select *, least(1 - 1e-6, greatest(1e-6, p)) as pc, (obs > 0)::int as wet from pr),
g as (select lead, sum(w) as mass, sum(w * wet) as wet_mass, sum(w * -(wet * ln(pc) + (1 - wet) * ln(1 - pc))) / greatest(sum(w), 1) as occurrence,
 sum(w * wet * (m - ln(1 + obs)) ** 2) / greatest(sum(w * wet), 1) as amount, sum(w * (p * m - ln(1 + obs)) ** 2) / greatest(sum(w), 1) as mean_error from q group by lead)
select lead, mass, wet_mass, round(occurrence, 6) as occurrence, round(amount, 6) as amount, round(mean_error, 6) as mean_error, round(occurrence + amount + 0.5 * mean_error, 6) as loss from g""")
def ag24(spark, sf):
    g = SS.hurdle_scores(preds(spark, sf), ["lead"], 0.5)
    return g.select("lead", "mass", "wet_mass", *[r6(C(c)).alias(c) for c in ("occurrence", "amount", "mean_error", "loss")])


@query("ag25_direct_scores", f"""with {PRED_SQL}, q as (select *, p * m as pred, ln(1 + obs) - p * m as e, ln(1 + obs) as y from pr)
select lead, round(sum(w * e * e) / sum(w), 6) as mse, round(sum(w * greatest(0.9 * e, -0.1 * e)) / sum(w), 6) as pinball from q group by lead""")
def ag25(spark, sf):
    d = preds(spark, sf).select("lead", F.log1p("obs").alias("obs"), (C("p") * C("m")).alias("pred"), "w")
    g = SS.direct_scores(d, ["lead"], 0.9)
    return g.select("lead", r6(C("mse")).alias("mse"), r6(C("pinball")).alias("pinball"))


@query("ag27_coarsen_grid", """with g as (select user_id // 15 as y, user_id % 15 as x, count(*) filter (event_type = 'error') * 5 < count(*) as valid from events group by all),
e as (select *, y * y + y as y_lo, (y + 1) * (y + 1) + y + 1 as y_hi, x * 2.0 as x_lo, (x + 1) * 2.0 as x_hi from g)
select y // 4 as cy, x // 4 as cx, max(y_hi) - min(y_lo) as height, max(x_hi) - min(x_lo) as width, round((min(y_lo) + max(y_hi)) / 2, 6) as centre_y, round((min(x_lo) + max(x_hi)) / 2, 6) as centre_x,
 round(sum(case when valid then (y_hi - y_lo) * (x_hi - x_lo) else 0 end) / sum((y_hi - y_lo) * (x_hi - x_lo)), 6) as valid_fraction from e group by all""")
def ag27(spark, sf):
    e = B.table(spark, sf, "events")
    g = e.groupBy(F.floor(C("user_id") / 15).alias("y"), (C("user_id") % 15).alias("x")).agg(
        (F.count_if(C("event_type") == "error") * 5 < F.count(F.lit(1))).alias("valid"))
    y, x = C("y"), C("x")
    g = g.withColumn("y_lo", y * y + y).withColumn("y_hi", (y + 1) * (y + 1) + y + 1).withColumn("x_lo", x * F.lit(2.0)).withColumn("x_hi", (x + 1) * F.lit(2.0))
    out = SS.coarsen_grid(g, 4, 4)
    return out.select("cy", "cx", "height", "width", *[r6(C(c)).alias(c) for c in ("centre_y", "centre_x", "valid_fraction")])


@query("ag28_distribution", """select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as "max"
from events group by 1""")
def ag28(spark, sf):
    e = B.table(spark, sf, "events")
    q = SA.grouped_quantiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    m = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return q.join(m, "event_type").select("event_type", "n", *[r6(C(c)).alias(c) for c in ("mean", "p50", "p95")], "max")


SEASON_SQL = "case when month(l_shipdate) in (12,1,2) then 'DJF' when month(l_shipdate) in (3,4,5) then 'MAM' when month(l_shipdate) in (6,7,8) then 'JJA' else 'SON' end"


@query("ag30_timeline_shares", f"""select l_linestatus as split, {SEASON_SQL} as season, count(*) as n, count(distinct strftime(l_shipdate, '%Y-%m')) as blocks from lineitem
group by rollup (1, 2)""")
def ag30(spark, sf):
    li = B.table(spark, sf, "lineitem").select(C("l_linestatus").alias("split"), T.season(C("l_shipdate")).alias("season"),
                                               F.date_format("l_shipdate", "yyyy-MM").alias("block_id"))
    return SS.timeline_shares(li)


@query("ag30_block_concentration", w(INDEX_SQL, """, p as (select block_id, count(*) as n from idx group by 1)
select count(*) as blocks, round(max(n) / sum(n), 6) as largest_share, round(sum(n) ** 2 / sum(n * n), 6) as effective_blocks from p"""))
def ag30b(spark, sf):
    out = SS.block_concentration(index(spark, sf))
    return out.select("blocks", r6(C("largest_share")).alias("largest_share"), r6(C("effective_blocks")).alias("effective_blocks"))


@query("ag30_minute_distribution", "select event_type, minute(ts) // 5 * 5 as minute, count(*) as n from events group by all")
def ag30c(spark, sf):
    return B.table(spark, sf, "events").groupBy("event_type", (F.floor(F.minute("ts") / 5) * 5).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("ag31_validity_report", f"""with {B.SPLITS_SQL}, p as (select epoch_us(ts) // 900000000 as slot, name as split, avg((event_type = 'error')::int) as f from events join splits on ts >= s and ts < e group by all)
select slot, split, round(f, 6) as invalid_fraction, f > 0.3 and split = 'outer_train' as dropped from p""")
def ag31(spark, sf):
    from ..operators.splits import assign_split
    px = B.table(spark, sf, "events").select(T.slot_index("ts", 15).alias("slot"), assign_split(C("ts"), C("ts"), B.SPLITS).alias("split"),
                                             (C("event_type") != "error").alias("valid")).filter("split is not null")
    per, drop = SS.validity_report(px, ["slot", "split"], 0.3)
    return per.join(drop.select("slot", "split", F.lit(True).alias("_d")), ["slot", "split"], "left").select(
        "slot", "split", r6(C("invalid_fraction")).alias("invalid_fraction"), F.coalesce("_d", F.lit(False)).alias("dropped"))


@query("ag32_rollup_report", f"""with s as (select l_linenumber as lead, {SEASON_SQL} as season, l_returnflag as stratum, l_discount * l_quantity as a, l_quantity as b from lineitem)
select lead, season, stratum, grouping(lead, season, stratum) as level, round(sum(a), 4) as num, sum(b) as den, round(sum(a) / sum(b), 6) as ratio from s group by cube (lead, season, stratum)""")
def ag32(spark, sf):
    s = B.table(spark, sf, "lineitem").select(C("l_linenumber").alias("lead"), T.season(C("l_shipdate")).alias("season"), C("l_returnflag").alias("stratum"),
                                              (C("l_discount") * C("l_quantity")).alias("a"), C("l_quantity").alias("b"))
    # the cube runs on the exact cells, not on raw rows
    cells = s.groupBy("lead", "season", "stratum").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return SS.rollup_report(cells, ["lead", "season", "stratum"], "a", "b").withColumn("num", F.round("num", 4)).withColumn("ratio", r6(C("ratio")))
