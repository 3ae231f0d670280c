"""Verification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import members as M
from ..functions import time as T
from ..functions import values as V
from ..operators import grid as GR
from ..operators import metrics as ME
from ..operators import sampling as SA
from . import bindings as B
from .bindings import r6
from .q_calibration import ROWS_SQL, ladder_sql, rows
from .q_grid import CHEB_SQL, dense
from .q_scalars import EMB_SQL, members, uniform_sql
from .q_stats import SEASON_SQL
from .registry import query

C = F.col


def r6s(df, keys, cols):
    return df.select(*keys, *[r6(C(c)).alias(c) for c in cols])


def s6(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


MM = f"""{EMB_SQL}, mm as (select *, list_avg(m) as mean, list_sort(m)[(len(m) - 1) // 2 + 1] as med, list_var_samp(m) as s2 from e)"""


@query("me01_continuous_errors", f"""with {MM} select label, count(*) as n, round(avg(abs(med - y)), 6) as mae, round(sqrt(avg((mean - y) ** 2)), 6) as rmse, round(avg(mean - y), 6) as bias, round(sum(mean), 6) as total from mm group by 1""")
def me01(spark, sf):
    return r6s(ME.continuous_errors(members(spark, sf), ["label"]), ["label", "n"], ["mae", "rmse", "bias", "total"])


DET_SQL = """dt as (select l_linenumber as lead, l_extendedprice / 2000 as f, l_quantity as o, strftime(l_shipdate, '%Y-%m') as block_id from lineitem)"""


def det(spark, sf):
    return B.table(spark, sf, "lineitem").select(C("l_linenumber").alias("lead"), (C("l_extendedprice") / 2000).alias("f"), C("l_quantity").alias("o"),
                                                 F.date_format("l_shipdate", "yyyy-MM").alias("block_id"))


@query("me02_contingency", f"""with {DET_SQL}, c as (select lead, t::double as threshold, count(*) filter (f >= t and o >= t) as h, count(*) filter (f < t and o >= t) as m, count(*) filter (f >= t and o < t) as a,
 count(*) filter (f < t and o < t) as c, count(distinct block_id) filter (o >= t) as event_blocks from dt, (select unnest([5, 20, 40]) as t) group by all), d as (select *, (h + m) * (h + a) / (h + m + a + c)::double as ch from c)
select lead, threshold, h as hits, m as misses, a as false_alarms, c as negatives, event_blocks, round(case when h + m + a <> 0 then h / (h + m + a) end, 6) as csi, round(case when h + m <> 0 then h / (h + m) end, 6) as pod,
 round(case when h + a <> 0 then a / (h + a) end, 6) as far, round(case when h + m <> 0 then (h + a) / (h + m) end, 6) as freq_bias, round(case when h + m + a - ch <> 0 then (h - ch) / (h + m + a - ch) end, 6) as ets from d where threshold < 40 or event_blocks >= 83""")
def me02(spark, sf):
    d = ME.contingency(det(spark, sf), ["lead"], [5.0, 20.0, 40.0], {40.0: 83}, "block_id")
    return r6s(d, ["lead", "threshold", "hits", "misses", "false_alarms", "negatives", "event_blocks"], ["csi", "pod", "far", "freq_bias", "ets"])


H, WD = 10, 15
DAY_SQL = f"""dd as (select epoch_us(ts) // 86400000000 as ts, (user_id // 15) % 10 as y, user_id % 15 as x, max(value) filter (event_type in ('view', 'click')) as f, max(value) filter (event_type in ('purchase', 'signup')) as o,
 {', '.join(f"sum(value) filter (event_type = '{t}') as m_{t}" for t in ('view', 'click', 'purchase', 'signup'))}, sum(value) filter (event_type = 'error') as m_error, count(*) > 0 as valid from events group by all),
dg as (select g.ts, gy.y, gx.x, coalesce(f, 0) as f, coalesce(o, 0) as o, coalesce(valid, false) as valid, (g.ts % 4) + 1 as lead, {', '.join(f"coalesce(m_{t}, 0) as m_{t}" for t in ('view', 'click', 'purchase', 'signup', 'error'))}
 from (select distinct ts from dd) g, (select unnest(range({H})) as y) gy, (select unnest(range({WD})) as x) gx left join dd on dd.ts = g.ts and dd.y = gy.y and dd.x = gx.x)"""
TYPES = ("view", "click", "purchase", "signup", "error")


def day_grid(spark, sf):
    t, v = C("event_type"), C("value")
    cells = B.table(spark, sf, "events").groupBy(T.slot_index("ts", 1440).alias("ts"), (F.floor(C("user_id") / 15) % 10).alias("y"), (C("user_id") % 15).alias("x")).agg(
        F.max(F.when(t.isin("view", "click"), v)).alias("f"), F.max(F.when(t.isin("purchase", "signup"), v)).alias("o"),
        *[F.sum(F.when(t == k, v)).alias(f"m_{k}") for k in TYPES])
    vals = ["f", "o", *[f"m_{k}" for k in TYPES]]
    d = GR.densify(cells, ["ts"], H, WD, vals)
    # presence was captured as a column before the nulls of absent cells are filled
    return d.select("ts", "y", "x", (C("ts") % 4 + 1).alias("lead"), C("present").alias("valid"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in vals])


def nbw(L, cols):
    lo, hi = L // 2 - 1, L // 2
    return f"""nb as (select a.ts, a.y, a.x, a.lead, {cols} from dg a join dg b on b.ts = a.ts and b.y between a.y - {lo} and a.y + {hi} and b.x between a.x - {lo} and a.x + {hi} group by all)"""


@query("me03_fss", f"""with {DAY_SQL}, {nbw(4, "count(*) filter (b.valid and b.f >= 60) as nf, count(*) filter (b.valid and b.o >= 60) as no, count(*) filter (b.valid) as nv")}
select lead, count(*) as windows, round(1 - sum((nf / nv - no / nv) ** 2) / nullif(sum((nf / nv) ** 2 + (no / nv) ** 2), 0), 6) as fss from nb where nv >= 0.8 * 16 group by lead""")
def me03(spark, sf):
    return r6s(ME.fss(day_grid(spark, sf), ["ts"], ["lead"], 60.0, 4), ["lead", "windows"], ["fss"])


@query("me04_fair_crps", f"""with {EMB_SQL}, a as (select vec_id, label, y, m, unnest(m) as v from e), b as (select vec_id, label, y, any_value(m) as m, avg(abs(v - y)) as err from a group by all),
p as (select vec_id, label, err, len(m) as n, (select sum(abs(x1 - x2)) / 2 from (select unnest(m) as x1), (select unnest(m) as x2)) as pr from b)
select vec_id, label, round(err - pr / (n * (n - 1)), 6) as crps from p""")
def me04(spark, sf):
    return members(spark, sf).select("vec_id", "label", r6(M.fair_crps(C("m"), C("y"))).alias("crps"))


MEMS = ["m_view", "m_click", "m_purchase", "m_signup"]


@query("me05_neighbourhood_crps", f"""with {DAY_SQL}, {nbw(4, ", ".join(f"sum(case when b.valid then b.m_{t} else 0 end) / nullif(count(*) filter (b.valid), 0) as {'ob' if t == 'error' else 'a' + str(i)}" for i, t in enumerate(TYPES)) + ", count(*) filter (b.valid) as nv")},
s as (select lead, (abs(a0 - ob) + abs(a1 - ob) + abs(a2 - ob) + abs(a3 - ob)) / 4 - (abs(a0 - a1) + abs(a0 - a2) + abs(a0 - a3) + abs(a1 - a2) + abs(a1 - a3) + abs(a2 - a3)) / 12 as c from nb where nv >= 0.8 * 16)
select lead, count(*) as n, round(avg(c), 5) as crps from s group by lead""")
def me05(spark, sf):
    d = ME.neighbourhood_crps(day_grid(spark, sf), ["ts"], ["lead"], MEMS, "m_error", 4)
    return d.select("lead", "n", F.round("crps", 5).alias("crps"))


CR_SQL = """cr as (select label, vec_id, avg(abs(v - y)) as err, any_value(m) as m, any_value(y) as y from (select *, unnest(m) as v from e) group by all),
sc as (select label, avg(err - (select sum(abs(x1 - x2)) / 2 from (select unnest(m) as x1), (select unnest(m) as x2)) / (len(m) * (len(m) - 1))) as model, avg(abs(m[1] - y)) as ref from cr group by label)"""


@query("me06_crpss", f"with {EMB_SQL}, {CR_SQL} select label, round(model, 6) as model, round(ref, 6) as reference, round(1 - model / ref, 6) as skill from sc")
def me06(spark, sf):
    m = members(spark, sf)
    ref = ME.crps(m.withColumn("m", F.slice("m", 1, 1)), ["label"])
    return r6s(ME.skill(ME.crps(m, ["label"]), ref, ["label"], "crps"), ["label"], ["model", "reference", "skill"])


CLIM_SQL = f"""cl as (select l_linenumber as lead, {SEASON_SQL} as season, l_suppkey as pixel, l_suppkey // 10 as pool, (l_returnflag = 'R')::int as w, l_discount * 10 as p, l_quantity as omega, strftime(l_shipdate, '%Y-%m') as block_id from lineitem),
c0 as (select lead, season, pixel, pool, count(*) as n, sum(w) as k from cl group by all), c1 as (select lead, season, pool, sum(n) as n1, sum(k) as k1 from c0 group by all), c2 as (select lead, season, sum(n) as n2, sum(k) as k2 from c0 group by all),
cm as (select lead, season, pixel, case when n >= 25 then 'pixel' when n1 >= 25 then 'pool' else 'domain' end as level, case when n >= 25 then k / n when n1 >= 25 then k1 / n1 else k2 / n2 end as freq from c0 join c1 using (lead, season, pool) join c2 using (lead, season))"""


def prob(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        C("l_linenumber").alias("lead"), T.season(C("l_shipdate")).alias("season"), C("l_suppkey").alias("pixel"), F.floor(C("l_suppkey") / 10).alias("pool"),
        (C("l_returnflag") == "R").cast("int").alias("w"), (C("l_discount") * 10).alias("p"), C("l_quantity").alias("omega"), F.date_format("l_shipdate", "yyyy-MM").alias("block_id"), "l_partkey", "l_tax")


@query("me07_climatology", f"with {CLIM_SQL} select lead, season, pixel, level, round(freq, 6) as freq from cm")
def me07(spark, sf):
    return ME.climatology(prob(spark, sf), "pixel", "pool", 25).withColumn("freq", r6(C("freq")))


KS, MIN_N = 16, 25


def sample_sql(src, value, key, by, pixel, pool):
    """Bottom-k samples by hash at three levels, and the level that has enough values."""
    u = uniform_sql(11107, "climatology", key)
    b = ", ".join(by)
    on = f"using ({b})" if by else "on true"
    return f"""cs0 as (select *, {u} as u from {src} where {value} is not null), cn as (select {b}, {pixel}, {pool}, count(*) as n from cs0 group by all), cn1 as (select {b}, {pool}, sum(n) as n1 from cn group by all),
ca as (select {b}, {pixel}, {pool}, list_sort(list({value}::double)) as a from (select * from cs0 qualify row_number() over (partition by {b}, {pixel}, {pool} order by u, {value}) <= {KS}) group by all),
cb1 as (select {b}, {pool}, list_sort(list({value}::double)) as b1 from (select * from cs0 qualify row_number() over (partition by {b}, {pool} order by u, {value}) <= {KS}) group by all),
cc as (select {b}, list_sort(list({value}::double)) as c1 from (select * from cs0 qualify row_number() over (partition by {b} order by u, {value}) <= {KS}) group by all),
smp as (select {b}, {pixel}, case when n >= {MIN_N} then 'pixel' when n1 >= {MIN_N} then 'pool' else 'domain' end as level, case when n >= {MIN_N} then a when n1 >= {MIN_N} then b1 else c1 end as smp
 from cn join cn1 using ({b}, {pool}) join ca using ({b}, {pixel}, {pool}) join cb1 using ({b}, {pool}) join cc using ({b}))"""


@query("me07_empirical_sample", f"""with src as (select *, (l_extendedprice * 100)::bigint as cents, l_linenumber as lead, {SEASON_SQL} as season, l_suppkey as pixel, l_suppkey // 10 as pool from lineitem),
{sample_sql('src', 'l_quantity', "l_orderkey::varchar || '|' || l_linenumber::varchar || '|' || l_partkey::varchar || '|' || l_suppkey::varchar || '|' || cents::varchar", ['lead', 'season'], 'pixel', 'pool')}
select lead, season, pixel, level, len(smp) as n, round(list_avg(smp), 6) as mean, list_min(smp) as low, list_max(smp) as high from smp""")
def me07_sample(spark, sf):
    d = B.table(spark, sf, "lineitem").select(C("l_linenumber").alias("lead"), T.season(C("l_shipdate")).alias("season"), C("l_suppkey").alias("pixel"), F.floor(C("l_suppkey") / 10).alias("pool"),
                                              "l_quantity", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(C("l_extendedprice") * 100).cast("long")).alias("key"))
    s = ME.empirical_climatology(d, "pixel", "pool", "l_quantity", C("key"), KS, MIN_N)
    v = C("sample")
    return s.select("lead", "season", "pixel", "level", F.size(v).cast("long").alias("n"), r6(M.mean(v)).alias("mean"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))


@query("me06_crpss_climatology", f"""with {EMB_SQL}, tr as (select vec_id, y, vec_id % 2 as lead, vec_id % 24 as pixel, vec_id % 6 as pool, label from e), {sample_sql('tr', 'y', 'vec_id', ['lead'], 'pixel', 'pool')},
cr as (select label, vec_id, avg(abs(v - y)) as err, any_value(m) as m from (select *, unnest(m) as v from e) group by all),
mo as (select label, avg(err - (select sum(abs(x1 - x2)) / 2 from (select unnest(m) as x1), (select unnest(m) as x2)) / (len(m) * (len(m) - 1))) as model from cr group by label),
rf as (select label, avg(list_avg(list_transform(smp, lambda x: abs(x - y))) - (select sum(abs(x1 - x2)) / 2 from (select unnest(smp) as x1), (select unnest(smp) as x2)) / (len(smp) * len(smp))) as ref from tr join smp using (lead, pixel) group by label)
select label, round(model, 6) as model, round(ref, 6) as reference, round(1 - model / ref, 6) as skill from mo join rf using (label)""")
def me06_climatology(spark, sf):
    """Skill of the ensembles against the empirical climatology of their observations."""
    m = members(spark, sf).withColumn("lead", C("vec_id") % 2).withColumn("pixel", C("vec_id") % 24).withColumn("pool", C("vec_id") % 6)
    clim = ME.empirical_climatology(m, "pixel", "pool", "y", C("vec_id"), KS, MIN_N, ["lead"])
    ref = ME.climatology_crps(m, clim, ["lead", "pixel"], ["label"])
    return r6s(ME.skill(ME.crps(m, ["label"]), ref, ["label"], "crps"), ["label"], ["model", "reference", "skill"])


@query("me08_brier_skill", f"""with {CLIM_SQL}, b as (select lead, sum(omega * (p - w) ** 2) / sum(omega) as model, sum(omega * (freq - w) ** 2) / sum(omega) as reference from cl join cm using (lead, season, pixel) group by lead)
select lead, round(model, 6) as model, round(reference, 6) as reference, round(1 - model / reference, 6) as skill from b""")
def me08(spark, sf):
    d = prob(spark, sf)
    ref = ME.climatology_brier(d, ME.climatology(d, "pixel", "pool", 25), ["lead", "season", "pixel"], ["lead"])
    return r6s(ME.skill(ME.brier(d, ["lead"]), ref, ["lead"], "brier"), ["lead"], ["model", "reference", "skill"])


@query("me09_reliability", f"""with {CLIM_SQL} select lead, least(floor(p * 20), 19)::int as bin, round(avg(p), 6) as mean_p, round(avg(w), 6) as frequency, count(*) as n, count(distinct block_id) as blocks, count(distinct block_id) < 20 as sparse from cl group by all""")
def me09(spark, sf):
    return r6s(ME.reliability(prob(spark, sf), ["lead"], "block_id"), ["lead", "bin", "n", "blocks", "sparse"], ["mean_p", "frequency"])


QSQL = "1 / (1 + exp(-(0.2 + (0.3 + ln(1 + exp(-0.3))) * (ln(least(1 - 1e-6, greatest(1e-6, p))) - ln(1 - least(1 - 1e-6, greatest(1e-6, p)))))))"


@query("me10_occurrence_gap", f"""with {CLIM_SQL}, g as (select lead, season, pixel % 4 as solar_bin, omega <= 10 as cold, {QSQL} - p as d from cl)
select cold, lead, season, solar_bin, grouping(cold, lead, season, solar_bin) as level, round(avg(d), 6) as gap, round(avg(abs(d)), 6) as abs_gap, count(*) as n from g group by grouping sets ((lead), (lead, season), (solar_bin), (cold), ())""")
def me10(spark, sf):
    d = prob(spark, sf).withColumn("q", V.map_probability(C("p"), F.lit(0.2), F.lit(0.3))).withColumn("solar_bin", C("pixel") % 4).withColumn("cold", C("omega") <= 10)
    out = ME.occurrence_gap(d, [["lead"], ["lead", "season"], ["solar_bin"], ["cold"], []])
    return r6s(out, ["cold", "lead", "season", "solar_bin", "level", "n"], ["gap", "abs_gap"])


@query("me11_spread_skill", f"""with {MM} select label, ((y >= 0)::int + (y >= 0.1)::int)::int as intensity, round(sqrt(avg((1 + 1 / len(m)) * s2)), 6) as spread, round(sqrt(avg((mean - y) ** 2)), 6) as rmse, count(*) as n from mm group by all""")
def me11(spark, sf):
    d = members(spark, sf).withColumn("intensity", T.intensity_bin(C("y"), (0.0, 0.1)))
    return r6s(ME.spread_skill(d, ["label", "intensity"]), ["label", "intensity", "n"], ["spread", "rmse"])


# members rounded to one decimal, so that ties exist
TIE_SQL = f"""{EMB_SQL}, t as (select vec_id, label, list_transform(m, lambda v: floor(v * 10)) as m, floor(y * 10) as y from e),
rk as (select vec_id, label, len(list_filter(m, lambda v: v < y)) as below, len(list_filter(m, lambda v: v = y)) as ties, {uniform_sql(11, 'rank', 'vec_id')} as u from t), rh as (select label, (below + floor(u * (ties + 1)))::int as rank, count(*) as n from rk group by all)"""


def tied(spark, sf):
    return members(spark, sf).withColumn("m", F.transform("m", lambda v: F.floor(v * 10).cast("double"))).withColumn("y", F.floor(C("y") * 10).cast("double"))


@query("me12_rank_histogram", f"with {TIE_SQL} select label, rank, n from rh")
def me12(spark, sf):
    return ME.rank_histogram(tied(spark, sf), ["label"], 11, C("vec_id"))


@query("me13_dispersion", f"""with {TIE_SQL}, ne as (select label, max(len(m)) + 1 as ranks from e group by 1), tt as (select label, sum(n) as t, count(*) as k from rh group by 1), ri as (select label, sum(abs(n / t - 1 / ranks)) + (any_value(ranks) - any_value(k)) / any_value(ranks) as ri from rh join tt using (label) join ne using (label) group by 1),
sp as (select label, sqrt(avg((1 + 1 / len(m)) * list_var_samp(m))) as s, sqrt(avg((list_avg(m) - y) ** 2)) as r from e group by 1)
select label, round(abs(ln(s / r)), 6) as e_ssr, round(ri, 6) as ri from sp join ri using (label)""")
def me13(spark, sf):
    m = members(spark, sf)
    spread = ME.spread_skill(m, ["label"]).join(m.groupBy("label").agg(F.max(F.size("m")).alias("members")), "label")
    d = ME.dispersion(spread, ME.rank_histogram(tied(spark, sf), ["label"], 11, C("vec_id")), ["label"], "members")
    return r6s(d, ["label"], ["e_ssr", "ri"])


@query("me14_tail", f"""with {EMB_SQL}, t as (select label, avg(len(list_filter(m, lambda v: v >= 0.1)) / len(m)) as f_pred, avg((y >= 0.1)::int) as f_obs, quantile_cont(y, 0.9) as q90, quantile_cont(y, 0.99) as q99 from e group by 1)
select label, round(f_pred, 6) as f_pred, round(f_obs, 6) as f_obs, round(abs(f_pred - f_obs), 6) as e_freq, round(q90, 6) as q90, round(q99, 6) as q99 from t""")
def me14(spark, sf):
    m = members(spark, sf)
    q = SA.grouped_quantiles(m, ["label"], "y", {"q90": 0.9, "q99": 0.99}).drop("n")
    return r6s(ME.tail(m, ["label"], 0.1).join(q, "label"), ["label"], ["f_pred", "f_obs", "e_freq", "q90", "q99"])


EDGES = (0.02, 0.05, 0.1, 0.2, 0.9)


@query("me14_wet_histogram", f"""with {EMB_SQL}, ed as (select i - 1 as bin, [{', '.join(map(str, EDGES))}][i]::double as edge, coalesce([{', '.join(map(str, EDGES))}][i + 1], 'infinity'::double)::double as upto from range(1, {len(EDGES) + 1}) as r(i)),
g as (select distinct label from e)
select label, bin::int as bin, edge, (select count(*) from e where e.label = g.label and y >= edge and y < upto) as observed,
 (select count(*) from (select label, unnest(m) as v from e) u where u.label = g.label and v >= edge and v < upto) as members from g, ed""")
def me14_histogram(spark, sf):
    """Wet values of members and observations in fixed bins, per label; the last bin is empty."""
    return ME.wet_histogram(members(spark, sf), ["label"], EDGES)


OOF = """of as (select l_linenumber as lead, l_discount * 10 as p_full, l_tax * 10 as p_fold, ln(1 + l_quantity) as mu_full, ln(1 + l_quantity) * (1 + 0.02 * (l_suppkey % 3)) as mu_fold, ln(1 + l_extendedprice / 1000) as z from lineitem)"""


@query("me15_oof_shift", f"""with {OOF} select lead, round(avg(p_full - p_fold), 6) as mean_dp, round(avg(mu_full - mu_fold), 6) as mean_dmu, round(sqrt(avg((z - mu_full) ** 2) / avg((z - mu_fold) ** 2)), 6) as rms_ratio,
 {', '.join(f"round(quantile_cont({e}, {q}), 6) as {n}_q{t}" for n, e in (('dp', 'p_full - p_fold'), ('dmu', 'mu_full - mu_fold')) for q, t in ((0.05, '05'), (0.95, '95')))} from of group by 1""")
def me15(spark, sf):
    d = B.table(spark, sf, "lineitem").select(
        C("l_linenumber").alias("lead"), (C("l_discount") * 10).alias("p_full"), (C("l_tax") * 10).alias("p_fold"), F.log1p("l_quantity").alias("mu_full"),
        (F.log1p("l_quantity") * ((C("l_suppkey") % 3) * F.lit(0.02) + 1)).alias("mu_fold"), F.log1p(C("l_extendedprice") / 1000).alias("z"))
    return r6s(ME.oof_shift(d, ["lead"]), ["lead"], ["mean_dp", "mean_dmu", "rms_ratio", "dp_q05", "dp_q95", "dmu_q05", "dmu_q95"])


@query("me16_location_diagnostics", f"""with {EMB_SQL}, u as (select vec_id, label, y >= 0.05 as wet, 1 + vec_id % 3 as w, 0.01 * label + 0.005 as sh, unnest(m) + 0.05 as z from e), c as (select *, z + sh as z1 from u)
select label, round(max(sh) / 0.08, 6) as support_ratio, round(sum(w * ((z >= 0.08) <> (z1 >= 0.08))::int) / sum(w), 6) as flip_fraction, round(sum(w * (not wet and z1 > 0 and z1 < 0.08)::int) / sum(w * (not wet)::int), 6) as dry_band_mass,
 round(sum(w * (not wet and z1 >= 0.08)::int) / sum(w * (not wet)::int), 6) as dry_leak_mass, round(0.08 / 0.2, 6) as leak_sensitivity from c group by label""")
def me16(spark, sf):
    d = members(spark, sf).select("vec_id", "label", (C("y") >= 0.05).alias("wet"), (C("vec_id") % 3 + 1).cast("double").alias("w"), (C("label") * F.lit(0.01)).alias("b"), F.lit(0.005).alias("d"),
                                  F.lit(0.2).alias("s_oof"), F.transform("m", lambda v: v + 0.05).alias("m"))
    return r6s(ME.location_diagnostics(d, ["label"], 0.08), ["label"], ["support_ratio", "flip_fraction", "dry_band_mass", "dry_leak_mass", "leak_sensitivity"])


@query("me17_variance_ratios", f"with {ROWS_SQL} select lead, round(var_pop(z - mu) / var_pop(z), 6) as residual_ratio, round(1 - avg((z - mu) ** 2) / var_pop(z), 6) as explained from rw group by 1")
def me17(spark, sf):
    return r6s(ME.variance_ratios(rows(spark, sf), ["lead"]), ["lead"], ["residual_ratio", "explained"])


@query("me18_mask_distance_audit", f"""with {CHEB_SQL} select distance_bin, round(avg((v / 100 - 0.5) ** 2), 5) as mse, round(avg(v / 100 - 0.5), 6) as bias, count(*) as n from cb where present and distance_bin <> '0' group by 1""")
def me18(spark, sf):
    d = GR.chebyshev_bin(dense(spark, sf), ["ts"], ~F.coalesce("valid", F.lit(True))).filter("present").select("distance_bin", (C("v") / 100).alias("f"), F.lit(0.5).alias("o"))
    out = ME.mask_distance_audit(d)
    return out.select("distance_bin", F.round("mse", 5).alias("mse"), r6(C("bias")).alias("bias"), "n")


@query("me19_expected_total", f"with {MM} select vec_id // 12 as sample, round(sum(mean), 6) as total from mm group by 1")
def me19(spark, sf):
    d = members(spark, sf).withColumn("sample", F.floor(C("vec_id") / 12))
    return r6s(ME.expected_total(d, ["sample"]), ["sample"], ["total"])


@query("jn26_paired_arms", f"""with a as (select l_linenumber as lead, l_suppkey as pixel, strftime(l_shipdate, '%Y-%m') as block_id, avg(l_quantity) as s from lineitem where l_returnflag <> 'R' group by all),
b as (select l_linenumber as lead, l_suppkey as pixel, strftime(l_shipdate, '%Y-%m') as block_id, avg(l_quantity) as s from lineitem where l_returnflag = 'R' group by all)
select coalesce(a.lead, b.lead) as lead, case when a.s is null then 'only_b' when b.s is null then 'only_a' else 'paired' end as kind, count(*) as n, round(sum(a.s - b.s), 4) as diff from a full join b using (lead, pixel, block_id) group by all""")
def jn26(spark, sf):
    d = B.table(spark, sf, "lineitem").select(C("l_linenumber").alias("lead"), C("l_suppkey").alias("pixel"), F.date_format("l_shipdate", "yyyy-MM").alias("block_id"), "l_quantity", "l_returnflag")
    g = [d.filter(c).groupBy("lead", "pixel", "block_id").agg(F.avg("l_quantity").alias("s")) for c in (C("l_returnflag") != "R", C("l_returnflag") == "R")]
    j, lone = ME.paired_arms(g[0], g[1], ["lead", "pixel", "block_id"], ["s"])
    a = j.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(C("s_a") - C("s_b")), 4).alias("diff")).withColumn("kind", F.lit("paired"))
    b = lone.groupBy("lead", F.concat(F.lit("only_"), "only").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("diff", F.lit(None).cast("double"))
    return a.unionByName(b)


REPS = 2000
BOOT_SQL = f"""ct as (select l_returnflag as stratum, strftime(l_shipdate, '%Y-%m') as block_id, sum(abs(l_extendedprice / 2000 - l_quantity)) as a, sum(abs(l_extendedprice / 1800 - l_quantity)) as b, count(*)::double as n from lineitem group by all),
ix as (select *, row_number() over (partition by stratum order by sha256(block_id), block_id) - 1 as i, count(*) over (partition by stratum) as k from ct),
pk as (select replicate, stratum, floor({uniform_sql(11101, 'bootstrap', "replicate::varchar || '|' || stratum || '|' || slot::varchar")} * k)::bigint as i from (select unnest(range({REPS})) as replicate), (select stratum, i as slot, k from ix)),
bs as (select replicate, sum(a) as a, sum(b) as b, sum(n) as n from pk join ix using (stratum, i) group by 1)"""


def boot(spark, sf):
    ct = B.table(spark, sf, "lineitem").select(
        C("l_returnflag").alias("stratum"), F.date_format("l_shipdate", "yyyy-MM").alias("block_id"), F.abs(C("l_extendedprice") / 2000 - C("l_quantity")).alias("a"),
        F.abs(C("l_extendedprice") / 1800 - C("l_quantity")).alias("b"), F.lit(1.0).alias("n"))
    return ME.block_bootstrap(ct, ["a", "b", "n"], REPS)


@query("me20_block_bootstrap", f"with {BOOT_SQL} select replicate, round(a / n, 6) as mae_a, round(b / n, 6) as mae_b, n from bs")
def me20(spark, sf):
    return boot(spark, sf).select("replicate", r6(C("a") / C("n")).alias("mae_a"), r6(C("b") / C("n")).alias("mae_b"), "n")


@query("me20_bootstrap_interval", f"with {BOOT_SQL} select round(quantile_cont((a - b) / n, 0.025), 6) as low, round(quantile_cont((a - b) / n, 0.5), 6) as mid, round(quantile_cont((a - b) / n, 0.975), 6) as high from bs")
def me20b(spark, sf):
    return r6s(ME.interval(boot(spark, sf), (C("a") - C("b")) / C("n")), [], ["low", "mid", "high"])


@query("me21_band_score", f"with {DET_SQL}, s as (select case when lead <= 3 then 'early' else 'late' end as band, lead, avg(abs(f - o)) as mae from dt group by all) select band, round(avg(mae), 6) as band_score, count(*) as leads from s group by 1")
def me21(spark, sf):
    s = det(spark, sf).groupBy("lead").agg(F.avg(F.abs(C("f") - C("o"))).alias("mae")).withColumn("band", F.when(C("lead") <= 3, "early").otherwise("late"))
    return ME.band_score(s, ["band"], "mae").withColumn("band_score", r6(C("band_score")))


SEED_SQL = """sd as (select l_returnflag as arm, l_suppkey % 3 as seed, avg(abs(l_extendedprice / 2000 - l_quantity)) as score from lineitem group by all)"""


def seeds(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy(C("l_returnflag").alias("arm"), (C("l_suppkey") % 3).alias("seed")).agg(
        F.avg(F.abs(C("l_extendedprice") / 2000 - C("l_quantity"))).alias("score"))


@query("me22_seed_stability", f"""with {SEED_SQL}, j as (select c.arm, c.score, r.score as ref from sd c join sd r on r.arm = 'A' and r.seed = c.seed where c.arm <> 'A'),
g as (select arm, stddev_samp(score) as s_cand, stddev_samp(ref) as s_ref, stddev_samp(score - ref) as delta_sd, avg(score - ref) as delta from j group by arm)
select arm, {s6(['s_cand', 's_ref', 'delta_sd', 'delta'])}, round(sqrt((s_cand ** 2 + s_ref ** 2) / 2), 6) as sigma, abs(delta) < sqrt((s_cand ** 2 + s_ref ** 2) / 2) as tie from g""")
def me22(spark, sf):
    return r6s(ME.seed_stability(seeds(spark, sf), "A"), ["arm", "tie"], ["s_cand", "s_ref", "delta_sd", "delta", "sigma"])


GATE_SQL = """ci as (select arm, baseline, metric, low, high from (select l_returnflag as arm, l_linestatus as baseline, 'disc' as metric, avg(l_discount) - 0.001 as low, avg(l_discount) + 0.001 as high from lineitem group by all union all
 select l_returnflag, l_linestatus, 'tax', avg(l_tax) - 0.001, avg(l_tax) + 0.001 from lineitem group by all)), ru as (select * from (values ('disc', 'upper_below', 0.0512), ('tax', 'lower_above', 0.039)) t(metric, side, bound)),
gt as (select arm, bool_and(case when side = 'upper_below' then high <= bound else low >= bound end) as passed, count(*) filter (not (case when side = 'upper_below' then high <= bound else low >= bound end)) as failed from ci join ru using (metric) group by arm)"""


def gates(spark, sf):
    li = B.table(spark, sf, "lineitem")
    d = li.groupBy(C("l_returnflag").alias("arm"), C("l_linestatus").alias("baseline")).agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    ci = d.select("arm", "baseline", F.explode(F.map_from_arrays(F.array(F.lit("disc"), F.lit("tax")), F.array("disc", "tax"))).alias("metric", "v")).select(
        "arm", "baseline", "metric", (C("v") - 0.001).alias("low"), (C("v") + 0.001).alias("high"))
    rules = spark.createDataFrame([("disc", "upper_below", 0.0512), ("tax", "lower_above", 0.039)], "metric string, side string, bound double")
    return ME.gate(ci, F.broadcast(rules))  # a handful of rules


@query("me23_gate", f"with {GATE_SQL} select arm, passed, failed from gt")
def me23(spark, sf):
    return gates(spark, sf)


@query("me23_gate_incomplete", """with ci as (select l_returnflag as arm, l_linestatus as baseline, 'disc' as metric, avg(case when l_returnflag <> 'A' then l_discount end) as high, avg(l_discount) as low from lineitem group by all union all
 select l_returnflag, l_linestatus, 'tax', avg(l_tax), avg(l_tax) from lineitem where l_returnflag <> 'R' group by all), ru(metric, side, bound) as (values ('disc', 'upper_below', 1.0), ('tax', 'lower_above', 0.0)),
 j as (select a.arm, coalesce(case when side = 'upper_below' then high <= bound else low >= bound end, false) as ok from (select distinct arm, baseline from ci) a join ru on true left join ci on ci.arm = a.arm and ci.baseline = a.baseline and ci.metric = ru.metric)
select arm, bool_and(ok) as passed, count(*) filter (not ok) as failed from j group by arm""")
def me23_incomplete(spark, sf):
    """An arm with a null bound and an arm without a metric fail, although nothing that is there breaks a rule."""
    li = B.table(spark, sf, "lineitem")
    d = li.groupBy(C("l_returnflag").alias("arm"), C("l_linestatus").alias("baseline")).agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    disc = d.select("arm", "baseline", F.lit("disc").alias("metric"), C("disc").alias("low"), F.when(C("arm") != "A", C("disc")).alias("high"))
    tax = d.filter("arm <> 'R'").select("arm", "baseline", F.lit("tax").alias("metric"), C("tax").alias("low"), C("tax").alias("high"))
    rules = spark.createDataFrame([("disc", "upper_below", 1.0), ("tax", "lower_above", 0.0)], "metric string, side string, bound double")
    return ME.gate(disc.unionByName(tax), rules)


@query("me23_band_gate", """with ru(band, baseline, metric, side, bound) as (values ('short', 'F', 'disc', 'upper_below', 0.0515), ('short', 'O', 'disc', 'upper_below', 0.0515), ('long', 'O', 'tax', 'lower_over', 0.0), ('long', 'X', 'tax', 'lower_over', 0.0)),
d as (select (l_suppkey % 5)::varchar as arm, l_linestatus as baseline, case when l_linenumber <= 3 then 'short' else 'long' end as band, avg(l_discount) as disc, avg(l_tax) as tax from lineitem group by all),
ci as (select arm, baseline, band, 'disc' as metric, disc - 0.001 as low, disc + 0.001 as high from d union all select arm, baseline, band, 'tax', tax, tax from d union all select arm, 'X', 'long', 'tax', 0.0, 1.0 from d where arm = '0' union all
 select arm, 'X', 'long', 'tax', 0.5, 1.0 from d where arm in ('1', '2')),
j as (select a.arm, ru.*, coalesce(bool_and(case when side = 'upper_below' then high <= bound else low > bound end), false) as ok from (select distinct arm from ci) a join ru on true
 left join ci on ci.arm = a.arm and ci.baseline = ru.baseline and ci.band = ru.band and ci.metric = ru.metric group by all)
select arm, bool_and(ok) as passed, count(*) filter (not ok) as failed from j group by arm""")
def me23_band(spark, sf):
    """Rules with a band and a baseline of their own; arms that lack the baseline X, or whose interval there touches the bound, fail."""
    band = F.when(C("l_linenumber") <= 3, "short").otherwise("long")
    d = B.table(spark, sf, "lineitem").groupBy((C("l_suppkey") % 5).cast("string").alias("arm"), C("l_linestatus").alias("baseline"), band.alias("band")).agg(
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    disc = d.select("arm", "baseline", "band", F.lit("disc").alias("metric"), (C("disc") - 0.001).alias("low"), (C("disc") + 0.001).alias("high"))
    tax = d.select("arm", "baseline", "band", F.lit("tax").alias("metric"), C("tax").alias("low"), C("tax").alias("high"))
    x = d.filter("arm in ('0', '1', '2')").select("arm", F.lit("X").alias("baseline"), F.lit("long").alias("band"), F.lit("tax").alias("metric"), F.when(C("arm") == "0", 0.0).otherwise(0.5).alias("low"), F.lit(1.0).alias("high"))
    rules = spark.createDataFrame([("short", "F", "disc", "upper_below", 0.0515), ("short", "O", "disc", "upper_below", 0.0515), ("long", "O", "tax", "lower_over", 0.0), ("long", "X", "tax", "lower_over", 0.0)],
                                  "band string, baseline string, metric string, side string, bound double")
    return ME.gate(disc.unionByName(tax).unionByName(x), rules)


@query("so06_finalists", f"""with s as (select l_suppkey::varchar as arm, avg(abs(l_extendedprice / 2000 - l_quantity)) as score, avg(l_discount) <= 0.05 as passed from lineitem group by 1), r as (select *, row_number() over (partition by passed order by score, arm) as rn from s)
select arm, round(score, 6) as score, passed from r where (passed and rn <= 5) or arm = '7'""")
def so06(spark, sf):
    s = B.table(spark, sf, "lineitem").groupBy(C("l_suppkey").cast("string").alias("arm")).agg(F.avg(F.abs(C("l_extendedprice") / 2000 - C("l_quantity"))).alias("score"), (F.avg("l_discount") <= 0.05).alias("passed"))
    return ME.finalists(s, 5, ["7"]).withColumn("score", r6(C("score")))


@query("me24_uncalibrated_mass", ladder_sql("blocks >= 80 and ess >= 45 and rank < 1") + """, ms as (select lead, condition_signature, sum(mass) as w from st group by all)
select lead, round(sum(case when terminal then w else 0 end) / sum(w), 6) as share, sum(case when terminal then w else 0 end) / sum(w) > 0.01 as failed from ms join (select lead, condition_signature, terminal from pick) using (lead, condition_signature) group by lead""")
def me24(spark, sf):
    from ..operators import calibration as CB
    st = CB.residual_blocks(rows(spark, sf))
    support = CB.ladder_support(CB.ladder_blocks(st)).filter("rank < 1")
    wt = st.groupBy("lead", "condition_signature").agg(F.sum("mass").alias("weight"))
    cells = CB.select_level(wt, support, (), 80, 45.0).join(wt, ["lead", "condition_signature"])
    return ME.uncalibrated_mass(cells, ["lead"]).withColumn("share", r6(C("share")))
