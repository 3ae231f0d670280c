"""Axes, regridding, neighbourhoods, collocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import grid as GR
from ..session import cut_lineage
from . import bindings as B
from .bindings import r6
from .q_scalars import LAT_SQL, LON_SQL, customer_lcc, lcc_sql
from .q_stats import SEASON_SQL
from .registry import query

C = F.col
# source axis: one line per nation pair (15) of user columns; centres drift with the data, so they are uneven
AXES_SQL = """sx as (select user_id % 15 as idx, (user_id % 15) * 2.0 + (avg(value) % 1) as centre from events group by 1),
sy as (select (user_id // 15) % 10 as idx, ((user_id // 15) % 10) * 3.0 + (avg(value) % 1) as centre from events group by 1),
bx as (select min(centre) as a, max(centre) as b from sx), byy as (select min(centre) as a, max(centre) as b from sy),
dx as (select k as idx, a + (b - a) * k / 12 as centre from bx, (select unnest(range(13)) as k)), dy as (select k as idx, a + (b - a) * k / 8 as centre from byy, (select unnest(range(9)) as k))"""


def axes(spark, sf):
    """Source and target axes. Means are taken once: each use would add doubles in another order, and a weight that is zero
    up to rounding could come out above the tolerance of the weights."""
    e = B.table(spark, sf, "events")
    a = F.avg("value")

    def src(idx, step):
        return e.groupBy(idx.alias("idx")).agg(a.alias("_a")).select("idx", (C("idx") * F.lit(step) + C("_a") % 1).alias("centre"))

    def dst(s, n):
        ends = s.agg(F.min("centre").alias("a"), F.max("centre").alias("b"))
        return ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("idx"), "a", "b").select(
            "idx", (C("a") + (C("b") - C("a")) * C("idx") / n).alias("centre"))
    sx, sy = cut_lineage(src(C("user_id") % 15, 2.0)), cut_lineage(src(F.floor(C("user_id") / 15) % 10, 3.0))
    return sx, sy, dst(sx, 12), dst(sy, 8)


def edges_sql(t, out):
    return f"""{out} as (select idx, centre, coalesce((lag(centre) over o + centre) / 2, centre - (lead(centre) over o - centre) / 2) as lo,
 coalesce((centre + lead(centre) over o) / 2, centre + (centre - lag(centre) over o) / 2) as hi from {t} window o as (order by idx))"""


def weights_sql(s, d, out):
    """Same integrals, written per basis function: sum over segments of the overlap times the midpoint value."""
    return f"""{edges_sql(d, 'e' + out)},
g{out} as (select idx as seg, centre as l, lead(centre) over (order by idx) as r, row_number() over (order by idx) = 1 as f, row_number() over (order by idx desc) = 2 as z from {s}),
o{out} as (select e.idx as dst, seg, l, r, case when f then lo else greatest(lo, l) end as a, case when z then hi else least(hi, r) end as b, hi - lo as wd from e{out} e join g{out} g
  on g.r is not null and (f or l < hi) and (z or r > lo)),
q{out} as (select *, (a + b) / 2 as m from o{out} where b > a),
{out} as (select dst, src, sum(w) as w from (select dst, seg as src, (b - a) * (r - m) / (r - l) / wd as w from q{out} union all
  select dst, seg + 1, (b - a) * (m - l) / (r - l) / wd from q{out}) group by all having abs(sum(w)) > 1e-14)"""


WX, WY = weights_sql("sx", "dx", "wx"), weights_sql("sy", "dy", "wy")


@query("wn06_cell_edges", f"with {AXES_SQL}, {edges_sql('sx', 'e')} select idx, round(lo, 6) as lo, round(hi, 6) as hi from e")
def wn06(spark, sf):
    e = GR.cell_edges(axes(spark, sf)[0])
    return e.select("idx", r6(C("lo")).alias("lo"), r6(C("hi")).alias("hi"))


@query("jn10_area_weights", f"with {AXES_SQL}, {WX} select dst, src, round(w, 6) as w from wx")
def jn10(spark, sf):
    sx, _, dx, _ = axes(spark, sf)
    return GR.area_weights(sx, dx).select("dst", "src", r6(C("w")).alias("w"))


@query("jn10_weight_invariants", f"with {AXES_SQL}, {WX} select count(*) as weights, 0::bigint as violations from wx")
def jn10b(spark, sf):
    sx, _, dx, _ = axes(spark, sf)
    w = GR.area_weights(sx, dx)
    bad = GR.weight_violations(w, sx, dx).agg(F.count(F.lit(1)).alias("violations"))
    return w.agg(F.count(F.lit(1)).alias("weights")).join(F.broadcast(bad))


FIELD_SQL = "fd as (select epoch_us(ts) // 21600000000 as ts, (user_id // 15) % 10 as y, user_id % 15 as x, sum(value) as v, count(*) filter (event_type = 'error') = 0 as valid from events group by all)"


def fields(spark, sf):
    return B.table(spark, sf, "events").groupBy(
        T.slot_index("ts", 360).alias("ts"), (F.floor(C("user_id") / 15) % 10).alias("y"), (C("user_id") % 15).alias("x")).agg(
        F.sum("value").alias("v"), (F.count_if(C("event_type") == "error") == 0).alias("valid"))


@query("jn11_regrid_mean", f"""with {AXES_SQL}, {WX}, {WY}, {FIELD_SQL}, s as (select ts, wy.dst as dst_y, wx.dst as dst_x, sum(case when valid then v * wx.w * wy.w else 0 end) as n,
 least(1, greatest(0, sum(case when valid then wx.w * wy.w else 0 end))) as m from fd join wx on wx.src = x join wy on wy.src = y group by all)
select ts, dst_y, dst_x, round(case when m > 0.05 then n / m else -1 end, 4) as mean, round(m, 6) as valid_fraction, m > 0.05 and n / m > 60 as wet from s""")
def jn11(spark, sf):
    sx, sy, dx, dy = axes(spark, sf)
    r = GR.regrid_mean(fields(spark, sf), GR.area_weights(sx, dx), GR.area_weights(sy, dy), ["ts"], 0.05, -1.0, 60)
    return r.select("ts", "dst_y", "dst_x", F.round("mean", 4).alias("mean"), r6(C("valid_fraction")).alias("valid_fraction"), "wet")


@query("jn12_regrid_local_max", f"""with {AXES_SQL}, {WX}, {WY}, {FIELD_SQL}, s as (select ts, wy.dst as dst_y, wx.dst as dst_x, max(v) filter (valid) as d
 from fd join wx on wx.src = x and wx.w > 0 join wy on wy.src = y and wy.w > 0 group by all) select ts, dst_y, dst_x, round(coalesce(d, -1), 6) as detail, d is not null as detail_valid from s""")
def jn12(spark, sf):
    sx, sy, dx, dy = axes(spark, sf)
    r = GR.regrid_local_max(fields(spark, sf), GR.area_weights(sx, dx), GR.area_weights(sy, dy), ["ts"], -1.0)
    return r.withColumn("detail", r6(C("detail")))


def near_sql(s, d, out):
    return f"""{out} as (select d.idx as dst, arg_min(s.idx, (round(abs(s.centre - d.centre), 12), s.idx)) as src, min(abs(s.centre - d.centre)) as distance from {d} d, {s} s group by 1)"""


@query("jn13_nearest_index", f"with {AXES_SQL}, {near_sql('sx', 'dx', 'nx')} select dst, src, round(distance, 6) as distance from nx")
def jn13(spark, sf):
    sx, _, dx, _ = axes(spark, sf)
    return GR.nearest_index(sx, dx).withColumn("distance", r6(C("distance")))


@query("jn13_regrid_nearest", f"""with {AXES_SQL}, {near_sql('sx', 'dx', 'nx')}, {near_sql('sy', 'dy', 'ny')}, {FIELD_SQL}
select ts, ny.dst as dst_y, nx.dst as dst_x, round(case when valid then v else 0 end, 6) as detail, valid as detail_valid from fd join nx on nx.src = x join ny on ny.src = y""")
def jn13b(spark, sf):
    sx, sy, dx, dy = axes(spark, sf)
    r = GR.regrid_nearest(fields(spark, sf), GR.nearest_index(sx, dx), GR.nearest_index(sy, dy))
    return r.withColumn("detail", r6(C("detail")))


@query("jn14_linear_interp", f"""with {AXES_SQL}, k as (select idx, centre, idx * idx + centre as val from sx), g as (select *, lead(centre) over o as c2, lead(val) over o as v2 from k window o as (order by idx)),
p as (select event_id, value % 40 as x from events), e as (select min(centre) as a, max(centre) as b, arg_min(val, centre) as va, arg_max(val, centre) as vb from k)
select event_id, round(case when x <= a then va when x >= b then vb else val + (v2 - val) * (x - centre) / (c2 - centre) end, 6) as y
from p, e left join g on x >= centre and x < c2 and x > a and x < b""")
def jn14(spark, sf):
    sx = axes(spark, sf)[0].withColumn("val", C("idx") * C("idx") + C("centre"))
    p = B.table(spark, sf, "events").select("event_id", (C("value") % 40).alias("x"))
    return GR.linear_interp(p, "x", sx, "val").select("event_id", r6(C("y")).alias("y"))


def interp_axis_sql(s, d, e, out):
    return f"""{edges_sql(s, e)}, k{out} as (select idx, centre, hi - lo as sp, lead(centre) over (order by idx) as c2, lead(hi - lo) over (order by idx) as sp2 from {e}),
{out} as (select d.idx as dst, max(case when d.centre >= k.centre and d.centre < c2 then sp + (sp2 - sp) * (d.centre - k.centre) / (c2 - k.centre)
  when c2 is null and d.centre >= k.centre then sp when k.idx = 0 and d.centre < k.centre then sp end) as sp from {d} d, k{out} k group by 1)"""


@query("jn15_geometry_confidence", f"""with {AXES_SQL}, {near_sql('sx', 'dx', 'nx')}, {near_sql('sy', 'dy', 'ny')}, {interp_axis_sql('sx', 'dx', 'ex', 'ix')}, {interp_axis_sql('sy', 'dy', 'ey', 'iy')}
select ny.dst as dst_y, nx.dst as dst_x, round(sqrt(ny.distance ** 2 + nx.distance ** 2), 6) as distance,
 round(1 / (1 + (ny.distance ** 2 + nx.distance ** 2) / (ix.sp ** 2 + iy.sp ** 2)), 6) as confidence from nx join ix on ix.dst = nx.dst, ny join iy on iy.dst = ny.dst""")
def jn15(spark, sf):
    sx, sy, dx, dy = axes(spark, sf)
    g = GR.geometry_confidence(sx, dx, sy, dy)
    return g.select("dst_y", "dst_x", r6(C("distance")).alias("distance"), r6(C("confidence")).alias("confidence"))


H, WD = 10, 15
DENSE_SQL = f"""{FIELD_SQL}, de as (select f.ts, gy.y, gx.x, v, valid, fd.ts is not null as present from (select distinct ts from fd) f, (select unnest(range({H})) as y) gy, (select unnest(range({WD})) as x) gx
 left join fd on fd.ts = f.ts and fd.y = gy.y and fd.x = gx.x)"""


def dense(spark, sf):
    return GR.densify(fields(spark, sf), ["ts"], H, WD, ["v", "valid"])


def nb_sql(L, src="de", cols="sum(case when b.valid then b.v else 0 end) as s, count(*) filter (b.valid) as n", extra=""):
    lo, hi = L // 2 - 1, L // 2
    return f"""nb as (select a.ts, a.y, a.x{extra}, {cols} from {src} a join {src} b on b.ts = a.ts and b.y between a.y - {lo} and a.y + {hi} and b.x between a.x - {lo} and a.x + {hi} group by all)"""


@query("wn08_neighbourhood_sum", f"with {DENSE_SQL}, {nb_sql(4)} select ts, y, x, round(s, 4) as s, n from nb")
def wn08(spark, sf):
    ok = F.coalesce("valid", F.lit(False))
    d = GR.neighbourhood_sum(dense(spark, sf), ["ts"], 4, {"s": F.when(ok, C("v")).otherwise(0.0), "n": ok.cast("long")})
    return d.select("ts", "y", "x", F.round("s", 4).alias("s"), "n")


CHEB_SQL = f"""{DENSE_SQL}, iv as (select ts, y, x from de where not coalesce(valid, true)), cb as (select de.*, case when not coalesce(de.valid, true) then '0' when k <= 2 then '1-2' when k <= 8 then '3-8' else 'far' end as distance_bin
 from (select de.ts, de.y, de.x, de.v, de.valid, de.present, min(greatest(abs(iv.y - de.y), abs(iv.x - de.x))) as k from de left join iv on iv.ts = de.ts group by all) de)"""


@query("wn09_chebyshev_bin", f"with {CHEB_SQL} select ts, y, x, distance_bin from cb")
def wn09(spark, sf):
    return GR.chebyshev_bin(dense(spark, sf), ["ts"], ~F.coalesce("valid", F.lit(True))).select("ts", "y", "x", "distance_bin")


@query("wn14_curvilinear_spacing", f"""with p as (select c_custkey // 25 as y, c_custkey % 25 as x, {lcc_sql(LAT_SQL, LON_SQL)[0]} as gx, {lcc_sql(LAT_SQL, LON_SQL)[1]} as gy from customer),
w as (select y, x, sqrt((gx - lag(gx) over a) ** 2 + (gy - lag(gy) over a) ** 2) / 1000 as w1, sqrt((gx - lead(gx) over a) ** 2 + (gy - lead(gy) over a) ** 2) / 1000 as w2,
 sqrt((gx - lag(gx) over b) ** 2 + (gy - lag(gy) over b) ** 2) / 1000 as h1, sqrt((gx - lead(gx) over b) ** 2 + (gy - lead(gy) over b) ** 2) / 1000 as h2 from p window a as (partition by y order by x), b as (partition by x order by y))
select y, x, round(coalesce((w1 + w2) / 2, w1, w2), 5) as width_km, round(coalesce((h1 + h2) / 2, h1, h2), 5) as height_km from w""")
def wn14(spark, sf):
    g = customer_lcc(spark, sf).select(F.floor(C("c_custkey") / 25).alias("y"), (C("c_custkey") % 25).alias("x"), C("x").alias("gx"), C("y").alias("gy"))
    s = GR.curvilinear_spacing(g)
    return s.select("y", "x", F.round("width_km", 5).alias("width_km"), F.round("height_km", 5).alias("height_km"))


@query("pr26_orient_grid", """with f as (select l_suppkey as k, l_linenumber as y, case when l_suppkey % 2 = 0 then 50.0 - l_linenumber else 20.0 + l_linenumber end as lat, sum(l_quantity) as v from lineitem group by all)
select k, case when k % 2 = 0 then 8 - y else y end::int as y, lat, v, k % 2 = 0 as flipped from f""")
def pr26(spark, sf):
    n = C("l_linenumber")
    f = (B.table(spark, sf, "lineitem").withColumn("lat", F.when(C("l_suppkey") % 2 == 0, 50.0 - n).otherwise(n + 20.0))
         .groupBy(C("l_suppkey").alias("k"), n.alias("y"), "lat").agg(F.sum("l_quantity").alias("v")))
    return GR.orient_grid(f, ["k"]).select("k", "y", "lat", "v", "flipped")


@query("sc13_scan_static_grid", """with f as (select l_suppkey as k, l_linenumber as y, avg(l_quantity) as lat from lineitem group by all), d as (select k, lat - lag(lat) over (partition by k order by y) as d from f)
select k from d where d is not null group by k having not (min(d) > 0 or max(d) < 0)""")
def sc13(spark, sf):
    f = B.table(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("k"), C("l_linenumber").alias("y")).agg(F.avg("l_quantity").alias("lat"))
    return GR.axis_violations(f, ["k"])


THRESHOLDS, RADIUS = (3.0, 5.0, 7.0), 2.2


@query("jn27_collocate_seasons", f"""with st as (select o_custkey, {SEASON_SQL.replace('l_shipdate', 'o_orderdate')} as season, (o_orderkey % 997) / 100.0 as obs, (o_custkey % 97) * 0.31 as sx, (o_custkey % 89) * 0.23 as sy from orders),
g as (select user_id % 15 as cx, (user_id // 15) % 10 as cy, avg(value) / 10 as fc from events group by all),
s1 as (select distinct o_custkey, sx, sy from st), nr as (select o_custkey, avg(fc) as fc_near from s1 join g on ((cx + 0.5) * 2.0 - sx) * ((cx + 0.5) * 2.0 - sx) + ((cy + 0.5) * 2.5 - sy) * ((cy + 0.5) * 2.5 - sy) <= {RADIUS} * {RADIUS} group by 1),
j as (select st.season, fc, fc_near, obs, fc - obs as e from st join g on floor(sx / 2.0) = cx and floor(sy / 2.5) = cy left join nr using (o_custkey))
select season, count(*) as n, round(avg(e), 6) as bias, round(avg(fc_near - obs), 6) as near_bias, round(avg(abs(e)), 6) as mae, round(corr(fc, obs), 6) as r,
 {', '.join(f"count(*) filter (fc >= {t} and obs >= {t}) as hits_{i}, count(*) filter (fc < {t} and obs >= {t}) as misses_{i}, count(*) filter (fc >= {t} and obs < {t}) as false_alarms_{i}" for i, t in enumerate(THRESHOLDS))},
 round(quantile_cont(e, 0.1), 6) as q10, round(quantile_cont(e, 0.5), 6) as median_bias, round(quantile_cont(e, 0.9), 6) as q90 from j group by 1""")
def jn27_seasons(spark, sf):
    """Order values at customers' places against the grid, by season: containing cell, mean of the cells near by, three thresholds."""
    o = B.table(spark, sf, "orders").select("o_custkey", T.season(C("o_orderdate")).alias("season"), ((C("o_orderkey") % 997) / 100).alias("obs"))
    sites = o.select("o_custkey").distinct().select("o_custkey", ((C("o_custkey") % 97) * F.lit(0.31)).alias("sx"), ((C("o_custkey") % 89) * F.lit(0.23)).alias("sy"))
    g = B.table(spark, sf, "events").groupBy((C("user_id") % 15).alias("cx"), (F.floor(C("user_id") / 15) % 10).alias("cy")).agg((F.avg("value") / 10).alias("fc"))
    at = GR.collocate(sites, g, 0.0, 0.0, 2.0, 2.5).select("o_custkey", "fc").join(GR.near_mean(sites, g, ["o_custkey"], RADIUS, 0.0, 0.0, 2.0, 2.5), "o_custkey", "left")
    d = GR.collocation_scores(o.join(at, "o_custkey"), ["season"], THRESHOLDS)
    rounded = ("bias", "near_bias", "mae", "r", "q10", "median_bias", "q90")
    return d.select(*[r6(C(c)).alias(c) if c in rounded else C(c) for c in d.columns])


@query("jn27_collocate", """with st as (select c_custkey, c_nationkey, c_acctbal / 1000 as obs, (c_custkey % 97) * 0.31 as sx, (c_custkey % 89) * 0.23 as sy from customer),
g as (select user_id % 15 as cx, (user_id // 15) % 10 as cy, avg(value) / 10 as fc from events group by all)
select c_nationkey, count(*) as n, round(avg(fc - obs), 6) as bias, round(median(fc - obs), 6) as median_bias, round(avg(abs(fc - obs)), 6) as mae, round(case when not isnan(corr(fc, obs)) then corr(fc, obs) end, 6) as r,
 count(*) filter (fc >= 5 and obs >= 5) as hits, count(*) filter (fc < 5 and obs >= 5) as misses, count(*) filter (fc >= 5 and obs < 5) as false_alarms
from st join g on floor(sx / 2.0) = cx and floor(sy / 2.5) = cy group by 1""")
def jn27(spark, sf):
    st = B.table(spark, sf, "customer").select("c_nationkey", (C("c_acctbal") / 1000).alias("obs"), ((C("c_custkey") % 97) * F.lit(0.31)).alias("sx"),
                                               ((C("c_custkey") % 89) * F.lit(0.23)).alias("sy"))
    g = B.table(spark, sf, "events").groupBy((C("user_id") % 15).alias("cx"), (F.floor(C("user_id") / 15) % 10).alias("cy")).agg(
        (F.avg("value") / 10).alias("fc"))
    from ..operators.sampling import grouped_quantiles
    j = GR.collocate(st, g, 0.0, 0.0, 2.0, 2.5).withColumn("e", C("fc") - C("obs"))
    a = j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("e")).alias("bias"), r6(F.avg(F.abs("e"))).alias("mae"), r6(F.corr("fc", "obs")).alias("r"),
                                     F.count_if((C("fc") >= 5) & (C("obs") >= 5)).alias("hits"), F.count_if((C("fc") < 5) & (C("obs") >= 5)).alias("misses"),
                                     F.count_if((C("fc") >= 5) & (C("obs") < 5)).alias("false_alarms"))
    q = grouped_quantiles(j, ["c_nationkey"], "e", {"median_bias": 0.5}).select("c_nationkey", r6(C("median_bias")).alias("median_bias"))
    return a.join(q, "c_nationkey")
