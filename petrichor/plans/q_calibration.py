"""Ladder, scales, calibration fits and record lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as CB
from ..operators import stats as SS
from . import bindings as B
from .bindings import r6
from .q_scalars import EMB_SQL, members
from .registry import query

C = F.col
RARE = "era5_oracle:era=1:tp=1:target_end_causal"
GATE = dict(min_blocks=75, min_ess=45.0)
SIG_SQL = f"""case when l_partkey % 40 = 0 then '{RARE}' when l_partkey % 3 = 0 then '{B.SOURCE_SIG}' when l_partkey % 3 = 1 then '{B.TP_OFF_SIG}' else '{B.NULL_SIG}' end"""
ROWS_SQL = f"""rw as (select l_linenumber as lead, {SIG_SQL} as condition_signature, strftime(l_shipdate, '%Y-%m') as block_id, ln(1 + l_extendedprice / 1000) as z, ln(1 + l_quantity) as mu,
 l_tax < 0.08 as valid, l_quantity as omega, l_discount * 10 as p, (l_returnflag = 'R')::int as y, l_suppkey % 3 as fold from lineitem)"""


def rows(spark, sf):
    k = C("l_partkey")
    sig = (F.when(k % 40 == 0, RARE).when(k % 3 == 0, B.SOURCE_SIG).when(k % 3 == 1, B.TP_OFF_SIG).otherwise(B.NULL_SIG))
    return B.table(spark, sf, "lineitem").select(
        C("l_linenumber").alias("lead"), sig.alias("condition_signature"), F.date_format("l_shipdate", "yyyy-MM").alias("block_id"),
        F.log1p(C("l_extendedprice") / 1000).alias("z"), F.log1p("l_quantity").alias("mu"), (C("l_tax") < 0.08).alias("valid"),
        C("l_quantity").alias("omega"), (C("l_discount") * 10).alias("p"), (C("l_returnflag") == "R").alias("wet"),
        (C("l_suppkey") % 3).alias("fold"))


LADDER_SQL = """lv as (select *, unnest([{'rank': 0, 'level': 'full_cell', 'key': condition_signature},
 {'rank': 1, 'level': 'lead_provider_era_present', 'key': string_split(condition_signature, ':')[1] || ':' || string_split(condition_signature, ':')[2]},
 {'rank': 2, 'level': 'lead_provider', 'key': string_split(condition_signature, ':')[1]}, {'rank': 3, 'level': 'lead_only', 'key': '*'}]) as k from st),
lb as (select lead, k.rank as rank, k.level as level, k.key as key, block_id, sum(mass) as mass, sum(sq) as sq, sum(pixels)::bigint as pixels, max(pos) as pos, max(neg) as neg from lv group by all),
sp as (select lead, rank, level, key, count(*) as blocks, sum(mass) ** 2 / sum(mass * mass) as ess, sum(mass) as mass, sum(sq) as sq, sum(pos) as pos_blocks, sum(neg) as neg_blocks from lb group by all),
ce as (select distinct lead, condition_signature, k from lv),
ok as (select ce.lead, ce.condition_signature, sp.*, row_number() over (partition by ce.lead, ce.condition_signature order by sp.rank) as rn from ce join sp on sp.lead = ce.lead and sp.level = ce.k.level and sp.key = ce.k.key
  where {gate}),
pick as (select c.lead, c.condition_signature, o.level, o.key, o.blocks, o.ess, o.mass, o.sq, o.level is null as terminal from (select distinct lead, condition_signature from ce) c
  left join (select lead, condition_signature, level, key, blocks, ess, mass, sq from ok where rn = 1) o using (lead, condition_signature))"""
ST_SQL = """st as (select lead, condition_signature, block_id, sum(omega) as mass, sum(omega * (z - mu) ** 2) as sq, count(*) as pixels, max(y) as pos, max(1 - y) as neg from rw where valid group by all)"""


def ladder_sql(gate):
    body = LADDER_SQL.replace("{gate}", gate).replace("ok as (select ce.lead, ce.condition_signature, sp.*,", "ok as (select ce.lead, ce.condition_signature, sp.level, sp.key, sp.blocks, sp.ess, sp.mass, sp.sq,")
    return f"with {ROWS_SQL}, {ST_SQL}, {body}"


G1 = "blocks >= 75 and ess >= 45"
G2 = "blocks >= 75 and ess >= 45 and pos_blocks >= 70 and neg_blocks >= 70"


@query("ag15_pooling_ladder", ladder_sql(G2) + " select lead, condition_signature, level, key, blocks, round(ess, 6) as ess, terminal from pick")
def ag15(spark, sf):
    m = SS.block_masses(rows(spark, sf).filter("valid"), ["lead", "condition_signature"], "block_id", "omega", C("wet"))
    return CB.pooling_ladder(m, 75, 45.0, 70).withColumn("ess", r6(C("ess")))


SCALES = " select lead, condition_signature, level, blocks, round(ess, 6) as ess, cell_pixels, round(case when not terminal then greatest(sqrt(sq / mass), 1e-3) end, 6) as scale, terminal as unsupported from pick join (select lead, condition_signature, sum(pixels)::bigint as cell_pixels from st group by all) using (lead, condition_signature)"


@query("ag16_residual_scales", ladder_sql(G1) + SCALES)
def ag16(spark, sf):
    s = CB.residual_scales(CB.residual_blocks(rows(spark, sf)), 1e-3, **GATE)
    return s.withColumn("ess", r6(C("ess"))).withColumn("scale", r6(C("scale")))


@query("ag17_merge_scale_states", ladder_sql(G1) + SCALES)
def ag17(spark, sf):
    r = rows(spark, sf)
    shards = [CB.residual_blocks(r.filter(C("fold") == k)) for k in range(3)]
    states = CB.merge_scale_states(shards[0].unionByName(shards[1]).unionByName(shards[2]))
    s = CB.residual_scales(states, 1e-3, **GATE)
    return s.withColumn("ess", r6(C("ess"))).withColumn("scale", r6(C("scale")))


LOC_SQL = """fm as (select lead, fold, sum(omega) as mass, sum(omega * (z - mu * (1 + 0.01 * fold))) / sum(omega) as mean, sum(omega * (z - mu * (1 + 0.01 * fold)) ** 2) / sum(omega) as second from rw where valid group by all),
mx as (select lead, sum(mass * mean) / sum(mass) as mix_mean, sum(mass * second) / sum(mass) - (sum(mass * mean) / sum(mass)) ** 2 as mix_variance from fm group by lead),
f1 as (select lead, sum(omega * (z - mu)) / sum(omega) as mean from rw where valid group by lead),
fu as (select lead, any_value(mean) as mean, sum(omega * (z - mu - mean) ** 2) / sum(omega) as variance from rw join f1 using (lead) where valid group by lead),
loc as (select lead, mean - sqrt(variance / mix_variance) * mix_mean as b, sqrt(variance / mix_variance) as c, mix_mean, mix_variance, mean as full_mean, variance as full_variance from mx join fu using (lead))"""


def location(spark, sf):
    r = rows(spark, sf).filter("valid")
    k = r.withColumn("fr", C("z") - C("mu") * (1 + C("fold") * F.lit(0.01))).withColumn("full", C("z") - C("mu"))
    return CB.fit_location_scale(CB.fold_moments(k, ["lead"], "fold", "fr", "omega"), SS.weighted_moments(k, ["lead"], "full", "omega"), ["lead"])


@query("ag18_fit_location_scale", f"with {ROWS_SQL}, {LOC_SQL} select lead, " + ", ".join(f"round({c}, 6) as {c}" for c in ("b", "c", "mix_mean", "mix_variance", "full_mean", "full_variance")) + " from loc")
def ag18(spark, sf):
    d = location(spark, sf)
    return d.select("lead", *[r6(C(c)).alias(c) for c in d.columns if c != "lead"])


MEMB_SQL = f"""{EMB_SQL}, rc as (select distinct label, 0.01 * label as b, 1.1 as c from e),
m0 as (select e.label, len(m) as nm, list_avg(m) as mm, list_var_samp(m) as s2, y, 1 + vec_id % 5 as w, b, c from e join rc using (label)),
m1 as (select *, y - (b + c * mm) as e0 from m0), m2 as (select label, sum(w * e0) / sum(w) as d, abs(sum(w * e0) / sum(w)) / sqrt(sum(w * e0 * e0) / sum(w)) as bias_fraction from m1 group by label),
m3 as (select label, any_value(d) as d, any_value(bias_fraction) as bias_fraction, sqrt(sum(w * (e0 - d) ** 2) / sum(w * (1 + 1 / nm) * c * c * s2)) as gamma from m1 join m2 using (label) group by label)"""


@query("ag19_fit_sampler", f"with {MEMB_SQL} select label, round(d, 6) as d, round(bias_fraction, 6) as bias_fraction, round(gamma, 6) as gamma from m3")
def ag19(spark, sf):
    m = members(spark, sf).withColumnRenamed("y", "residual").withColumn("w", (1 + C("vec_id") % 5).cast("double"))
    rec = m.select("label").distinct().withColumn("b", C("label") * 0.01).withColumn("c", F.lit(1.1))
    out = CB.fit_sampler(m, rec, ["label"], True)
    return out.select("label", *[r6(C(c)).alias(c) for c in ("d", "bias_fraction", "gamma")])


def newton_sql(steps=12):
    ctes = ["dt as (select lead, least(1 - 1e-6, greatest(1e-6, p)) as q, sum(omega) as w, sum(omega * y) as wy from rw group by all)",
            "dx as (select *, ln(q) - ln(1 - q) as x from dt)",
            "p0 as (select lead, ln(sum(wy) / (sum(w) - sum(wy))) as a, 1.0::double as s from dx group by lead)"]
    for i in range(steps):
        ctes.append(f"g{i} as (select lead, a, s, sum(w * f - wy) as ga, sum((w * f - wy) * x) as gb, sum(w * f * (1 - f)) as haa, sum(w * f * (1 - f) * x) as hab, "
                    f"sum(w * f * (1 - f) * x * x) as hbb from (select dx.*, a, s, 1 / (1 + exp(-(a + s * x))) as f from dx join p{i} using (lead)) group by all)")
        ctes.append(f"n{i} as (select *, greatest(1e-8, s - greatest(-4, least(4, (haa * gb - hab * ga) / (haa * hbb - hab * hab)))) as s1 from g{i})")
        ctes.append(f"p{i + 1} as (select lead, a - greatest(-4, least(4, case when s1 > 1e-8 then (hbb * ga - hab * gb) / (haa * hbb - hab * hab) else ga / haa end)) as a, s1 as s from n{i})")
    return f"with {ROWS_SQL}, {', '.join(ctes)} select lead, round(a, 6) as alpha, round(s, 6) as slope from p{steps}"


@query("it03_fit_probability", newton_sql())
def it03(spark, sf):
    d = rows(spark, sf).select("lead", "p", C("wet").cast("double").alias("y"), C("omega").alias("w"))
    return CB.fit_probability(d, ["lead"]).select("lead", r6(C("alpha")).alias("alpha"), r6(C("slope")).alias("slope"))


@query("it03_terminal_cells", f"with {ROWS_SQL} select distinct lead, lead in (5, 7) as terminal, case when lead in (5, 7) then 0.0::double end as alpha, case when lead in (5, 7) then 1.0::double end as slope from rw")
def it03_terminal(spark, sf):
    """A lead with one class only and a lead without support keep the identity; the others are fitted."""
    d = rows(spark, sf).select("lead", "p", F.when(C("lead") == 7, F.lit(0.0)).otherwise(C("wet").cast("double")).alias("y"), C("omega").alias("w"))
    fit = CB.fit_probability(d, ["lead"], supported=d.select("lead").distinct().filter("lead <> 5"))
    return fit.select("lead", "terminal", F.when(C("terminal"), C("alpha")).alias("alpha"), F.when(C("terminal"), C("slope")).alias("slope"))


@query("jn21_required_keys", f"""with {ROWS_SQL}, k as (select lead, sig, arm, threshold from (select distinct lead from rw), (select distinct condition_signature as sig from rw), (select unnest(['checkpoint', 'ensemble']) as arm), (select unnest([0.1, 1.0, 5.0])::double as threshold)),
f as (select distinct lead, condition_signature as sig from rw where valid and condition_signature <> '{RARE}')
select lead, sig as condition_signature, arm, threshold, (lead, sig) in (select (lead, sig) from f) as found from k""")
def jn21(spark, sf):
    r = rows(spark, sf)
    need = CB.required_keys(r.select("lead").distinct(), r.select("condition_signature").distinct(), [0.1, 1.0, 5.0], ["checkpoint", "ensemble"])
    have = r.filter(C("valid") & (C("condition_signature") != RARE)).select("lead", "condition_signature", F.lit(True).alias("found")).distinct()
    return need.join(have, ["lead", "condition_signature"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("jn22_resolve_calibration", f"""with {ROWS_SQL}, {LOC_SQL}, rec as (select lead, b, c, lead = 2 as terminal from loc where lead <> 7),
j as (select rw.lead, rw.condition_signature, rec.*, rec.lead is not null as hit from (select distinct lead, condition_signature from rw) rw left join rec on rec.lead = rw.lead)
select lead, condition_signature, case when not hit then 'missing_record' when terminal then 'terminal_identity' else 'fitted' end as mode, round(case when hit then case when terminal then 0 else b end end, 6) as b,
 round(case when hit then case when terminal then 1 else c end end, 6) as c from j""")
def jn22(spark, sf):
    rec = location(spark, sf).filter("lead <> 7").withColumn("terminal", C("lead") == 2)
    cells = rows(spark, sf).select("lead", "condition_signature").distinct()
    out = CB.resolve_calibration(cells, rec, ["lead"], {"b": 0.0, "c": 1.0})
    return out.withColumn("b", r6(C("b"))).withColumn("c", r6(C("c")))


@query("jn22_selection_disabled", f"""with {ROWS_SQL}, {LOC_SQL}, rec as (select lead, b, c, lead <= 2 as terminal, lead in (2, 3) as off from loc where lead <> 7),
j as (select rw.lead, rw.condition_signature, rec.*, rec.lead is not null as hit from (select distinct lead, condition_signature from rw) rw left join rec on rec.lead = rw.lead)
select lead, condition_signature, case when not hit then 'missing_record' when off then 'selection_disabled' when terminal then 'terminal_identity' else 'fitted' end as mode, round(case when hit then case when terminal or off then 0 else b end end, 6) as b from j""")
def jn22_disabled(spark, sf):
    """A record that selection has left out passes the raw value, whether it is terminal or fitted."""
    rec = location(spark, sf).filter("lead <> 7").withColumn("terminal", C("lead") <= 2).withColumn("off", C("lead").isin(2, 3))
    cells = rows(spark, sf).select("lead", "condition_signature").distinct()
    out = CB.resolve_calibration(cells, rec, ["lead"], {"b": 0.0}, "off")
    return out.withColumn("b", r6(C("b")))


@query("jn23_resolve_scale", ladder_sql("blocks >= 80 and ess >= 45 and rank < 1") + """ select lead, condition_signature, count(*) as n, case when terminal then 'regression_only' else 'scaled' end as route,
 round(any_value(case when not terminal then greatest(sqrt(sq / mass), 1e-3) end), 6) as scale from rw join pick using (lead, condition_signature) group by all""")
def jn23(spark, sf):
    r = rows(spark, sf)
    states = CB.residual_blocks(r)
    sums = ("mass", "sq", "pixels")
    support = CB.ladder_support(CB.ladder_blocks(states, sums), sums).filter("rank < 1")
    sc = CB.select_level(states.select("lead", "condition_signature").distinct(), support, ("mass", "sq"), 80, 45.0)
    sc = sc.withColumn("scale", F.when(~C("terminal"), F.greatest(F.sqrt(C("sq") / C("mass")), F.lit(1e-3)))).withColumn("unsupported", C("terminal"))
    cells = r.groupBy("lead", "condition_signature").agg(F.count(F.lit(1)).alias("n"))
    on, off = CB.resolve_scale(cells, sc)
    return on.withColumn("route", F.lit("scaled")).withColumn("scale", r6(C("scale"))).unionByName(
        off.withColumn("route", F.lit("regression_only")).withColumn("scale", F.lit(None).cast("double")))


@query("va05_state_contracts", f"""with {ROWS_SQL}, {ST_SQL}, t as (select lead, condition_signature, sum(mass) as m from st group by all)
select 'mass' as rule, count(*) as n from t where lead = 3 union all select 'missing_cell', count(*) from t where lead = 5 union all select 'negative', count(*) from st where lead = 1""")
def va05(spark, sf):
    st = CB.residual_blocks(rows(spark, sf))
    totals = st.groupBy("lead", "condition_signature").agg(F.sum("mass").alias("weight"))
    totals = totals.filter("lead <> 5").withColumn("weight", F.when(C("lead") == 3, C("weight") + 1).otherwise(C("weight")))
    bad = st.withColumn("pixels", F.when(C("lead") == 1, -C("pixels")).otherwise(C("pixels")))
    return CB.scale_state_violations(bad, totals).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("va06_record_contracts", ladder_sql(G1) + """ select 'ess_above_blocks' as rule, count(*) as n from pick where level = 'full_cell' union all
 select 'not_first_passing', count(*) from pick where level is not null and level <> 'lead_only'""")
def va06(spark, sf):
    m = SS.block_masses(rows(spark, sf).filter("valid"), ["lead", "condition_signature"], "block_id", "omega")
    rec = CB.pooling_ladder(m, **GATE)
    bad = rec.withColumn("ess", F.when(C("level") == "full_cell", C("blocks") + 1.0).otherwise(C("ess"))).withColumn(
        "level", F.when(C("level").isNotNull(), F.lit("lead_only")))
    return CB.record_violations(bad, m, **GATE).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
