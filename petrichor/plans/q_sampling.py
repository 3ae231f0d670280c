"""Draws, condition support, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest as MF
from ..operators import ordered as O
from ..operators import sampling as SA
from ..operators import sets as ST
from ..sources import bundle as BU
from ..streaming.streams import scratch
from . import bindings as B
from .q_manifest import COARSE, MIN, coarse_items, index, items, items_sql, w
from .q_scalars import uniform_sql
from .registry import query

C = F.col
SEED, PURPOSE, SIG_PURPOSE = 11103, "draw", "signature"


@B.stored
def cands(spark, sf):
    return ST.draw_candidates(items(spark, sf).withColumn("p_target", C("p_target")), "outer_train").join(
        items(spark, sf).select("sample_id", "p_draw", "omega"), "sample_id")


@B.stored
def coarse_cands(spark, sf):
    return ST.draw_candidates(coarse_items(spark, sf), "outer_train").join(coarse_items(spark, sf).select("sample_id", "p_draw", "omega"), "sample_id")


@B.stored
def coarse_draws(spark, sf):
    c = coarse_cands(spark, sf)
    return SA.draw_from_cdf(c, max(1, c.count()), SEED, PURPOSE)


@B.stored
def draws(spark, sf):
    """One epoch with replacement: as many draws as candidates, none where there are none."""
    c = cands(spark, sf)
    return SA.draw_from_cdf(c, c.count(), SEED, PURPOSE)


@B.stored
def augmented(spark, sf):
    return SA.materialize_signatures(draws(spark, sf), B.POLICY, B.NULL_SIG, SEED, SIG_PURPOSE)


def cdf_sql(minutes=MIN):
    return f"""{items_sql(minutes=minutes)}, cand as (select * from items where split = 'outer_train'),
cdf0 as (select *, row_number() over o as rn, count(*) over () as n, sum(p_draw) over (order by t0_utc, lead_hours, condition_signature rows unbounded preceding) as hi0 from cand
  window o as (order by t0_utc, lead_hours, condition_signature)),
cdf as (select *, coalesce(lag(hi0) over (order by rn), 0) as lo, case when rn = n then 1.0 else hi0 end as hi from cdf0)"""


def draws_sql(minutes=MIN):
    return f"""{cdf_sql(minutes)}, us as (select i as global_example_index, {uniform_sql(SEED, PURPOSE, 'i')} as u from
  (select unnest(range((select count(*) from cand))) as i)),
draws as (select us.global_example_index, cdf.* exclude (lo, hi, hi0, rn, n) from us join cdf on lo <= u and u < hi)"""


SID = ("substr(sha256(strftime(t0_utc, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.1f', lead_hours) || '|' || {0}), 1, 24)")


def aug_sql(minutes=MIN):
    return f"""{draws_sql(minutes)}, {B.POLICY_SQL},
pick as (select draws.*, {uniform_sql(SEED, SIG_PURPOSE, 'global_example_index')} as u2 from draws),
sel as (select pick.* exclude (u2), case when condition_signature = '{B.NULL_SIG}' then 2 when u2 < 0.25 then 0 when u2 < 0.75 then 1 else 2 end as ord from pick),
aug as (select s.global_example_index, s.t0_utc, s.lead_hours, p.sig as condition_signature, s.block_id, s.stratum, s.split, s.fold_id,
  s.p_target * case when s.condition_signature = '{B.NULL_SIG}' then 1 else p.pt end as p_target,
  s.p_draw * case when s.condition_signature = '{B.NULL_SIG}' then 1 else p.pd end as p_draw, s.omega,
  {SID.format('p.sig').replace('t0_utc', 's.t0_utc').replace('lead_hours', 's.lead_hours')} as sample_id from sel s join policy p on p.ord = s.ord)"""


CDF_SQL, DRAWS_SQL, AUG_SQL = cdf_sql(), draws_sql(), aug_sql()
COARSE_DRAWS_SQL = draws_sql(COARSE)
SHOW = "global_example_index, sample_id, condition_signature, block_id, round(p_target * 1e3, 6) as pt, round(p_draw * 1e3, 6) as pd, round(omega, 6) as om"


def show(df):
    return df.select("global_example_index", "sample_id", "condition_signature", "block_id", F.round(C("p_target") * 1e3, 6).alias("pt"),
                     F.round(C("p_draw") * 1e3, 6).alias("pd"), B.r6(C("omega")).alias("om"))


@query("wn07_prefix_cdf", w(CDF_SQL, "select sample_id, round(lo, 9) as cdf_lo, round(hi, 9) as cdf_hi from cdf", True))
def wn07(spark, sf):
    return SA.prefix_cdf(cands(spark, sf)).select("sample_id", F.round("cdf_lo", 9).alias("cdf_lo"), F.round("cdf_hi", 9).alias("cdf_hi"))


@query("jn16_draw_from_cdf", w(DRAWS_SQL, f"select {SHOW} from draws", True))
def jn16(spark, sf):
    return show(draws(spark, sf))


@query("so01_hash_shuffle", w(items_sql(), """select sample_id, row_number() over (order by sha256('11103' || chr(0) || 'epoch' || chr(0) || sample_id), sample_id) - 1 as global_example_index,
 round(1e3 / (count(*) over ()), 6) as pd, 1.0::double as omega from items where split = 'outer_train'""", True))
def so01(spark, sf):
    c = cands(spark, sf)
    return SA.hash_shuffle(c, SEED, "epoch").select("sample_id", "global_example_index", F.round(C("p_draw") * 1e3, 6).alias("pd"), "omega")


@query("so01_hash_shuffle_customers", """select c_custkey::varchar as sample_id,
 row_number() over (order by sha256('3' || chr(0) || 'epoch' || chr(0) || c_custkey::varchar), c_custkey::varchar) - 1 as global_example_index from customer""")
def so01b(spark, sf):
    c = B.table(spark, sf, "customer").select(C("c_custkey").cast("string").alias("sample_id"))
    return SA.hash_shuffle(c, 3, "epoch").select("sample_id", "global_example_index")


@query("so02_prefix", w(DRAWS_SQL, f"select {SHOW} from draws where global_example_index < 1000", True))
def so02(spark, sf):
    return show(SA.prefix(draws(spark, sf), 1000))


@query("so03_shard_plan", w(DRAWS_SQL, """, n as (select count(*) as n, ((count(*) + 47) // 48) * 48 as padded from draws),
f as (select i as position, case when i < n then i end as row_index, padded from n, (select unnest(range((select padded from n))) as i))
select e::int as epoch, position // 48 as step, (position % 48) // 24 as accumulation, ((position % 48) % 24) // 6 as rank, position % 6 as slot,
 position + e * padded as logical_position, row_index from f, (select unnest([0, 1]) as e)""", True))
def so03(spark, sf):
    return SA.shard_plan(draws(spark, sf), 4, 6, 2, 2)


@query("so04_rank_shard", w(DRAWS_SQL, f"select {SHOW} from draws where global_example_index % 4 = 1", True))
def so04(spark, sf):
    return show(SA.rank_shard(draws(spark, sf), 1, 4))


@query("jn17_expand_support", w(items_sql(), f""", {B.POLICY_SQL}, ex as (
 select items.*, p.sig, p.pt as ft, p.pd as fd from items join policy p on split = 'outer_train' and condition_signature <> '{B.NULL_SIG}'
 union all select items.*, condition_signature, 1, 1 from items where split <> 'outer_train' or condition_signature = '{B.NULL_SIG}')
select {SID.format('sig')} as sample_id, sig as condition_signature, split, round(p_target * ft * 1e3, 6) as pt, round(p_draw * fd * 1e3, 6) as pd from ex""", True))
def jn17(spark, sf):
    return SA.expand_support(items(spark, sf), B.POLICY, B.NULL_SIG).select(
        "sample_id", "condition_signature", "split", F.round(C("p_target") * 1e3, 6).alias("pt"), F.round(C("p_draw") * 1e3, 6).alias("pd"))


@query("se02_combine_support", w(items_sql(), """select split, count(*) as n, round(sum(p_target), 6) as s from items group by split""", True))
def se02(spark, sf):
    it = items(spark, sf)
    both = ST.combine_support(it.filter("split = 'outer_train'"), it.filter("split <> 'outer_train'"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), B.r6(F.sum("p_target")).alias("s"))


@query("jn18_materialize_signatures", w(AUG_SQL, f"select {SHOW} from aug", True))
def jn18(spark, sf):
    return show(augmented(spark, sf))


@query("jn19_audit_draw_membership", w(DRAWS_SQL, """, bad as (select global_example_index, case when lead_hours = 1.5 then 'weights' when lead_hours = 1.0 then 'metadata'
 when lead_hours = 0.5 then 'not_a_candidate' end as rule, sample_id from draws) select rule, sample_id, count(*) as draws from bad group by all""", True))
def jn19(spark, sf):
    lead = C("lead_hours")
    bad = (draws(spark, sf).withColumn("omega", F.when(lead == 1.5, C("omega") + 1e-6).otherwise(C("omega")))
           .withColumn("stratum", F.when(lead == 1.0, F.lit("dry")).otherwise(C("stratum")))
           .withColumn("sample_id", F.when(lead == 0.5, F.concat(F.lit("x"), "sample_id")).otherwise(C("sample_id"))))
    clean = SA.audit_draw_membership(draws(spark, sf), cands(spark, sf))
    out = SA.audit_draw_membership(bad, cands(spark, sf)).unionByName(clean)
    return out.withColumn("sample_id", F.when(C("rule") == "not_a_candidate", F.expr("substring(sample_id, 2)")).otherwise(C("sample_id")))


@query("jn24_reconcile_fold", w(DRAWS_SQL, """select global_example_index, fold_id, false as conflict from draws""", True))
def jn24(spark, sf):
    lead = C("lead_hours")
    d = draws(spark, sf).withColumn("fold_id", F.when(lead == 0.5, C("fold_id")))
    it = items(spark, sf).filter("split = 'outer_train'")
    a = it.filter(lead == 1.0)
    return SA.reconcile_fold(d, a, it).select("global_example_index", "fold_id", "conflict")


@query("jn28_validate_provenance", w(AUG_SQL, """, b as (select * from aug where lead_hours = 1.0)
 select side, count(*) as n from (select 'missing' as side from b union all select 'unexpected' from b) group by side""", True))
def jn28(spark, sf):
    tampered = augmented(spark, sf).withColumn("p_draw", F.when(C("lead_hours") == 1.0, C("p_draw") * 2).otherwise(C("p_draw")))
    return SA.validate_provenance(draws(spark, sf), tampered, B.POLICY, B.NULL_SIG, SEED, SIG_PURPOSE).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"))


@query("jn29_fold_checkpoint_lineage", w(items_sql(), "select sample_id, fold_id, 0::bigint as n from items where split = 'outer_train' and fold_id = 2", True))
def jn29(spark, sf):
    it = items(spark, sf).filter("split = 'outer_train'")
    cp = it.select("fold_id").distinct().filter("fold_id <> 2").withColumn("checkpoint", F.concat(F.lit("ckpt-"), "fold_id"))
    return SA.fold_lineage(it, cp)


@query("ag20_draw_multiplicity", w(DRAWS_SQL, """select t0_utc, lead_hours, condition_signature, count(*) as multiplicity,
 min(global_example_index) as first_index, true as stable from draws group by all""", True))
def ag20(spark, sf):
    return SA.draw_multiplicity(draws(spark, sf))


@query("ag21_dense_budget", w(DRAWS_SQL, """select count(*) as unique_items, count(*) * 524288 as dense_bytes from
 (select distinct t0_utc, lead_hours, condition_signature from draws)""", True))
def ag21(spark, sf):
    return SA.dense_budget(draws(spark, sf), 256, 256)


@query("ag22_weight_report", w(DRAWS_SQL, """select round(min(omega), 6) as "min", round(max(omega), 6) as "max", round(quantile_cont(omega, 0.5), 6) as median,
 round(quantile_cont(omega, 0.95), 6) as p95, round(sum(omega) ** 2 / sum(omega * omega), 4) as ess from draws""", True))
def ag22(spark, sf):
    r = SA.weight_report(draws(spark, sf))
    return r.select(*[B.r6(C(c)).alias(c) for c in ("min", "max", "median", "p95")], F.round("ess", 4).alias("ess"))


@query("ag23_signature_report", w(AUG_SQL, """select condition_signature, count(*) as draws, count(distinct sample_id) as unique_items, 0::bigint as conflicts
 from aug group by 1""", True))
def ag23(spark, sf):
    return SA.signature_report(augmented(spark, sf))


@query("wn10_dense_reindex", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as idx from lineitem""")
def wn10(spark, sf):
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return O.dense_index(B.table(spark, sf, "lineitem").select(*keys), keys)


@query("wn11_batch_by_issue", w(DRAWS_SQL, """, g as (select *, min(global_example_index) over (partition by t0_utc, condition_signature) as f,
  row_number() over (partition by t0_utc, condition_signature order by lead_hours, global_example_index) - 1 as rn from draws),
 c as (select f, ceil(count(*) / 2.0)::bigint as nb from g group by f), o as (select f, coalesce(sum(nb) over (order by f rows between unbounded preceding and 1 preceding), 0)::bigint as boff from c)
 select global_example_index, t0_utc, condition_signature, lead_hours, boff + rn // 2 as batch, rn % 2 as place from g join o using (f)""", True))
def wn11(spark, sf):
    return SA.batch_by_issue(draws(spark, sf), 2)


@query("pr38_subset_year", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, source_index, row_number() over (order by source_index) - 1 as global_example_index from (
 select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as source_index from lineitem) where year(l_shipdate) = 1998""")
def pr38(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    d = O.dense_index(B.table(spark, sf, "lineitem").select(*keys, C("l_shipdate").alias("t0_utc")), keys, "global_example_index")
    return SA.subset_year(d, 1998).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "source_index", "global_example_index")


BUNDLE_SPLIT = "outer_train"


def bundle(spark, sf, name: str):
    """The published bundle; None where the training split has no item, which the operator refuses."""
    n = items(spark, sf).filter(C("split") == BUNDLE_SPLIT).count()
    if not n:
        return None
    return BU.build_training_bundle(index(spark, sf), items(spark, sf), scratch(spark, name) + "/t", BUNDLE_SPLIT, SEED, PURPOSE, n, (256, 256), 1 << 50)


@query("it07_training_bundle_rows", w(DRAWS_SQL, f"select {SHOW} from draws", True))
def it07_rows(spark, sf):
    """Audit, draw, budget and publication in one call; the rows come back from the published files."""
    made = bundle(spark, sf, "bundle07")
    return show(made["draws"] if made else draws(spark, sf))


@query("it07_bundle_budget", w(DRAWS_SQL, "select count(*) as unique_items, count(*) * 524288 as dense_bytes from (select distinct t0_utc, lead_hours, condition_signature from draws)", True))
def it07_budget(spark, sf):
    made = bundle(spark, sf, "bundle07b")
    return made["budget"] if made else SA.dense_budget(draws(spark, sf), 256, 256)


@query("it08_augmented_bundle_rows", w(AUG_SQL, f"select {SHOW} from aug", True))
def it08_rows(spark, sf):
    """One policy signature a draw, published and read back."""
    base = bundle(spark, sf, "bundle08")
    if not base:
        return show(augmented(spark, sf))
    hold = items(spark, sf).filter(F.coalesce(C("split") != BUNDLE_SPLIT, F.lit(True)))
    made = BU.augment_bundle(base, hold, scratch(spark, "augmented08") + "/t", B.POLICY, B.SOURCE_SIG, B.TP_OFF_SIG, B.NULL_SIG, SEED, SIG_PURPOSE)
    return show(made["draws"])


@query("it07_build_training_bundle", w(AUG_SQL, """select 'index' as tbl, count(*) as n, 0.0::double as mass from idx union all
 select 'candidates', count(*), round(sum(p_target), 6) from items union all select 'draws', count(*), round(sum(omega), 3) from draws union all
 select 'augmented', count(*), round(sum(omega), 3) from aug""", True))
def it07(spark, sf):
    one = F.count(F.lit(1)).alias("n")
    return MF.union_all([
        index(spark, sf).agg(one, F.lit(0.0).alias("mass")).withColumn("tbl", F.lit("index")),
        items(spark, sf).agg(one, B.r6(F.sum("p_target")).alias("mass")).withColumn("tbl", F.lit("candidates")),
        draws(spark, sf).agg(one, F.round(F.sum("omega"), 3).alias("mass")).withColumn("tbl", F.lit("draws")),
        augmented(spark, sf).agg(one, F.round(F.sum("omega"), 3).alias("mass")).withColumn("tbl", F.lit("augmented"))])


@query("it08_augment_bundle", w(AUG_SQL.replace("items as (", "items as materialized ("), f""", sh as (select *, row_number() over (order by sha256('11103' || chr(0) || 'epoch2' || chr(0) || sample_id), sample_id) - 1 as gi from cand),
 pk as (select *, {uniform_sql(SEED, 'signature2', 'gi')} as u2 from sh),
 sl as (select *, case when condition_signature = '{B.NULL_SIG}' then 2 when u2 < 0.25 then 0 when u2 < 0.75 then 1 else 2 end as ord from pk)
 select sig as condition_signature, split, block_id, count(*) as n from sl join policy using (ord) group by all""", True))
def it08(spark, sf):
    shuffled = SA.hash_shuffle(cands(spark, sf), SEED, "epoch2")
    return SA.materialize_signatures(shuffled, B.POLICY, B.NULL_SIG, SEED, "signature2").groupBy(
        "condition_signature", "split", "block_id").agg(F.count(F.lit(1)).alias("n"))


@query("va02_damaged_manifest", w(DRAWS_SQL, """ select 'omega' as rule, count(*) as n from draws where lead_hours <= 1.5 union all
 select 'probability', count(*) from draws where lead_hours = 1.5 union all select 'empty', 1""", True))
def va02_damaged(spark, sf):
    """Null and NaN weights, an infinite probability, and an empty manifest are all named; the rules are listed even where there are no draws."""
    lead, d = C("lead_hours"), draws(spark, sf)
    bad = (d.withColumn("omega", F.when(lead == 0.5, F.lit(None)).when(lead == 1.0, F.lit(float("nan"))).otherwise(C("omega")))
           .withColumn("p_draw", F.when(lead == 1.5, F.lit(float("inf"))).otherwise(C("p_draw"))))
    found = SA.draw_violations(bad).unionByName(SA.draw_violations(d.limit(0))).groupBy("rule").agg(F.count_distinct("key").alias("n"))
    rules = spark.createDataFrame([("omega",), ("probability",), ("empty",)], "rule string")
    return found.join(rules, "rule", "full").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@query("va02_candidate_draw_contracts", w(COARSE_DRAWS_SQL, """, v as (select 'omega' as rule, count(*) as n from draws where lead_hours = 1.5 union all
 select 'duplicate_sample_id', count(*) from cand union all select 'draw_sum', 1) select rule, n from v where n > 0""", True))
def va02(spark, sf):
    c = coarse_cands(spark, sf)
    bad_draws = coarse_draws(spark, sf).withColumn("omega", F.when(C("lead_hours") == 1.5, C("omega") * 1.01).otherwise(C("omega")))
    doubled = c.unionByName(c.withColumn("lead_hours", C("lead_hours") + 6)).withColumn("p_target", C("p_target") / 2)
    return (SA.draw_violations(bad_draws).unionByName(SA.candidate_violations(doubled))
            .unionByName(SA.draw_violations(coarse_draws(spark, sf))).unionByName(SA.candidate_violations(c))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
