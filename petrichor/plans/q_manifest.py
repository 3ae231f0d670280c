"""Splits, event index, candidate items, folds and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import manifest as MF
from ..operators import sets as ST
from ..operators import slots as S
from ..operators.splits import assign_split, resolve_event_split
from . import bindings as B
from .q_slots import merge_sql
from .registry import query

C = F.col
MIN, HIST, HOR, GAP, GUARD, LEADS = 15, 3, 6, 3, 1, 3
#: Slots of three hours have whole windows however few events there are.
COARSE = 180
MASK = (1 << LEADS) - 1


@B.stored
def nominal(spark, sf):
    return MF.nominal_index(B.whole_slots(spark, sf, MIN), B.SPLITS, MIN, HIST, HOR, GAP, GUARD)


def signatures(spark, sf, minutes: int = MIN):
    """Condition per issue slot: without a source where the strongest event is a view."""
    top = F.max_by("event_type", F.struct("value", "event_id"))
    return (B.table(spark, sf, "events").groupBy(T.slot_index("ts", minutes).alias("slot")).agg(top.alias("_p"))
            .select("slot", F.when(C("_p") != "view", B.SOURCE_SIG).otherwise(B.NULL_SIG).alias("condition_signature")))


def indexed(spark, sf, kept, minutes: int):
    return (MF.event_index(kept).join(signatures(spark, sf, minutes), "slot")
            .withColumn("available_leads_mask", F.lit(MASK)).withColumn("stratum", F.lit("event")))


@B.stored
def index(spark, sf):
    return indexed(spark, sf, nominal(spark, sf), MIN)


@B.stored
def items(spark, sf):
    return MF.attach_folds(MF.expand_items(MF.split_probabilities(index(spark, sf))))


@B.stored
def coarse_index(spark, sf):
    """The event index of three-hour slots: training items at every scale."""
    return indexed(spark, sf, MF.nominal_index(B.whole_slots(spark, sf, COARSE), B.SPLITS, COARSE, HIST, HOR, GAP, GUARD), COARSE)


@B.stored
def coarse_items(spark, sf):
    return MF.attach_folds(MF.expand_items(MF.split_probabilities(coarse_index(spark, sf))))


IDENT = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

def nominal_sql(minutes=MIN):
    k = minutes // MF.TICK
    return f"""{B.whole_slots_sql(minutes)}, {B.SPLITS_SQL},
runs as (select min(slot) as run_start, max(slot) as run_end, count(*) as run_len
         from (select slot, slot - row_number() over (order by slot) as g from slots) group by g),
seeds as (select 'all' as source, run_start * {k} as s, run_end * {k} as e from runs), {merge_sql('seeds', GAP, 'm1')},
wide as (select source, s - {GUARD} as s, e + {GUARD} as e, n_seeds from m1), {merge_sql('wide', 0, 'm2', 'sum(n_seeds)')},
blocks as (select s, e, 'event-' || substr(sha256({IDENT.format(B.slot_ts_sql('s', 5))} || '|' ||
   {IDENT.format(B.slot_ts_sql('e', 5))}), 1, 16) as block_id from m2),
iss as (select unnest(range(run_start + {HIST - 1}, run_end - {HOR} + 1)) as slot from runs where run_len >= {HIST + HOR}),
dep as (select slot, {B.slot_ts_sql('slot', minutes)} as t0_utc, {B.slot_ts_sql(f'slot - {HIST - 1}', minutes)} as dependency_start_utc,
   {B.slot_ts_sql(f'slot + {HOR}', minutes)} as dependency_end_utc from iss),
nom as (select dep.*, blocks.block_id, sp.name as nominal, sp.rank from dep
  left join blocks on blocks.s <= (slot - {HIST - 1}) * {k} and (slot + {HOR}) * {k} <= blocks.e
  left join splits sp on dependency_start_utc >= sp.s and dependency_end_utc < sp.e),
best as (select block_id, arg_min(nominal, rank) as split from nom where nominal is not null group by block_id),
nominal as (select nom.*, best.split, case when nominal is null then 'embargoed' when nominal <> best.split then 'cross_split'
  else 'kept' end as status from nom left join best using (block_id))"""


def index_sql(minutes=MIN):
    sigs = f"""sigs as (select epoch_us(ts) // {minutes * 60_000_000} as slot, case when arg_max(event_type, (value, event_id)) <> 'view'
 then '{B.SOURCE_SIG}' else '{B.NULL_SIG}' end as condition_signature from events group by 1)"""
    return f"""{nominal_sql(minutes)}, {sigs}, idx as (select nominal.slot, t0_utc, dependency_start_utc, dependency_end_utc, block_id, split,
 condition_signature, {MASK} as available_leads_mask, 'event' as stratum from nominal join sigs using (slot) where status = 'kept')"""


NOMINAL_SQL, INDEX_SQL = nominal_sql(), index_sql()
SID_SQL = ("substr(sha256(" + IDENT.format("t0_utc") + " || '|' || printf('%.1f', lead_hours) || '|' || condition_signature), 1, 24)")


def items_sql(policy="block_balanced", minutes=MIN):
    draw = "1.0::double / (ps.nblocks * pb.nb)" if policy == "block_balanced" else "1.0::double / ps.ns"
    return f"""{index_sql(minutes)},
pb as (select split, block_id, count(*) * {LEADS} as nb from idx group by all),
ps as (select split, sum(nb)::bigint as ns, count(*) as nblocks from pb group by all),
fb as (select block_id, nb as size, row_number() over (order by nb desc, sha256('11103' || chr(0) || block_id)) as rn
  from pb where split = 'outer_train'),
{folds_sql('fb')},
it as (select idx.*, lead_hours, 1.0::double / ps.ns as p_target, {draw} as p_draw, fold_id
 from idx join pb using (split, block_id) join ps using (split) left join fl using (block_id),
 (select unnest([0.5, 1.0, 1.5])::double as lead_hours)),
items as (select *, p_target / p_draw as omega, {SID_SQL} as sample_id from it)"""


def folds_sql(src):
    pick = "case when a <= b and a <= c then 0 when b <= c then 1 else 2 end"
    return f"""rf as (select 0::bigint as rn, 0::bigint as a, 0::bigint as b, 0::bigint as c, -1 as fold_id, null::varchar as block_id
 union all select n.rn, a + case when f = 0 then n.size else 0 end, b + case when f = 1 then n.size else 0 end,
  c + case when f = 2 then n.size else 0 end, f, n.block_id::varchar from (
   select rf.*, {pick} as f from rf) r join {src} n on n.rn = r.rn + 1),
fl as (select block_id, fold_id from rf where rn > 0)"""


def w(body, select, recursive=False):
    return f"with {'recursive ' if recursive else ''}{body} {select}"


@query("jn03_assign_split", w(f"{B.all_slots_sql(MIN)}, {B.SPLITS_SQL}, d as (select slot, {B.slot_ts_sql('slot - 3', MIN)} as a, "
       f"{B.slot_ts_sql('slot + 24', MIN)} as b from slots)", "select slot, name as split from d left join splits on a >= s and b < e"))
def jn03(spark, sf):
    s = C("slot")
    return B.all_slots(spark, sf, MIN).select("slot", assign_split(
        T.slot_time(s - 3, MIN), T.slot_time(s + 24, MIN), B.SPLITS).alias("split"))


@query("jn04_resolve_event_split", w(f"{B.slots_sql(60)}, {B.SPLITS_SQL}, r as (select source || ':' || (slot // 100)::varchar as block_id, slot, name as split, rank "
       f"from slots join splits on {B.slot_ts_sql('slot', 60)} >= s and {B.slot_ts_sql('slot', 60)} < e), "
       "b as (select block_id, arg_min(split, rank) as best from r group by 1)",
       "select r.block_id, slot, split, split = best as kept from r join b using (block_id)"))
def jn04(spark, sf):
    t = T.slot_time("slot", 60)
    rows = B.slots(spark, sf, 60).select(
        F.concat_ws(":", "source", F.floor(C("slot") / 100).cast("string")).alias("block_id"), "slot",
        assign_split(t, t, B.SPLITS).alias("split"))
    kept, dropped = resolve_event_split(rows.filter("split is not null"))
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query("it06_build_event_index", w(INDEX_SQL, "select t0_utc, block_id, split, condition_signature, available_leads_mask from idx"))
def it06(spark, sf):
    return index(spark, sf).select("t0_utc", "block_id", "split", "condition_signature", "available_leads_mask")


@query("ag06_event_index_audit", w(NOMINAL_SQL, f"""select count(*) as eligible, count(*) filter (status = 'kept') as issue_times,
 count(*) filter (status = 'kept') * {LEADS} as expanded_items, count(distinct block_id) filter (status = 'kept') as event_blocks,
 count(*) filter (status = 'embargoed') as embargoed, count(*) filter (status = 'cross_split') as cross_split,
 coalesce(round(count(*) filter (status = 'embargoed') / nullif(count(*), 0), 6), 0) as embargo_fraction,
 coalesce(round(count(*) filter (status <> 'kept') / nullif(count(*), 0), 6), 0) as excluded_fraction from nominal"""))
def ag06(spark, sf):
    a = MF.index_audit(nominal(spark, sf), LEADS)
    return a.withColumn("embargo_fraction", B.r6(C("embargo_fraction"))).withColumn("excluded_fraction", B.r6(C("excluded_fraction")))


@query("ag06_split_audit", w(INDEX_SQL, """select split, count(*) as issue_times, count(distinct block_id) as blocks,
 count(distinct block_id) < 20 as low_support from idx group by split"""))
def ag06b(spark, sf):
    return MF.split_audit(index(spark, sf))


def _ag08(policy):
    def run(spark, sf):
        d = MF.split_probabilities(index(spark, sf), policy)
        return d.select("t0_utc", "split", "block_id", F.round(C("p_target") * 1e3, 6).alias("p_target_e3"),
                        F.round(C("p_draw") * 1e3, 6).alias("p_draw_e3"), B.r6(C("omega")).alias("omega"))
    return run


for _p in ("uniform", "block_balanced"):
    query(f"ag08_split_probabilities_{_p}", w(items_sql(_p), """select distinct t0_utc, split, block_id, round(p_target * 1e3, 6) as p_target_e3,
 round(p_draw * 1e3, 6) as p_draw_e3, round(omega, 6) as omega from items""", True))(_ag08(_p))


@query("it02_grouped_folds", w(items_sql(), "select block_id, size::bigint as size, fold_id from fl join fb using (block_id)", True))
def it02(spark, sf):
    train = (MF.expand_items(index(spark, sf)).filter("split = 'outer_train'").groupBy("block_id")
             .agg(F.count(F.lit(1)).alias("size")))
    return MF.grouped_folds(train)


@query("it02_grouped_folds_customers", "with recursive fb as (select o_custkey::varchar as block_id, count(*) as size, "
       "row_number() over (order by count(*) desc, sha256('5' || chr(0) || o_custkey::varchar)) as rn from orders group by o_custkey), "
       f"{folds_sql('fb')} select block_id, size::bigint as size, fold_id from fl join fb using (block_id)")
def it02b(spark, sf):
    blocks = B.table(spark, sf, "orders").groupBy(C("o_custkey").cast("string").alias("block_id")).agg(F.count(F.lit(1)).alias("size"))
    return MF.grouped_folds(blocks, 3, 5)


@query("ag07_audit_manifest_clean", w(items_sql(), "select split, stratum, count(*) as items, count(distinct block_id) as blocks, "
       "0::bigint as violations from items group by all", True))
def ag07(spark, sf):
    it = items(spark, sf)
    bad = MF.audit_manifest(it, B.SPLITS, MIN, HIST, HOR, 3).agg(F.count(F.lit(1)).alias("violations"))
    return MF.manifest_summary(it).join(F.broadcast(bad))  # one row


# a damaged copy: the draw weight of slots with a large event is doubled, folds of some leads are moved
def damaged(spark, sf):
    it = items(spark, sf)
    lead = C("lead_hours")
    return (it.withColumn("omega", F.when(lead == 1.5, C("omega") * 2).otherwise(C("omega")))
            .withColumn("sample_id", F.when(lead == 1.0, F.reverse("sample_id")).otherwise(C("sample_id")))
            .withColumn("fold_id", F.when((lead == 0.5) & (C("split") == "outer_train"), F.pmod(C("fold_id") + 1, F.lit(3)))
                        .otherwise(C("fold_id"))))


@query("ag07_audit_manifest_damaged", w(items_sql(), """, v as (
 select 'importance_weight' as rule, count(*) as n from items where lead_hours = 1.5 union all
 select 'sample_id', count(*) from items where lead_hours = 1.0 and reverse(sample_id) <> sample_id union all
 select 'block_crosses_folds', count(distinct block_id) from items where split = 'outer_train')
 select rule, n from v where n > 0""", True))
def ag07b(spark, sf):
    return MF.audit_manifest(damaged(spark, sf), B.SPLITS, MIN, HIST, HOR, 3).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("ag26_fold_partitions", w(items_sql(), """, f as (select fold_id, count(*) as held_out, count(distinct block_id) as blocks
 from items where split = 'outer_train' group by fold_id)
 select fold_id, held_out, (sum(held_out) over ())::bigint - held_out as trained_on, blocks, 0::bigint as shared_blocks from f""", True))
def ag26(spark, sf):
    return MF.fold_partitions(items(spark, sf))


@query("ag29_bundle_scan", w(items_sql(), """select split, stratum, count(*) as items, count(distinct block_id) as blocks,
 round(sum(p_target), 9) as sum_target, round(sum(p_draw), 9) as sum_draw from items group by all""", True))
def ag29(spark, sf):
    return items(spark, sf).groupBy("split", "stratum").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("block_id").alias("blocks"),
        F.round(F.sum("p_target"), 9).alias("sum_target"), F.round(F.sum("p_draw"), 9).alias("sum_draw"))


@query("se01_key_intersection", f"""with {B.slots_sql(15)} select slot from slots where source = 'view'
 intersect select slot from slots where source = 'click'""")
def se01a(spark, sf):
    s = B.slots(spark, sf, 15)
    return ST.key_intersection(s.filter("source = 'view'").select("slot"), s.filter("source = 'click'").select("slot"))


@query("se01_key_difference", f"""with {B.slots_sql(15)} select slot from slots where source = 'view'
 except select slot from slots where source = 'click'""")
def se01b(spark, sf):
    s = B.slots(spark, sf, 15)
    return ST.key_difference(s.filter("source = 'view'").select("slot"), s.filter("source = 'click'").select("slot"))


@query("se01_key_union", f"""with {B.slots_sql(15)} select slot from slots where source = 'view'
 union select slot from slots where source = 'click'""")
def se01c(spark, sf):
    s = B.slots(spark, sf, 15)
    return ST.key_union(s.filter("source = 'view'").select("slot"), s.filter("source = 'click'").select("slot"))


CAND_COLS = ["sample_id", "t0_utc", "lead_hours", "condition_signature", "block_id", "stratum", "split", "fold_id"]


@query("se03_draw_candidates", w(items_sql(), f"select {', '.join(CAND_COLS)}, round(p_target * 1e3, 6) as p_target_e3 "
       "from items where split = 'outer_train'", True))
def se03(spark, sf):
    c = ST.draw_candidates(items(spark, sf), "outer_train")
    return c.withColumn("p_target_e3", F.round(C("p_target") * 1e3, 6)).drop("p_target")


@query("se04_eligible_ids", w(items_sql(), "select distinct sample_id from items", True))
def se04(spark, sf):
    return ST.eligible_ids(index(spark, sf))


@query("jn20_coverage_gap", f"""with {B.slots_sql(15)}, a as (select distinct slot from slots where source in ('view', 'click', 'purchase', 'signup')),
b as (select slot from slots where source = 'error'),
m as (select slot, 'missing' as side from b where slot not in (select slot from a) union all
 select slot, 'unexpected' from a where slot not in (select slot from b))
select side, count(*) as n, round(count(*) / (select count(*) from b), 6) as fraction from m group by side""")
def jn20(spark, sf):
    s = B.slots(spark, sf, 15)
    return ST.coverage_report(s.filter("source = 'error'").select("slot"),
                              s.filter("source <> 'error'").select("slot").distinct(), ["slot"]).withColumn(
        "fraction", B.r6(C("fraction")))


@query("wn12_canonical_order_check", """with o as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
 row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem),
p as (select *, lag(l_orderkey) over (order by pos) as a, lag(l_shipdate) over (order by pos) as b from o)
select pos, l_orderkey, l_shipdate from p where a is not null and (l_orderkey, l_shipdate) <= (a, b)""")
def wn12(spark, sf):
    from ..operators.ordered import dense_index
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    d = dense_index(B.table(spark, sf, "lineitem").select(*keys, "l_shipdate"), keys, "pos")
    return S.order_violations(d, "pos", ["l_orderkey", "l_shipdate"], 4096)


@query("wn13_issue_consistency", f"""with {B.SPLITS_SQL}, r as (select date_trunc('day', ts) + (hour(ts) // 3)::int * interval 3 hour as t0_utc, event_type as block_id, name as split,
  event_type as condition_signature, (user_id % 4100)::int as mask from events join splits on ts >= s and ts < e)
select 'block_crosses_splits' as rule, count(*) as n from (select block_id from r group by 1 having count(distinct split) > 1) union all
select 'issue_assignment', count(*) from (select t0_utc from r group by 1 having count(distinct (block_id, split)) > 1) union all
select 'duplicate_identity', count(*) from (select 1 from r group by t0_utc, condition_signature having count(*) > 1) union all
select 'mask', count(*) from r where mask not between 1 and 4095""")
def wn13(spark, sf):
    e = B.table(spark, sf, "events")
    rows = e.select(T.slot_time(T.slot_index("ts", 180), 180).alias("t0_utc"), C("event_type").alias("block_id"),
                    assign_split(C("ts"), C("ts"), B.SPLITS).alias("split"), C("event_type").alias("condition_signature"),
                    (C("user_id") % 4100).cast("int").alias("available_leads_mask")).filter("split is not null")
    return MF.issue_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("so05_canonical_sort", w(items_sql(), "select t0_utc, lead_hours, condition_signature, "
       "row_number() over (order by t0_utc, lead_hours, condition_signature) - 1 as idx from items", True))
def so05(spark, sf):
    from ..operators.ordered import dense_index
    keys = ["t0_utc", "lead_hours", "condition_signature"]
    return dense_index(items(spark, sf).select(*keys), keys)
