"""Contracts as violation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as VA
from . import bindings as B
from .registry import query

C = F.col


@query("va01_split_contracts", """with s as (select case o_orderstatus when 'F' then 'outer_train' when 'O' then 'model_selection' else 'P' end as name, min(o_orderdate) as a, max(o_orderdate) - case when o_orderstatus = 'P' then interval 100000 day else interval 0 day end as b from orders group by o_orderstatus),
o as (select *, lead(a) over (order by a, b) as n from s)
select 'unknown_name' as rule, count(*) as n from s where name = 'P' union all select 'empty', count(*) from s where a >= b union all select 'overlap', count(*) from o where n < b""")
def va01(spark, sf):
    o = B.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    name = F.when(C("o_orderstatus") == "F", "outer_train").when(C("o_orderstatus") == "O", "model_selection").otherwise(C("o_orderstatus"))
    end = F.when(C("o_orderstatus") == "P", C("end") - F.expr("INTERVAL 100000 DAYS")).otherwise(C("end"))
    return VA.split_violations(o.select(name.alias("name"), "start", end.alias("end"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("va03_policy_contracts", f"""with p as (select case l_returnflag when 'A' then '{B.SOURCE_SIG}' when 'N' then 'gfs:era=1:tp=0:full_trajectory' else 'gfs:era=0:tp=1:full_trajectory' end as sig, count(*) / (select count(*) from lineitem) as t from lineitem group by 1)
select 'provider_switch' as rule, count(*) as n from p where sig like 'gfs%' union all select 'not_canonical', count(*) from p where sig like '%era=0%' union all select 'draw_sum', 1 union all select 'missing_entry', 2""")
def va03(spark, sf):
    li = B.table(spark, sf, "lineitem")
    sig = F.when(C("l_returnflag") == "A", B.SOURCE_SIG).when(C("l_returnflag") == "N", "gfs:era=1:tp=0:full_trajectory").otherwise("gfs:era=0:tp=1:full_trajectory")
    n = li.agg(F.count(F.lit(1)).alias("n"))
    p = li.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select(
        "signature", (C("k") / C("n")).alias("p_target"), (C("k") / C("n") / 2).alias("p_draw"))
    return VA.policy_violations(p, B.SOURCE_SIG, B.TP_OFF_SIG, B.NULL_SIG).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("va03_damaged_policy", f"""with p as (select case when l_returnflag = 'A' then '{B.SOURCE_SIG}' when l_returnflag = 'N' then '{B.NULL_SIG}' else 'era5_oracle:era=1:tp=1:target_end_causal' end as sig, count(*) as n from lineitem group by 1)
select 'probability' as rule, (select count(*) from p) * 2 as n union all select 'duplicate_signature', count(*) from p union all select 'tp_pair', 2 union all select 'access_strategy', 1
union all select 'target_sum', 1 union all select 'draw_sum', 1 union all select 'missing_entry', 1""")
def va03_damaged(spark, sf):
    """Every signature twice, once without a probability and once with one that is no number; no entry without tp; an access mode of another arm."""
    sig = F.when(C("l_returnflag") == "A", B.SOURCE_SIG).when(C("l_returnflag") == "N", B.NULL_SIG).otherwise("era5_oracle:era=1:tp=1:target_end_causal")
    p = B.table(spark, sf, "lineitem").groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).cast("double").alias("p_target"))
    none = p.select("signature", F.lit(None).cast("double").alias("p_target"), F.lit(0.5).alias("p_draw"))
    nan = p.select("signature", F.lit(0.5).alias("p_target"), F.lit(float("nan")).alias("p_draw"))
    return VA.policy_violations(none.unionByName(nan), B.SOURCE_SIG, B.TP_OFF_SIG, B.NULL_SIG).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("va04_value_contracts", """with e as (select event_id, value / 300 as v, case when event_type = 'signup' then -value when event_type = 'error' then value * 10 else value end as r, event_type <> 'view' as valid, event_type as t from events)
select case when v > 1 then 'normalized_range' end as rule, event_id::varchar as key, '' as detail from e where v > 1 union all select 'negative_rate', event_id::varchar, '' from e where r < 0 union all
select 'rate_above_maximum', event_id::varchar, '' from e where r > 1000 * (1 + 1e-6)""")
def va04(spark, sf):
    t = C("event_type")
    e = B.table(spark, sf, "events").select("event_id", (C("value") / 300).alias("v"), F.when(t == "signup", -C("value")).when(t == "error", C("value") * 10).otherwise(C("value")).alias("r"),
                                            (t != "view").alias("valid"))
    return VA.value_violations(e, "event_id", "v", "r")


@query("pr29_condition_columns", "select c_custkey, c_nationkey, c_acctbal from customer")
def pr29(spark, sf):
    return VA.condition_columns(B.table(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"])
