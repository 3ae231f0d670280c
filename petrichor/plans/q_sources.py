"""Sources, sinks, fingerprints, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as SQLF
from ..functions import time as T
from ..operators import stats as SS
from ..sources import frames as FR
from ..sources import publish as PB
from ..streaming.streams import scratch
from . import bindings as B
from .bindings import r6
from .q_manifest import INDEX_SQL, items_sql, w
from .q_manifest import index as event_index
from .q_manifest import items
from .q_sampling import DRAWS_SQL, draws
from .q_scalars import EMB_SQL, NV, SLOT_TS, members, uniform_sql
from .q_stats import CHAN_SQL, MOM, chan, moments_out
from .registry import query

C = F.col


@query("sc01_scan_frames", """with f as (select event_type as source, epoch_us(ts) // 900000000 as slot, sum(value) as v from events group by all), k as (select 'view' as source, slot from f where source = 'error')
select k.slot, round(f.v, 6) as v, f.v is null as missing from k left join f on f.source = k.source and f.slot = k.slot""")
def sc01(spark, sf):
    f = B.table(spark, sf, "events").groupBy(C("event_type").alias("source"), T.slot_index("ts", 15).alias("slot")).agg(F.sum("value").alias("v"))
    path = scratch(spark, "frames") + "/t"
    f.write.partitionBy("source").parquet(path)
    keys = f.filter("source = 'error'").select(F.lit("view").alias("source"), "slot")
    hit, miss = FR.scan_frames(spark, path, "slot bigint, v double, source string", keys)
    return hit.select("slot", r6(C("v")).alias("v"), F.lit(False).alias("missing")).unionByName(
        miss.select("slot", F.lit(None).cast("double").alias("v"), F.lit(True).alias("missing")))


H, WD = 10, 15


def payloads(spark, sf):
    """Raw payloads of a 10 x 15 grid per source and day: header, then little-endian codes (absent = no-data code)."""
    e = B.table(spark, sf, "events")
    cells = e.groupBy(C("event_type").alias("source"), F.to_date("ts").alias("d"), (C("user_id") % (H * WD)).alias("pos")).agg(
        F.call_function("div", F.round(F.max("value") * 100).cast("int"), F.lit(10)).cast("int").alias("raw"))
    code = F.hex(F.pmod(C("raw"), F.lit(65536)).cast("long"))
    padded = F.lpad(code, 4, "0")
    cells = cells.withColumn("le", F.concat(F.substring(padded, 3, 2), F.substring(padded, 1, 2)))
    # a payload holds the fixed 150 pixels
    m = cells.groupBy("source", "d").agg(F.map_from_entries(F.collect_list(F.struct("pos", "le"))).alias("m"))
    body = F.concat_ws("", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(H * WD - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("D08A"))))
    head = F.lit("00" * FR.HEADER_BYTES)
    short = F.when(F.dayofmonth("d") == 13, F.lit("00")).otherwise(F.lit(""))  # a broken file per source
    return m.select(F.concat_ws("/", "source", C("d").cast("string")).alias("path"), F.unhex(F.concat(head, body, short)).alias("content"))


RAW_SQL = f"""cells as (select event_type || '/' || ts::date::varchar as path, user_id % 150 as pos, (round(max(value) * 100)::int // 10)::int as raw, day(ts) as dd from events group by all),
gp as (select path, unnest(range(150)) as pos from (select distinct path from cells where dd <> 13)),
px as (select path, (pos // {WD})::int as y, (pos % {WD})::int as x, coalesce(raw, -30000) as raw from gp left join cells using (path, pos))
select path, y, x, raw, raw not in (-30000, -25000) as valid, null::varchar as problem from px union all select distinct path, null, null, null, null, 'length 1325' from cells where dd = 13"""


@query("sc02_ingest_raw_scans", f"with {RAW_SQL}")
def sc02(spark, sf):
    return FR.decode_raw(payloads(spark, sf), H, WD).withColumn("raw", C("raw").cast("int"))


def _header_only(batches):
    import pandas as pd
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["content"].map(len).astype("int64")})


@query("ud01_decode_with", "select distinct event_type || '/' || ts::date::varchar as path, case when day(ts) = 13 then 1325 else 1324 end::bigint as bytes from events")
def ud01(spark, sf):
    return FR.decode_with(payloads(spark, sf), _header_only, "path string, bytes long")


@query("sc03_pair_files", """with l as (select distinct l_suppkey || '-' || year(l_shipdate) as stem from lineitem where l_quantity <= 5), r as (select distinct l_suppkey || '-' || year(l_shipdate) as stem from lineitem where l_quantity >= 46)
select coalesce(l.stem, r.stem) as stem, l.stem || '_target.npz' as left_path, r.stem || '_condition.npz' as right_path, case when r.stem is null then 'unmatched_left' when l.stem is null then 'orphan_right' else 'paired' end as state from l full join r on l.stem = r.stem""")
def sc03(spark, sf):
    li = B.table(spark, sf, "lineitem").withColumn("stem", F.concat_ws("-", "l_suppkey", F.year("l_shipdate")))
    files = li.filter("l_quantity <= 5").select(F.concat("stem", F.lit("_target.npz")).alias("path")).unionByName(
        li.filter("l_quantity >= 46").select(F.concat("stem", F.lit("_condition.npz")).alias("path"))).distinct()
    return FR.pair_files(files, "_target.npz", "_condition.npz")


@query("sc04_audit_file_keys", """with k as (select event_type as file, event_id, user_id // 100 as shape, epoch_us(ts) // 60000000 as key, row_number() over (partition by event_type order by event_id) - 1 as ordinal from events),
o as (select *, lag(key) over (partition by file order by ordinal) as p from k)
select n_nationkey::varchar || ':' || e.file as file, keys, repeated, shapes, order_breaks, false as empty from (select file, count(*) as keys, count(*) - count(distinct key) as repeated, count(distinct shape) as shapes, count(*) filter (p is not null and key <= p) as order_breaks from o group by file) e, nation where n_nationkey = 0
union all select n_name, 0, 0, 0, 0, true from nation""")
def sc04(spark, sf):
    from ..operators.ordered import running_sum
    e = B.table(spark, sf, "events").select(F.concat(F.lit("0:"), "event_type").alias("file"), "event_id", F.floor(C("user_id") / 100).alias("shape"),
                                            F.call_function("div", T.micros("ts"), F.lit(60_000_000)).alias("key"))
    k = running_sum(e.withColumn("_chunk", F.floor(C("event_id") / 4096)), ["file"], "_chunk", ["event_id"], {"ordinal": F.lit(1)}).withColumn("ordinal", C("ordinal") - 1)
    files = e.select("file").distinct().unionByName(B.table(spark, sf, "nation").select(C("n_name").alias("file")))
    return FR.audit_file_keys(k.drop("_chunk"), files, 1024)


@query("sc05_common_timestamps", """with a as (select (user_id % 4)::varchar as file, epoch_us(ts) // 300000000 as key from events where event_type = 'view'), b as (select (user_id % 4)::varchar as file, epoch_us(ts) // 300000000 as key from events where event_type = 'click')
select key, 'common' as kind, 0::bigint as files from (select key from a intersect select key from b) union all select key, 'a', count(distinct file) from a group by key having count(distinct file) > 1
union all select key, 'b', count(distinct file) from b group by key having count(distinct file) > 1""")
def sc05(spark, sf):
    e = B.table(spark, sf, "events").select((C("user_id") % 4).cast("string").alias("file"), T.slot_index("ts", 5).alias("key"), "event_type")
    both, twice = FR.common_timestamps(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type"))
    return both.select("key", F.lit("common").alias("kind"), F.lit(0).cast("long").alias("files")).unionByName(twice.select("key", C("side").alias("kind"), "files"))


@query("sc05_unequal_pairs", """with a as (select user_id // 4 as pair, epoch_us(ts) // 300000000 as key, event_id from events), b as (select * exclude (key), case when event_id % 97 = 3 then key + 1 else key end as key from a where event_id % 89 <> 5),
x as (select pair, key, count(*) as rows_a from a group by all), y as (select pair, key, count(*) as rows_b from b group by all)
select pair, key, coalesce(rows_a, 0) as rows_a, coalesce(rows_b, 0) as rows_b from x full join y using (pair, key) where coalesce(rows_a, 0) <> coalesce(rows_b, 0)""")
def sc05_pairs(spark, sf):
    """One file of each pair lacks some keys and has others moved."""
    a = B.table(spark, sf, "events").select(F.floor(C("user_id") / 4).alias("pair"), T.slot_index("ts", 5).alias("key"), "event_id")
    b = a.filter("event_id % 89 <> 5").withColumn("key", F.when(C("event_id") % 97 == 3, C("key") + 1).otherwise(C("key")))
    return FR.unequal_pairs(a.drop("event_id"), b.drop("event_id"))


@query("sc06_estimate_bytes", "select o_orderpriority as source, year(o_orderdate)::int as y, count(*) as frames, sum((o_custkey % 7 + 1) * 4 + 2)::bigint as bytes from orders group by all")
def sc06(spark, sf):
    o = B.table(spark, sf, "orders")
    return FR.estimate_bytes(o, [C("o_orderpriority").alias("source"), F.year("o_orderdate").alias("y")], C("o_custkey") % 7 + 1, 4, 2)


@query("sc07_event_index_round_trip", w(INDEX_SQL, f"""select t0_utc, block_id, split, condition_signature, available_leads_mask, 0::bigint as mismatches from idx"""))
def sc07(spark, sf):
    path = scratch(spark, "index") + "/t"
    PB.write_event_index(event_index(spark, sf), path)
    idx, bad = PB.read_event_index(spark, path)
    return idx.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("mismatches"))))  # one row


@query("sc08_draws_round_trip", w(DRAWS_SQL, "select global_example_index, sample_id, t0_utc, round(omega, 6) as omega, fold_id, 0::bigint as violations from draws", True))
def sc08(spark, sf):
    path = scratch(spark, "draws") + "/t"
    PB.write_draws(draws(spark, sf), path)
    d, bad = PB.read_draws(spark, path)
    return d.select("global_example_index", "sample_id", "t0_utc", r6(C("omega")).alias("omega"), "fold_id").join(
        F.broadcast(bad.agg(F.count(F.lit(1)).alias("violations"))))


@query("sc09_scan_candidates", w(items_sql(), "select split, count(*) as n, (sum(count(*)) over ())::bigint as meta_items from items group by split", True))
def sc09(spark, sf):
    path = scratch(spark, "cands") + "/t"
    it = items(spark, sf)
    PB.write_candidates(it, it.agg(F.count(F.lit(1)).alias("meta_items")), path)
    rows, meta = PB.scan_candidates(spark, path)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(meta))


@query("sc10_publish_bundle", w(DRAWS_SQL, """select 'index' as tbl, count(*) as "rows" from idx union all select 'candidates', count(*) from items union all select 'draws', count(*) from draws""", True))
def sc10(spark, sf):
    return PB.publish_bundle(spark, {"index": event_index(spark, sf), "candidates": items(spark, sf), "draws": draws(spark, sf)}, scratch(spark, "bundle") + "/t")


@query("sc14_fingerprint_files")
def sc14(spark, sf):
    return FR.fingerprint_files(spark, sf, "*.parquet")


@query("sc14_fingerprint_content", """with c as (select event_type || '/' || ts::date::varchar as path, user_id % 150 as pos, (round(max(value) * 100)::int // 10)::int as raw, day(ts) as dd from events group by all),
f as (select distinct path, dd from c), h as (select path, dd, f.path || '' as p, unnest(range(150)) as pos from f),
b as (select h.path, h.dd, h.pos, case when raw is null then 'D08A' else printf('%02X%02X', raw % 256, raw // 256) end as le from h left join c on c.path = h.path and c.pos = h.pos),
x as (select path, repeat('00', 1024) || string_agg(le, '' order by pos) || case when any_value(dd) = 13 then '00' else '' end as hx from b group by path)
select split_part(path, '/', 2) as file, length(hx) // 2 as bytes, sha256(unhex(hx)) as sha256 from x""")
def sc14_content(spark, sf):
    """The same step on payloads whose bytes SQL can rebuild."""
    return FR.fingerprint_content(payloads(spark, sf))


@query("sc15_fingerprint_table", """with h as (select sha256(o_orderkey::varchar || chr(31) || o_custkey::varchar || chr(31) || o_orderstatus || chr(31) || o_orderpriority) as h from orders)
select count(*) as "rows", bit_xor(('0x' || substr(h, 1, 15))::bigint) as xor60, sum(('0x' || substr(h, 16, 8))::bigint)::bigint as sum32 from h""")
def sc15(spark, sf):
    return FR.fingerprint_table(B.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("sc16_stats_round_trip", f"with {CHAN_SQL} select channel, {MOM} from ch where valid group by channel")
def sc16(spark, sf):
    st = SS.fit_normalization({"frames": chan(spark, sf).select("channel", "v", "valid")})
    path = scratch(spark, "stats") + "/t"
    PB.write_stats(st.withColumn("ord", F.lit(0)), path)
    return moments_out(PB.read_stats(spark, path))


@query("ud02_sql_functions", f"""with {EMB_SQL}, ev as (select event_id, {uniform_sql(7, 'draw', 'event_id')} as u, round(case when {NV} = 0 then 0 else pow(10, (45 * {NV} - 15) / 10) end, 6) as rate, case when value >= 10 then value else 0 end as model_mm,
 substr(sha256(strftime({SLOT_TS}, '%Y-%m-%dT%H:%M:%S') || '+00:00|1.5|' || event_type), 1, 24) as sid from events) select event_id, u, rate, model_mm, sid from ev""")
def ud02(spark, sf):
    SQLF.register(spark)
    e = B.table(spark, sf, "events").withColumn("slot_ts", T.slot_time(T.slot_index("ts", 5), 5))
    return e.selectExpr("event_id", "hash_uniform('7', 'draw', CAST(event_id AS STRING)) AS u", "round(rate_from_normalized(least(value / 1000D, 1D)), 6) + 0D AS rate",
                        "censor(value, 10D) AS model_mm", "sample_id(slot_ts, 1.5D, event_type) AS sid")


@query("ud02_sql_member_functions", f"""with {EMB_SQL}, b as (select vec_id, m, y, list_avg(list_transform(m, lambda v: abs(v - y))) as err from e)
select vec_id, round(list_sort(m)[(len(m) - 1) // 2 + 1], 6) as med, round(err - (select sum(abs(x1 - x2)) / 2 from (select unnest(m) as x1), (select unnest(m) as x2)) / (len(m) * (len(m) - 1)), 6) as crps from b""")
def ud02b(spark, sf):
    SQLF.register(spark)
    return members(spark, sf).selectExpr("vec_id", "round(lower_median(m), 6) + 0D AS med", "round(fair_crps(m, y), 6) + 0D AS crps")


@query("ud03_table_functions", """with l as (select event_id, unnest(list_filter(range(1, 13), lambda i: ((user_id % 4096) >> (i - 1)) & 1 = 1)) * 0.5 as lead_hours, epoch_us(ts) // 900000000 as slot from events)
select event_id, lead_hours::double as lead_hours, unnest(range(slot - 1, slot + 1)) as need from l""")
def ud03(spark, sf):
    SQLF.register(spark)
    e = B.table(spark, sf, "events").select("event_id", (C("user_id") % 4096).cast("int").alias("mask"), T.slot_index("ts", 15).alias("slot"))
    e.createOrReplaceTempView("petrichor_ud03")
    return spark.sql("SELECT e.event_id, l.lead_hours, s.need FROM petrichor_ud03 e, LATERAL expand_leads(e.mask) l, LATERAL explode_slots(e.slot, 1, 0) s")
