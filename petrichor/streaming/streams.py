"""Structured Streaming forms of the batch operators: same rules, unbounded input, bounded state."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import micros
from ..session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_files(spark: SparkSession, folder: str, pattern: str, schema: str, max_files: int = 64) -> DataFrame:
    """File stream source with a fixed schema; a bounded number of files per micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder))


def event_time(col: str = "ts") -> Column:
    """Watermarks need TIMESTAMP; the stored value is UTC without a zone, whatever the session zone is."""
    return F.timestamp_micros(micros(col))


def stream_scans(raw: DataFrame, minutes: int, delay: str, keys=("source", "slot", "y", "x")) -> DataFrame:
    """ST01: scans with the number of their slot of ``minutes``, one row per (source, slot, pixel) within the watermark.

    A scan without time has no slot and is left out.
    """
    stamped = raw.filter("t IS NOT NULL").withColumn("slot", F.floor(F.unix_micros("t") / (minutes * 60_000_000)))
    return stamped.withWatermark("t", delay).dropDuplicatesWithinWatermark(list(keys))


def edge_twice(scans: DataFrame, step_minutes: int, window_minutes: int) -> DataFrame:
    """A scan on a window edge belongs to the window it ends and the one it starts, half weight in each."""
    width = window_minutes * 60
    sec = F.unix_seconds("t")
    edge = F.pmod(sec, F.lit(width)) == 0
    here = F.struct(F.col("t").alias("wt"), F.when(edge, F.lit(0.5)).otherwise(F.lit(1.0)).alias("w"))
    back = F.struct((F.col("t") - F.expr(f"INTERVAL {step_minutes} MINUTES")).alias("wt"), F.lit(0.5).alias("w"))
    return scans.withColumn("_e", F.explode(F.when(edge, F.array(here, back)).otherwise(F.array(here)))).withColumn(
        "wt", F.col("_e.wt")).withColumn("w", F.col("_e.w")).drop("_e")


def stream_accumulate(scans: DataFrame, step_minutes: int, window_minutes: int, delay: str, by=("y", "x")) -> DataFrame:
    """ST02: window totals; ``complete`` only when every scan of the window was seen. State: one row per open window and pixel."""
    n = window_minutes // step_minutes + 1
    d = edge_twice(scans, step_minutes, window_minutes).withWatermark("wt", delay)
    win = F.window("wt", f"{window_minutes} minutes")
    g = d.groupBy(win.alias("win"), *by).agg(F.sum(F.col("w") * F.col("r")).alias("_s"), F.count(F.lit(1)).alias("scans"), F.min("valid").alias("valid"))
    return g.select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), *by, "scans", (F.col("scans") == n).alias("complete"),
                    F.when((F.col("scans") == n) & F.col("valid"), F.col("_s") * F.lit(step_minutes / 60.0)).alias("raw"))


def stream_history(scans: DataFrame, width: str, slide: str, delay: str, by=()) -> DataFrame:
    """ST03: sliding history statistics."""
    win = F.window("t", width, slide)
    return (scans.withWatermark("t", delay).groupBy(win.alias("win"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"), F.max("r").alias("peak"))
            .select(F.col("win.start").alias("start"), *by, "n", "total", "peak"))


def stream_active_runs(scans: DataFrame, step: str, gap: str, threshold: float, min_pixels: int, delay: str, by=("source",)) -> DataFrame:
    """ST04: slot activity, then sessions of active slots: two stateful aggregations in append mode."""
    win = F.window("t", step)
    act = (scans.withWatermark("t", delay).groupBy(win.alias("win"), *by)
           .agg(F.count_if(F.col("r") >= threshold).alias("px")).filter(F.col("px") >= min_pixels)
           .select(F.window_time("win").alias("at"), F.col("win.start").alias("slot_start"), *by))
    return (act.groupBy(F.session_window("at", gap).alias("s"), *by)
            .agg(F.min("slot_start").alias("first_slot"), F.max("slot_start").alias("last_slot"), F.count(F.lit(1)).alias("slots"))
            .select(*by, "first_slot", "last_slot", "slots"))


def stream_moments(scans: DataFrame, by) -> DataFrame:
    """ST07: running moments per channel; state is one row per channel."""
    return scans.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("variance"), F.min("r").alias("min"), F.max("r").alias("max"))


def stream_enrich(scans: DataFrame, static: DataFrame, on) -> DataFrame:
    """ST08: stream-static join."""
    return scans.join(static, on, "left")


LATEST_OUTPUT = "key long, id long, t_us long, cycle_us long, value double"
LATEST_STATE = "ids array<long>, times array<long>, cycles array<long>, values array<double>, scan_keys array<long>, cycle_keys array<long>"


def _latest(max_age_us: int) -> Callable:
    """Scans wait until the watermark has passed them, so that a cycle published late still counts; then each takes the last cycle.

    A group holds the rows of many keys, told apart by the column ``key``; without that column it is one key, and the state has none.
    """
    def longs(*columns) -> np.ndarray:
        return np.array([np.asarray(c, dtype="int64") for c in columns])

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        pdfs = list(batches)
        ids, times, cycles, values, scan_keys, cycle_keys = state.get if state.exists else ([], [], [], [], [], [])
        keyed = len(scan_keys) + len(cycle_keys) > 0 or any("key" in pdf for pdf in pdfs)
        scans = [longs(scan_keys or [0] * len(ids), times, ids)]
        known, worth = [longs(cycle_keys or [0] * len(cycles), cycles)], [np.asarray(values, dtype="float64")]
        for pdf in pdfs:
            cycle, us = pdf["is_cycle"].to_numpy(dtype=bool), pdf["us"].to_numpy()
            k = pdf["key"].to_numpy() if keyed else np.zeros(len(pdf))
            scans.append(longs(k[~cycle], us[~cycle], pdf["id"].to_numpy()[~cycle]))
            known.append(longs(k[cycle], us[cycle]))
            worth.append(pdf["value"].to_numpy(dtype="float64")[cycle])
        (sk, st, si), (ck, ct), cv = np.concatenate(scans, axis=1), np.concatenate(known, axis=1), np.concatenate(worth)
        order = np.lexsort((cv, ct, ck))
        ck, ct, cv = ck[order], ct[order], cv[order]
        top = np.append((ck[1:] != ck[:-1]) | (ct[1:] != ct[:-1]), True)[:len(ck)]  # several of one instant: the largest, whatever the order
        ck, ct, cv = ck[top], ct[top], cv[top]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = st < mark
        rk, rt, ri = sk[ready], st[ready], si[ready]
        if len(rk):
            line = np.lexsort((np.repeat([0, 1], [len(ck), len(rk)]), np.append(ct, rt), np.append(ck, rk)))  # cycles before scans of their instant
            last = np.maximum.accumulate(np.where(line < len(ck), line, -1))
            scan = line >= len(ck)
            at, row = last[scan], line[scan] - len(ck)
            fresh = at >= 0
            fresh[fresh] = (ck[at[fresh]] == rk[row[fresh]]) & (rt[row[fresh]] - ct[at[fresh]] <= max_age_us)
            cycle_us, value = np.full(len(row), -1, dtype="int64"), np.zeros(len(row))
            cycle_us[fresh], value[fresh] = ct[at[fresh]], cv[at[fresh]]
            yield pd.DataFrame({"key": rk[row] if keyed else key[0], "id": ri[row], "t_us": rt[row], "cycle_us": cycle_us, "value": value})
        # what no scan from the watermark on can take is let go: cycles older than the age, and all but a key's last before the mark
        passed = ct <= mark
        latest = np.append((ck[1:] != ck[:-1]) | (ct[1:] > mark), True)[:len(ck)]
        kept = ~passed | (latest & (mark - ct <= max_age_us))
        sk, st, si, ck, ct, cv = sk[~ready], st[~ready], si[~ready], ck[kept], ct[kept], cv[kept]
        if len(st) or len(ct):
            state.update((si.tolist(), st.tolist(), ct.tolist(), cv.tolist(), *((sk.tolist(), ck.tolist()) if keyed else ([], []))))
            wake = int(st.min()) if len(st) else int(ct.max()) + max_age_us
            state.setTimeoutTimestamp(max(wake // 1000, mark // 1000 + 1))
        elif state.exists:
            state.remove()
    return run


def stream_latest_cycle(scans: DataFrame, cycles: DataFrame, delay: str, max_age_s: int, groups: int = 1024) -> DataFrame:
    """ST08: each scan (key, id, t) with the last cycle (key, t, value) at or before it that is not older than ``max_age_s``.

    Both streams are one, dealt by a digest of the key into ``groups`` groups, since a call and a state for each key would cost more
    than its rows. A scan is given out when the watermark has passed it, so cycles that come up to ``delay`` late count. State of
    a key: the scans of the delay, the cycles from the watermark on and the last before it, which expires with its age; a timer
    wakes groups that get no more rows. A group's state is one row, so ``groups`` grows with the rows of the delay; it is fixed
    for the life of a checkpoint.
    """
    a = scans.select("key", "t", "id", F.lit(False).alias("is_cycle"), F.lit(None).cast("double").alias("value"))
    b = cycles.select("key", "t", F.lit(None).cast("long").alias("id"), F.lit(True).alias("is_cycle"), "value")
    both = a.unionByName(b).filter("t IS NOT NULL AND key IS NOT NULL AND (NOT is_cycle OR value IS NOT NULL)").withWatermark("t", delay)
    both = both.select("key", "t", "is_cycle", F.unix_micros("t").alias("us"), F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("value", F.lit(0.0)).alias("value"))
    grouped = both.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("part")
    out = grouped.applyInPandasWithState(_latest(max_age_s * 1_000_000), LATEST_OUTPUT, LATEST_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    found = F.col("cycle_us") >= 0
    return out.select("key", "id", F.timestamp_micros("t_us").alias("t"), F.when(found, F.timestamp_micros("cycle_us")).alias("cycle"), F.when(found, F.col("value")).alias("value"))


def stream_pair(left: DataFrame, right: DataFrame, delay: str, within: str, key: str) -> DataFrame:
    """ST08: stream-stream interval join, both sides watermarked: state is dropped after the interval."""
    a = left.withWatermark("lt", delay).alias("a")
    b = right.withWatermark("rt", delay).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.rt <= a.lt AND b.rt >= a.lt - INTERVAL {within}")).select(
        "a.*", *[f"b.{c}" for c in right.columns if c != key])


# --- ST05 ------------------------------------------------------------------------------------------------
TRIGGER_OUTPUT = "domain string, opened_s long, closed_s long, slots long"
TRIGGER_STATE = "pending array<long>, peaks array<double>, recent array<long>, opened long, until long, slots long"


def _folded(slot_s: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scans (domain, us, r) folded to the peak and the last instant of each slot, before any are shuffled."""
    def run(batches):
        for pdf in batches:
            d = pdf.assign(slot=pdf["us"] // (slot_s * 1_000_000) * slot_s)
            yield d.groupby(["domain", "slot"], as_index=False).agg(us=("us", "max"), r=("r", "max"))[["domain", "slot", "us", "r"]]
    return run


def _trigger(slot_s: int, look_s: int, need: int, collect_s: int, threshold: float) -> Callable:
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        pending, peaks, recent, opened, until, slots = state.get if state.exists else ([], [], [], -1, -1, 0)
        waiting, recent, out = dict(zip(pending, peaks)), list(recent), []
        for pdf in batches:
            for slot, r in zip(pdf["slot"].tolist(), pdf["r"].tolist()):
                waiting[slot] = max(r, waiting.get(slot, r))
        mark = state.getCurrentWatermarkMs() / 1000
        for t in sorted(s for s in waiting if s + slot_s < mark):  # whole slots only, in order, whatever order they came in
            active = waiting.pop(t) >= threshold
            if opened >= 0 and t > until:
                out.append((key[0], opened, until, slots))
                opened, until, slots = -1, -1, 0
            recent = [s for s in recent if s > t - look_s]
            if opened < 0 and len(recent) >= need:  # decided from the past alone
                opened, until, slots = t, t + collect_s, 0
            if opened >= 0:
                slots += 1
                until = max(until, t + collect_s) if active else until
            if active:
                recent.append(t)
        if opened >= 0 and until + slot_s < mark:  # the timer: no slot came that would close it
            out.append((key[0], opened, until, slots))
            opened, until, slots = -1, -1, 0
        recent = [s for s in recent if s > mark - slot_s - look_s]
        order = sorted(waiting)
        if waiting or recent or opened >= 0:
            state.update((order, [waiting[t] for t in order], recent, opened, until, slots))
            wake = min([t + slot_s for t in order[:1]] + [until + slot_s] * (opened >= 0) + [max(recent, default=0) + look_s + slot_s] * (not order and opened < 0))
            state.setTimeoutTimestamp(int(max(wake * 1000, mark * 1000 + 1)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["domain", "opened_s", "closed_s", "slots"])
    return run


def stream_trigger(scans: DataFrame, slot: int, delay: str, threshold: float, look: int = 3 * 3600, need: int = 2, collect: int = 9 * 3600) -> DataFrame:
    """ST05: open a collection for a domain after ``need`` active slots in the last ``look`` seconds, from the past alone, and hold it
    for at least ``collect`` seconds after the last active slot. Input: scans (domain, t, r); a slot of ``slot`` seconds is active if
    its peak reaches ``threshold``.

    Slots wait in the state until the watermark has passed them, so their order of arrival doesn't matter. A timer closes a
    collection when the watermark passes its end, without a later slot. State of a domain: the slots of ``delay`` and
    ``look``; a domain that is quiet and has nothing open has none.
    """
    slim = scans.select("domain", F.unix_micros("t").alias("us"), "r").filter("domain IS NOT NULL AND us IS NOT NULL AND r IS NOT NULL")
    slots = slim.mapInPandas(_folded(slot), "domain string, slot long, us long, r double")
    out = (slots.withColumn("t", F.timestamp_micros("us")).withWatermark("t", delay).groupBy("domain").applyInPandasWithState(
        _trigger(slot, look, need, collect, threshold), TRIGGER_OUTPUT, TRIGGER_STATE, "append", GroupStateTimeout.EventTimeTimeout))
    return out.select("domain", F.timestamp_seconds("opened_s").alias("opened"), F.timestamp_seconds("closed_s").alias("closed"), "slots")


# --- sinks -------------------------------------------------------------------------------------------------
def late_report(sink: str, slot_minutes: int, allowed_s: int) -> Callable[[DataFrame, int], None]:
    """ST06: for foreachBatch; counts rows per slot that arrive more than ``allowed_s`` after the newest of all earlier batches.

    Each batch owns a folder by its number in both tables, counts and newest times, and overwrites it: a batch that is run again
    after a failure leaves what it left the first time, as it looks at lower numbers only.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            lower = spark.read.schema("newest timestamp, batch_id long").parquet(f"{sink}/newest").filter(F.col("batch_id") < batch_id)
            before = lower.agg(F.max(F.unix_micros("newest")).alias("us")).first()["us"]
        late = F.lit(False) if before is None else F.coalesce(F.unix_micros("t") < F.lit(before - allowed_s * 1_000_000), F.lit(False))
        (batch.groupBy(F.window("t", f"{slot_minutes} minutes").start.alias("slot"))
         .agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"))
         .write.mode("overwrite").parquet(f"{sink}/report/batch_id={batch_id}"))
        batch.agg(F.max("t").alias("newest")).write.mode("overwrite").parquet(f"{sink}/newest/batch_id={batch_id}")
    return run


def late_table(spark: SparkSession, sink: str) -> DataFrame:
    """Counts of all batches per slot."""
    rows = spark.read.schema("slot timestamp, rows long, late long, batch_id long").parquet(f"{sink}/report")
    return rows.groupBy("slot").agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))


def arriving(spark: SparkSession, parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str,
             each: Callable[[str], Callable[[DataFrame, int], None]] | None = None) -> str:
    """Let ``parts`` arrive one after another: each is written to one folder and the same query, stopped in between, goes on over it.

    ``build`` makes the query from the stream of that folder. Its rows are appended to files, or every batch goes to
    ``each(folder)``. Gives the folder of the results.
    """
    base = scratch(spark, name)
    source, out, ck = f"{base}/source", f"{base}/out", f"{base}/ck"
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 100_000).parquet(source)
        w = build(stream).writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
        w = w.foreachBatch(each(out)) if each else w.outputMode("append").format("parquet").option("path", out)
        w.start().awaitTermination()
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        ensure_checkpoint_dir(spark)
        import uuid
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is available, then read the result table. Append results go to files; update and complete results
    are small by construction (one row per key) and are written per batch."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    out, ck = f"{base}/out", f"{base}/ck"
    w = stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i:06d}")).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    d = spark.read.parquet(out)
    last = d.agg(F.max("batch").alias("batch"))  # one row
    return d.join(F.broadcast(last), "batch").drop("batch")




def stream_table(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Continue with a result table as a new stream (one stage's sink is the next stage's source)."""
    base = scratch(spark, "stage")
    table.write.parquet(f"{base}/t")
    return spark.readStream.schema(table.schema).parquet(f"{base}/t")
