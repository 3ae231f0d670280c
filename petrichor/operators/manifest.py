"""Event index, candidate items, grouped folds and their audits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import time as T
from . import events as E
from . import slots as S
from ..session import cut_lineage
from .ordered import hashed_index
from .splits import assign_split, priority_rank

TICK = 5  # minutes; events, gaps and guards are counted in these


def nominal_index(slots: DataFrame, splits, minutes: int, history: int, horizon: int,
                  gap_ticks: int, guard_ticks: int) -> DataFrame:
    """Every eligible issue slot with its event, its own split and the split its event ends up in.

    ``status`` is kept, embargoed (the dependency crosses a split edge) or cross_split (the event belongs to
    a split of higher priority). Works on distinct slots only.
    """
    k = minutes // TICK
    # adjacent slots are one tick-run apart, so runs, gap and guard are one merge of the slots themselves
    points = slots.select((F.col("slot") * k).alias("start"), (F.col("slot") * k).alias("end"))
    events = E.event_intervals(points, max(gap_ticks, k), guard_ticks).drop("n_seeds")
    issues = S.strict_issue_slots(slots, history, horizon)
    low, high = (F.col("slot") - (history - 1)) * k, (F.col("slot") + horizon) * k
    hit = E.containing_event(issues, events, low, high, 288, how="left")
    day = T.slot_time("slot", minutes)
    rows = hit.select(
        "slot", day.alias("t0_utc"),
        T.add_minutes(day, -(history - 1) * minutes).alias("dependency_start_utc"),
        T.add_minutes(day, horizon * minutes).alias("dependency_end_utc"),
        H.event_id(T.slot_time("start", TICK), T.slot_time("end", TICK)).alias("block_id"))
    rows = rows.withColumn("nominal", assign_split(F.col("dependency_start_utc"), F.col("dependency_end_utc"), splits))
    best = (rows.filter("nominal is not null").groupBy("block_id")
            .agg(F.min_by("nominal", priority_rank(F.col("nominal"))).alias("split")))
    status = (F.when(F.col("nominal").isNull(), "embargoed")
              .when(F.col("nominal") != F.col("split"), "cross_split").otherwise("kept"))
    return rows.join(best, "block_id", "left").withColumn("status", status)


def event_index(nominal: DataFrame) -> DataFrame:
    """IT06: rows that stay."""
    return nominal.filter("status = 'kept'").drop("status", "nominal")


def index_audit(nominal: DataFrame, leads: int) -> DataFrame:
    """AG06: one row of counts."""
    kept = F.col("status") == "kept"
    n = F.count(F.lit(1))

    def share(k):
        return F.when(n > 0, k / n).otherwise(F.lit(0.0))
    return nominal.agg(
        n.alias("eligible"), F.count_if(kept).alias("issue_times"),
        (F.count_if(kept) * leads).alias("expanded_items"),
        F.count_distinct(F.when(kept, F.col("block_id"))).alias("event_blocks"),
        F.count_if(F.col("status") == "embargoed").alias("embargoed"),
        F.count_if(F.col("status") == "cross_split").alias("cross_split"),
        share(F.count_if(F.col("status") == "embargoed")).alias("embargo_fraction"), share(F.count_if(~kept)).alias("excluded_fraction"))


def split_audit(index: DataFrame, minimum_blocks: int = 20) -> DataFrame:
    blocks = F.count_distinct("block_id")
    return index.groupBy("split").agg(F.count(F.lit(1)).alias("issue_times"), blocks.alias("blocks"),
                                      (blocks < minimum_blocks).alias("low_support"))


def expand_items(index: DataFrame, lead_step_hours: float = 0.5, leads: int = 12) -> DataFrame:
    """Leads are exploded last, after every filter: the index stays one row per issue time."""
    d = index.withColumn("_lead", F.explode(T.expand_mask(F.col("available_leads_mask"), leads)))
    lead = F.col("_lead") * F.lit(lead_step_hours)
    return d.withColumn("lead_hours", lead).withColumn(
        "sample_id", H.sample_id(F.col("t0_utc"), F.col("lead_hours"), F.col("condition_signature"))).drop("_lead")


def split_probabilities(index: DataFrame, policy: str = "block_balanced") -> DataFrame:
    """AG08 on the compact index: item counts come from mask bits, so nothing is exploded to count.

    A block lies in one split; per-split totals are at most four rows.
    """
    bits = F.bit_count(F.col("available_leads_mask")).cast("long")
    per_block = index.groupBy("split", "block_id").agg(F.sum(bits).alias("_nb"))
    per_split = per_block.groupBy("split").agg(F.sum("_nb").alias("_ns"), F.count(F.lit(1)).alias("_blocks"))
    d = index.join(per_block, ["split", "block_id"]).join(F.broadcast(per_split), "split")
    target = F.lit(1.0) / F.col("_ns")
    draw = F.lit(1.0) / (F.col("_blocks") * F.col("_nb")) if policy == "block_balanced" else target
    return (d.withColumn("p_target", target).withColumn("p_draw", draw)
            .withColumn("omega", F.col("p_target") / F.col("p_draw")).drop("_nb", "_ns", "_blocks"))


# --- IT02 --------------------------------------------------------------------------------------------
def _fold_pieces(folds: int):
    """Loads after each block size, as pieces of ranks that cycle over a list of folds.

    Blocks of one size s fill folds in the order of (load + j * s, fold), i.e. level by level; a level visits
    the folds that have reached it, by remainder and fold number. So a whole size class is a few pieces.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = pd.concat(list(batches), ignore_index=True)
        loads = [0] * folds
        out = []
        for size, n in hist.sort_values("size", ascending=False)[["size", "n"]].itertuples(index=False):
            size, left, at = int(size), int(n), 0
            level = [ld // size for ld in loads]
            order = sorted(range(folds), key=lambda f: (loads[f] % size, f))
            steps = sorted(set(level))
            for i, q in enumerate(steps):
                active = [f for f in order if level[f] <= q]
                room = left if i + 1 == len(steps) else min(left, (steps[i + 1] - q) * len(active))
                if room:
                    out.append((size, at, at + room, active))
                    for j, f in enumerate(active):
                        loads[f] += size * ((room - j + len(active) - 1) // len(active))
                    at, left = at + room, left - room
                if not left:
                    break
        yield pd.DataFrame(out, columns=["size", "rank_from", "rank_to", "cycle"])
    return run


def grouped_folds(blocks: DataFrame, folds: int = 3, seed: int = 11103, block: str = "block_id",
                  size: str = "size") -> DataFrame:
    """IT02: largest block first, each to the least-loaded fold (lowest number on a tie).

    The result equals the one-by-one greedy rule, but only the histogram of block sizes is walked in order.
    N items have at most sqrt(2 N) different block sizes, so that table stays small whatever the number of
    blocks; ranks inside a size come from a distributed index over the tie-break hash.
    """
    if folds < 2:
        raise ValueError("at least two folds are required")
    keyed = blocks.select(block, F.col(size).cast("long").alias("size")).withColumn(
        "_hash", F.sha2(H.nul_joined(seed, F.col(block)), 256))
    keyed = cut_lineage(keyed)  # one row per block; read three times below
    hist = keyed.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    pieces = hist.coalesce(1).mapInPandas(_fold_pieces(folds), "size long, rank_from long, rank_to long, cycle array<int>")
    ranked = hashed_index(keyed, "_hash", block, "_rank", ["size"])
    on = [ranked["size"] == pieces["size"], ranked["_rank"] >= pieces["rank_from"], ranked["_rank"] < pieces["rank_to"]]
    pos = F.pmod(F.col("_rank") - F.col("rank_from"), F.size("cycle")).cast("int") + 1
    return ranked.join(pieces, on).select(block, ranked["size"], F.element_at("cycle", pos).alias("fold_id"))


def attach_folds(items: DataFrame, folds: int = 3, seed: int = 11103) -> DataFrame:
    """Only outer_train blocks get a fold; holdout items keep null."""
    train = items.filter("split = 'outer_train'").groupBy("block_id").agg(F.count(F.lit(1)).alias("size"))
    return items.join(grouped_folds(train, folds, seed).select("block_id", "fold_id"), "block_id", "left")


# --- audits --------------------------------------------------------------------------------------------
def violation(df: DataFrame, rule: str, key: Column, detail: Column | str = "") -> DataFrame:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), d.cast("string").alias("detail"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_manifest(items: DataFrame, splits, minutes: int, history: int, horizon: int, folds: int) -> DataFrame:
    """AG07: all broken rules of a manifest as (rule, key, detail).

    Row rules share one pass (an array of broken rules per row); the group rules are partial aggregations.
    """
    start = T.add_minutes("t0_utc", -(history - 1) * minutes)
    end = T.add_minutes("t0_utc", horizon * minutes)
    c = F.col

    def bad(x):
        return x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))

    fold_bad = F.when(c("split") == "outer_train", c("fold_id").isNull() | ~c("fold_id").between(0, folds - 1)
                      ).otherwise(c("fold_id").isNotNull())
    rules = {
        "sampling_value": bad(c("p_target")) | bad(c("p_draw")) | bad(c("omega")),
        "importance_weight": F.abs(c("omega") - c("p_target") / c("p_draw")) > 1e-8 + 1e-5 * F.abs(c("p_target") / c("p_draw")),
        "sample_id": c("sample_id") != H.sample_id(c("t0_utc"), c("lead_hours"), c("condition_signature")),
        "split": ~c("split").eqNullSafe(assign_split(start, end, splits)),
        "dependency": (c("dependency_start_utc") != start) | (c("dependency_end_utc") != end),
        "fold": fold_bad,
        "empty_field": (c("condition_signature") == "") | (c("block_id") == "") | (c("stratum") == ""),
    }
    marks = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]))
    row_bad = items.select("sample_id", F.explode(marks).alias("rule")).select(
        "rule", c("sample_id").alias("key"), F.lit("").alias("detail"))
    ident = items.groupBy("t0_utc", "lead_hours", "condition_signature").count().filter("count > 1")
    ids = items.groupBy("sample_id").count().filter("count > 1")
    blocks = items.select("block_id", "split", "fold_id").distinct().groupBy("block_id").agg(
        F.count_distinct("split").alias("s"), F.count_distinct(F.coalesce("fold_id", F.lit(-1))).alias("f"))
    sums = items.groupBy("split").agg(F.sum("p_target").alias("t"), F.sum("p_draw").alias("d"))
    used = items.filter("split = 'outer_train'").agg(F.count_distinct("fold_id").alias("n"), F.count(F.lit(1)).alias("rows"))
    return union_all([
        row_bad,
        violation(ident, "duplicate_identity", F.concat_ws("|", "t0_utc", "lead_hours", "condition_signature"), c("count")),
        violation(ids, "duplicate_sample_id", c("sample_id"), c("count")),
        violation(blocks.filter("s > 1"), "block_crosses_splits", c("block_id"), c("s")),
        violation(blocks.filter("f > 1"), "block_crosses_folds", c("block_id"), c("f")),
        violation(sums.filter("abs(t - 1) > 1e-9"), "target_sum", c("split"), ""),
        violation(sums.filter("abs(d - 1) > 1e-9"), "draw_sum", c("split"), ""),
        violation(used.filter(f"rows > 0 and n <> {folds}"), "folds_unpopulated", c("n"), ""),
    ])


def manifest_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("items"),
                                                 F.count_distinct("block_id").alias("blocks"))


def fold_partitions(items: DataFrame) -> DataFrame:
    """AG26: held-out and training rows per fold, plus how many blocks sit in more than one fold."""
    train = items.filter("split = 'outer_train'")
    per_block = train.groupBy("block_id", "fold_id").agg(F.count(F.lit(1)).alias("n"))
    spread = per_block.groupBy("block_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                                               F.min("fold_id").alias("fold_id"))
    per_fold = spread.groupBy("fold_id").agg(F.sum("n").alias("held_out"), F.count(F.lit(1)).alias("blocks"),
                                             F.count_if(F.col("k") > 1).alias("shared_blocks"))
    total = per_fold.agg(F.sum("held_out").alias("_all"))  # one row
    return per_fold.join(F.broadcast(total)).select(
        "fold_id", "held_out", (F.col("_all") - F.col("held_out")).alias("trained_on"), "blocks", "shared_blocks")


def issue_violations(index: DataFrame, leads: int = 12) -> DataFrame:
    """WN13: one (block, split) per issue time, one split per block, mask in range, unique identity."""
    c = F.col
    per_t0 = index.groupBy("t0_utc").agg(F.count_distinct("block_id", "split").alias("n"))
    per_block = index.groupBy("block_id").agg(F.count_distinct("split").alias("n"))
    ident = index.groupBy("t0_utc", "condition_signature").agg(F.count(F.lit(1)).alias("n"))
    mask = index.filter(~c("available_leads_mask").between(1, (1 << leads) - 1))
    return union_all([
        violation(per_t0.filter("n > 1"), "issue_assignment", c("t0_utc"), c("n")),
        violation(per_block.filter("n > 1"), "block_crosses_splits", c("block_id"), c("n")),
        violation(ident.filter("n > 1"), "duplicate_identity", F.concat_ws("|", "t0_utc", "condition_signature"), c("n")),
        violation(mask, "mask", c("t0_utc"), c("available_leads_mask")),
    ])
