"""Event grouping: gap merge, guard, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import placed, running_max

CHUNK_CELLS = 2048


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def merge_intervals(seeds: DataFrame, gap: int, by=(), start: str = "start", end: str = "end",
                    chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """WN03: join closed integer intervals while start - running max(end) <= gap.

    1. Two seeds whose starts share a cell no wider than the gap always belong together, so seeds shrink to
       one interval per cell by partial aggregation, however hot the source is.
    2. The axis is cut in chunks of cells. The farthest-reaching interval of a chunk leaves a marker in each
       later chunk it reaches, so every chunk can decide on its own which rows open a new event.
    3. Only the rows before the first opening of a chunk and its last event touch other chunks. They alone
       (two rows per chunk) share a window per source; all other events are already whole.
    """
    by = list(by)
    if gap < 0:
        raise ValueError("gap must be non-negative")
    width = max(gap, 1)
    span = width * chunk_cells
    n = F.sum("n_seeds") if "n_seeds" in seeds.columns else F.count(F.lit(1))
    cells = (seeds.groupBy(*by, _div(F.col(start), width).alias("_cell"))
             .agg(F.min(start).alias("_s"), F.max(end).alias("_e"), n.alias("_n"))
             .withColumn("_chunk", _div(F.col("_s"), span)))

    chunk = W.partitionBy(*by, "_chunk")
    far = F.row_number().over(chunk.orderBy(F.desc("_e"), F.desc("_s"))) == 1
    reached = F.when(far, F.sequence(F.col("_chunk"), F.greatest(F.col("_chunk"), _div(F.col("_e") + gap, span)))
                     ).otherwise(F.array("_chunk"))
    marked = (cells.withColumn("_reached", reached)
              .select(*by, "_s", "_e", "_n", F.col("_chunk").alias("_home"), F.explode("_reached").alias("_chunk"))
              .withColumn("_real", F.col("_home") == F.col("_chunk")))

    ordered = chunk.orderBy("_s")
    before = F.max("_e").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("_real") & (before.isNull() | (F.col("_s") - before > gap))
    local = (marked.withColumn("_open", F.when(opens, F.col("_s")))
             .withColumn("_group", F.max("_open").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
             .filter("_real").groupBy(*by, "_chunk", "_group")
             .agg(F.max("_e").alias("_e"), F.sum("_n").alias("_n")))

    last = F.max("_group").over(chunk)
    edge = F.col("_group").isNull() | (F.col("_group") == last)
    stitch = (W.partitionBy(*by, F.when(~F.col("_edge"), F.col("_group"))).orderBy("_chunk", F.asc_nulls_first("_group"))
              .rowsBetween(W.unboundedPreceding, 0))
    whole = local.withColumn("_edge", edge).withColumn("_id", F.last("_group", ignorenulls=True).over(stitch))
    return (whole.groupBy(*by, F.col("_id").alias(start))
            .agg(F.max("_e").alias(end), F.sum("_n").alias("n_seeds")).select(*by, start, end, "n_seeds"))


def guard_and_merge(events: DataFrame, guard: int, by=(), start: str = "start", end: str = "end") -> DataFrame:
    """WN04: widen both sides, then join while start <= running end."""
    wide = events.withColumn(start, F.col(start) - guard).withColumn(end, F.col(end) + guard)
    return merge_intervals(wide, 0, by, start, end)


def event_intervals(seeds: DataFrame, gap: int, guard: int, by=(), start: str = "start", end: str = "end") -> DataFrame:
    """WN03 then WN04 in one pass: widened events overlap exactly when the events are at most two guards apart."""
    return (merge_intervals(seeds, max(gap, 2 * guard), by, start, end)
            .withColumn(start, F.col(start) - guard).withColumn(end, F.col(end) + guard))


def containing_event(points: DataFrame, events: DataFrame, low: Column, high: Column, width: int,
                     by=(), how: str = "inner") -> DataFrame:
    """JN02: the merged event with start <= low and high <= end.

    Merged events do not overlap, so an event is listed once per bucket it touches (bounded by axis length
    / width + one per event) and the join is an equi-join on the bucket of ``low`` with a range residual.
    """
    by = list(by)

    def bucket(c: Column) -> Column:
        return _div(c, width)

    listed = events.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    left = points.withColumn("_low", low).withColumn("_high", high).withColumn("_bucket", bucket(low)).alias("p")
    right = listed.alias("e")
    on = [F.col(f"p.{b}") == F.col(f"e.{b}") for b in by] + [
        F.col("p._bucket") == F.col("e._bucket"),
        F.col("e.start") <= F.col("p._low"), F.col("p._high") <= F.col("e.end")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    extra = [c for c in events.columns if c not in by]
    # intervals that overlap would give a point several events; ``overlapping`` names them
    return left.join(right, cond, how).select(*[f"p.{c}" for c in points.columns], *[f"e.{c}" for c in extra])


def overlapping(events: DataFrame, by=(), start: str = "start", end: str = "end") -> DataFrame:
    """Violation rows of events that begin before another one of their group has ended (merged events never do).

    Starts are placed in one global order and the latest end before each is carried along, so a group of any size is
    spread over tasks.
    """
    by = list(by)
    line = running_max(placed(events.select(*by, start, end), [*by, start, end]).withColumn("_until", F.col(end)), by, "_part", ["_pos"],
                       {"_until": F.col(end)}, inclusive=False)
    key = F.concat_ws("|", *[F.col(b).cast("string") for b in by], F.col(start).cast("string"))
    return line.filter(F.col("_until") >= F.col(start)).select(F.lit("overlap").alias("rule"), key.alias("key"), F.col("_until").cast("string").alias("detail"))
