"""Ordered scans that never put a whole ordering into one task.

A plain ``Window.orderBy`` without a partition key sends every row to one task. Here the order axis is
cut in chunks (a function of the ordering key, so it is the same on every retry): each chunk is scanned
on its own, one summary row per chunk is combined, and the carry of the chunks before is joined back.
The summary window holds one row per chunk, bounded by (axis length / chunk length).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def _names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _scan(df: DataFrame, by, chunk: str, order: Sequence, values: dict[str, Column | str],
          agg: Callable, combine: Callable[[Column, Column], Column], inclusive: bool) -> DataFrame:
    by = _names(by)
    local = W.partitionBy(*by, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    keys = [*by, chunk]
    totals = df.groupBy(*keys).agg(*[agg(v).alias(f"_t_{k}") for k, v in values.items()])
    carry = totals.select(*keys, *[agg(f"_t_{k}").over(before).alias(f"_c_{k}") for k in values])
    scanned = df.select("*", *[agg(v).over(local).alias(f"_l_{k}") for k, v in values.items()])
    out = scanned.join(carry, keys, "left")
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[combine(F.col(f"_l_{k}"), F.col(f"_c_{k}")).alias(k) for k in values])


def running_max(df: DataFrame, by, chunk: str, order: Sequence, values: dict, inclusive: bool = True) -> DataFrame:
    """Running maximum; nulls are skipped, null before the first value."""
    return _scan(df, by, chunk, order, values, F.max, lambda a, b: F.greatest(a, b), inclusive)


def running_sum(df: DataFrame, by, chunk: str, order: Sequence, values: dict, inclusive: bool = True) -> DataFrame:
    return _scan(df, by, chunk, order, values, F.sum,
                 lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), inclusive)


def running_last(df: DataFrame, by, chunk: str, position: str, values: dict) -> DataFrame:
    """Last value that isn't null up to each row, in order of ``position``; a chunk hands on one row."""
    by = _names(by)
    keys = [*by, chunk]
    local = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    there = {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()}
    ends = df.groupBy(*keys).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col(position))).alias(f"_t_{k}") for k, v in there.items()])
    carry = ends.select(*keys, *[F.last(f"_t_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in there])
    scanned = df.select("*", *[F.last(v, ignorenulls=True).over(local).alias(f"_l_{k}") for k, v in there.items()])
    out = scanned.join(carry, keys, "left")
    return out.select(*[c for c in df.columns if c not in values], *[F.coalesce(f"_l_{k}", f"_c_{k}").alias(k) for k in values])


def placed(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by a unique key, then fix the placement in a reliable checkpoint.

    Adds ``_part`` and ``_pos`` (position inside the part). Range bounds come from a sample of the whole
    key, so a hot leading key is split by the later ones. The checkpoint makes the placement the same for
    every later pass, also after a lost executor.
    """
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_mid", mid)
    numbered = numbered.select(*df.columns,
                               F.shiftrightunsigned("_mid", 33).cast("int").alias("_part"),
                               F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    return cut_lineage(numbered)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """WN10: dense 0..n-1 position in a global order; one shuffle plus one row of carry per part."""
    p = placed(df, order, partitions)
    counts = p.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry_off"))
    # one row per range part, as many as spark.sql.shuffle.partitions: a fixed, small broadcast
    return (p.join(F.broadcast(offset), "_part")
            .select(*df.columns, (F.col("_carry_off") + F.col("_pos")).cast("long").alias(out)))


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, out: str = "cum",
               partitions: int | None = None) -> DataFrame:
    """WN07 at scale: inclusive running sum in a global order."""
    p = placed(df, order, partitions)
    return running_sum(p, [], "_part", ["_pos"], {out: F.col(value)}).drop("_part", "_pos")


def hashed_index(df: DataFrame, hex_key: str, tie: str, out: str = "idx", by=(), digits: int = 3) -> DataFrame:
    """Dense position by a hex digest: its leading digits are already a balanced, ordered chunk."""
    by = _names(by)
    keys = [*by, "_chunk"]
    d = df.withColumn("_chunk", F.substring(hex_key, 1, digits))
    local = F.row_number().over(W.partitionBy(*keys).orderBy(hex_key, tie))
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # the summary has at most 16**digits rows per group of ``by``
    offset = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry_off"))
    return (d.withColumn("_rn", local).join(offset, keys)
            .select(*df.columns, (F.col("_carry_off") + F.col("_rn") - 1).cast("long").alias(out)))
