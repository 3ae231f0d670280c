"""Connected wet areas as a distributed graph job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, dropped, written


TILE = 64
_NEIGHBOURS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _label_tile(by: list[str]):
    """Smallest pixel id of each 8-connected area inside one tile; at most TILE x TILE pixels per call."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        r, c = y - y.min() + 1, x - x.min() + 1
        far = np.iinfo("int64").max
        grid = np.full((r.max() + 2, c.max() + 2), far, dtype="int64")
        grid[r, c] = (y.astype("int64") << 32) + x
        wet = grid != far
        while True:
            low = grid.copy()
            for dy, dx in _NEIGHBOURS:
                low = np.minimum(low, np.roll(grid, (dy, dx), (0, 1)))
            low = np.where(wet, low, far)
            if (low == grid).all():
                break
            grid = low
        return pdf.assign(local=grid[r, c])[[*by, "y", "x", "v", "local"]]
    return run


def wet_components(wet: DataFrame, by) -> DataFrame:
    """IT01: 8-connected components of wet pixels (by, y, x, v).

    Areas are labelled inside fixed tiles first (a bounded group per task). Only areas that touch a tile border
    meet others: their border pixels are matched by equi-join on the neighbour pixel, and smallest-label
    propagation with pointer jumping runs on that small graph of areas, each round's labels a written table. Labels only ever
    fall, so it runs until none does, whatever the length of an area; an area's root takes the smallest label that any of its
    areas sees (hooking), so a line through n tiles takes about log n rounds.
    """
    by = list(by)
    tiles = wet.select(*by, "y", "x", "v").withColumn("_ty", F.floor(F.col("y") / TILE)).withColumn("_tx", F.floor(F.col("x") / TILE))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wet.select(*by, "y", "x", "v").schema) + ", local bigint"
    px = cut_lineage(tiles.groupBy(*by, "_ty", "_tx").applyInPandas(_label_tile(by), schema))
    border = px.filter(F.pmod("y", F.lit(TILE)).isin(0, TILE - 1) | F.pmod("x", F.lit(TILE)).isin(0, TILE - 1)).select(*by, "y", "x", "local")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in _NEIGHBOURS]))
    near = border.withColumn("_s", step).select(*by, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("local").alias("a"))
    edges = written(near.join(border, [*by, "y", "x"]).filter("a <> local").select(*by, "a", F.col("local").alias("b")).distinct())
    labels = smallest_labels(edges, by)
    out = px.join(labels.withColumnRenamed("a", "local"), [*by, "local"], "left")
    return out.select(*wet.columns, F.coalesce("label", "local").alias("label"))


def component_stats(labelled: DataFrame, by, min_size: int = 4, peak: float = 1.0) -> DataFrame:
    by = list(by)
    size, top = F.count(F.lit(1)), F.max("v")
    return labelled.groupBy(*by, "label").agg(size.alias("size"), top.alias("peak"),
                                              ((size >= min_size) | (top >= peak)).alias("significant"))


def smallest_labels(edges: DataFrame, by=()) -> DataFrame:
    """(by, a, label): the smallest node reachable from each node of ``edges`` (by, a, b), which lists every edge both ways.

    Each round: a node's label takes the smallest label of its neighbours, the root that its old label names takes what any
    of its nodes has seen, and labels jump to their label's label. Written tables keep the optimizer's size estimates at the
    size of files.
    """
    by, old, new = list(by), [], []
    spark = edges.sparkSession
    labels = written(edges.groupBy(*by, "a").agg(F.least(F.col("a"), F.min("b")).alias("label")), old)
    while True:
        near = edges.join(labels.select(*by, F.col("a").alias("b"), F.col("label").alias("_near")), [*by, "b"]).groupBy(*by, "a").agg(F.min("_near").alias("_near"))
        seen = labels.join(near, [*by, "a"]).select(*by, "a", F.col("label").alias("_old"), F.least("label", "_near").alias("_low"))
        hooked = seen.select(*by, F.col("_old").alias("a"), "_low").union(seen.select(*by, "a", "_low")).groupBy(*by, "a").agg(F.min("_low").alias("_low"))
        step = written(seen.select(*by, "a", "_old").join(hooked, [*by, "a"]), new)
        jump = step.select(*by, F.col("a").alias("_low"), F.col("_low").alias("_jump"))
        after = written(step.join(jump, [*by, "_low"]).select(*by, "a", "_old", F.least("_low", "_jump").alias("label")), new)
        moved = after.filter("_old <> label").limit(1).count()
        dropped(spark, old)
        dropped(spark, new[:1])
        old, new = new[1:], []
        labels = after.drop("_old")
        if not moved:
            return labels
