"""Axis weights, regridding, neighbourhoods and coordinates on long grids.

An axis is a table (idx, centre) with one row per grid line, at least two of them: its size is fixed by the sensor grid (thousands at
most), never by the number of frames. Axis tables and the weights made from them (at most two rows per source
or destination line) are therefore the only tables broadcast here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from ..functions.values import A_WET, clip


def cell_edges(axis: DataFrame) -> DataFrame:
    """WN06: midpoints between centres, half a step at both ends; one window over one axis."""
    w = W.orderBy("idx")
    c, prev, nxt = F.col("centre"), F.lag("centre").over(w), F.lead("centre").over(w)
    return axis.select("idx", "centre",
                       F.coalesce((prev + c) / 2, c - (nxt - c) / 2).alias("lo"),
                       F.coalesce((c + nxt) / 2, c + (c - prev) / 2).alias("hi"))


def segments(axis: DataFrame) -> DataFrame:
    """Stretches between neighbouring centres: (seg, left, right, is_first, is_last)."""
    w = W.orderBy("idx")
    d = axis.select(F.col("idx").alias("seg"), F.col("centre").alias("left"), F.lead("centre").over(w).alias("right"),
                    F.row_number().over(w).alias("_n")).filter("right is not null")
    last = F.max("seg").over(W.partitionBy())
    return d.select("seg", "left", "right", (F.col("_n") == 1).alias("is_first"), (F.col("seg") == last).alias("is_last"))


def bracket(points: DataFrame, x: Column, axis: DataFrame) -> DataFrame:
    """The segment of each point; outside the axis the end segment. Adds seg, left, right (JN14's as-of both ways),
    null for a point without a coordinate.

    Segments are listed under buckets of the mean spacing, so a point meets the one or two segments of its
    bucket in a hash join; the listing has at most about two rows per grid line.
    """
    ends = axis.agg(F.min("centre").alias("_x0"), F.max("centre").alias("_x1"), F.count(F.lit(1)).alias("_n"))  # one row

    def bucket(c):
        at = F.floor((c - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_n") - 1))
        return F.greatest(F.lit(0), F.least(F.col("_n") - 2, at))
    listed = (segments(axis).join(F.broadcast(ends))
              .withColumn("_b", F.explode(F.sequence(bucket(F.col("left")), bucket(F.col("right"))))).drop("_x0", "_x1", "_n"))
    d = points.withColumn("_x", x.cast("double")).join(F.broadcast(ends)).withColumn("_b", bucket(F.col("_x")))
    hit = (F.col("is_first") | (F.col("left") <= F.col("_x"))) & (F.col("is_last") | (F.col("_x") < F.col("right")))
    j = d.alias("p").join(F.broadcast(listed).alias("s"), (F.col("p._b") == F.col("s._b")) & hit, "left")
    return j.select(*[f"p.{c}" for c in points.columns], "s.seg", "s.left", "s.right")


def linear_interp(points: DataFrame, x: str, knots: DataFrame, value: str, out: str = "y") -> DataFrame:
    """JN14: piecewise-linear value, constant beyond the ends. knots = (idx, centre, value)."""
    w = W.orderBy("idx")
    pairs = knots.select(F.col("idx").alias("seg"), F.col(value).alias("_a"), F.lead(value).over(w).alias("_b")).filter("_b is not null")
    d = bracket(points, F.col(x), knots.select("idx", "centre")).join(F.broadcast(pairs), "seg", "left")
    t = clip((F.col(x) - F.col("left")) / (F.col("right") - F.col("left")), 0.0, 1.0)
    return d.select(*points.columns, (F.col("_a") + t * (F.col("_b") - F.col("_a"))).alias(out))


def area_weights(src: DataFrame, dst: DataFrame, tol: float = 1e-14) -> DataFrame:
    """JN10: exact cell means of the piecewise-linear basis: (dst, src, w); end segments extrapolate."""
    cells = cell_edges(dst).select(F.col("idx").alias("dst"), "lo", "hi")
    a = bracket(cells, F.col("lo"), src).select("dst", "lo", "hi", F.col("seg").alias("s0"))
    b = bracket(a, F.col("hi"), src).select("dst", "lo", "hi", "s0", F.col("seg").alias("s1"))
    pairs = b.withColumn("seg", F.explode(F.sequence("s0", "s1"))).join(F.broadcast(segments(src)), "seg")
    lo = F.when(F.col("is_first"), F.col("lo")).otherwise(F.greatest("lo", "left"))
    hi = F.when(F.col("is_last"), F.col("hi")).otherwise(F.least("hi", "right"))
    part = (hi - lo) / (F.col("hi") - F.col("lo")) / (F.col("right") - F.col("left"))
    mid = lo + (hi - lo) / 2
    both = F.array(F.struct(F.col("seg").alias("src"), (part * (F.col("right") - mid)).alias("w")),
                   F.struct((F.col("seg") + 1).alias("src"), (part * (mid - F.col("left"))).alias("w")))
    return (pairs.select("dst", F.explode(both).alias("_e")).groupBy("dst", F.col("_e.src").alias("src"))
            .agg(F.sum("_e.w").alias("w")).filter(F.abs("w") > tol))


def weight_violations(weights: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Invariants of JN10: no negative weight, rows sum to 1, centres are reproduced."""
    j = weights.join(F.broadcast(src.select(F.col("idx").alias("src"), F.col("centre").alias("_c"))), "src")
    g = j.groupBy("dst").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("_c")).alias("c"), F.min("w").alias("m"))
    g = g.join(F.broadcast(dst.select(F.col("idx").alias("dst"), "centre")), "dst")
    bad = (F.when(F.col("m") < -2e-12, "negative").when(F.abs(F.col("s") - 1) > 2e-12, "row_sum")
           .when(F.abs(F.col("c") - F.col("centre")) > 2e-11, "centre"))
    return g.withColumn("rule", bad).filter("rule is not null").select("rule", "dst")


def _axis_join(df: DataFrame, weights: DataFrame, axis: str) -> DataFrame:
    w = weights.select(F.col("src").alias(axis), F.col("dst").alias(f"dst_{axis}"), F.col("w").alias("_w"))
    return df.join(F.broadcast(w), axis)


def regrid_mean(frames: DataFrame, wx: DataFrame, wy: DataFrame, by=("ts",), minimum: float = 0.0, fill: float = 0.0,
                wet_above: float = A_WET) -> DataFrame:
    """JN11: separable weighted mean renormalised by the valid basis mass; two joins, two partial aggregations."""
    by = list(by)
    v = F.when(F.col("valid"), F.col("v")).otherwise(F.lit(0.0))
    ok = F.col("valid").cast("double")
    a = _axis_join(frames, wx, "x").groupBy(*by, "y", "dst_x").agg(
        F.sum(F.col("_w") * v).alias("_n"), F.sum(F.col("_w") * ok).alias("_m"))
    b = _axis_join(a, wy, "y").groupBy(*by, "dst_y", "dst_x").agg(
        F.sum(F.col("_w") * F.col("_n")).alias("_n"), F.sum(F.col("_w") * F.col("_m")).alias("_m"))
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_m")))
    good = F.col("valid_fraction") > minimum
    mean = F.when(good, F.col("_n") / F.col("valid_fraction")).otherwise(F.lit(fill))
    return (b.withColumn("valid_fraction", frac).withColumn("mean", mean)
            .withColumn("mean", F.when(F.abs("mean") < 1e-14, F.lit(0.0)).otherwise(F.col("mean")))
            .select(*by, "dst_y", "dst_x", "mean", "valid_fraction", (good & (F.col("mean") > wet_above)).alias("wet")))


def regrid_local_max(frames: DataFrame, wx: DataFrame, wy: DataFrame, by=("ts",), fill: float = 0.0) -> DataFrame:
    """JN12: largest valid value in the positive-weight support."""
    by = list(by)
    v = F.when(F.col("valid"), F.col("v"))
    a = _axis_join(frames.withColumn("_v", v), wx.filter("w > 0"), "x").groupBy(*by, "y", "dst_x").agg(F.max("_v").alias("_v"))
    b = _axis_join(a, wy.filter("w > 0"), "y").groupBy(*by, "dst_y", "dst_x").agg(F.max("_v").alias("_v"))
    return b.select(*by, "dst_y", "dst_x", F.coalesce("_v", F.lit(fill)).alias("detail"), F.col("_v").isNotNull().alias("detail_valid"))


def nearest_index(src: DataFrame, dst: DataFrame) -> DataFrame:
    """JN13: (dst, src, distance); a tie goes to the lower index."""
    b = bracket(dst.select(F.col("idx").alias("dst"), F.col("centre").alias("_c")), F.col("_c"), src)
    up = F.abs(F.col("right") - F.col("_c")) < F.abs(F.col("left") - F.col("_c"))
    return b.select("dst", F.when(up, F.col("seg") + 1).otherwise(F.col("seg")).alias("src"),
                    F.when(up, F.abs(F.col("right") - F.col("_c"))).otherwise(F.abs(F.col("left") - F.col("_c"))).alias("distance"))


def regrid_nearest(frames: DataFrame, nx: DataFrame, ny: DataFrame, by=("ts",), fill: float = 0.0) -> DataFrame:
    by = list(by)
    a = frames.join(F.broadcast(nx.select(F.col("src").alias("x"), F.col("dst").alias("dst_x"))), "x")
    b = a.join(F.broadcast(ny.select(F.col("src").alias("y"), F.col("dst").alias("dst_y"))), "y")
    return b.select(*by, "dst_y", "dst_x", F.when(F.col("valid"), F.col("v")).otherwise(F.lit(fill)).alias("detail"),
                    F.col("valid").alias("detail_valid"))


def geometry_confidence(src_x: DataFrame, dst_x: DataFrame, src_y: DataFrame, dst_y: DataFrame) -> DataFrame:
    """JN15: distance to the nearest source point and 1 / (1 + (distance / local diagonal)^2)."""
    def axis(src, dst, name):
        spacing = cell_edges(src).select("idx", "centre", (F.col("hi") - F.col("lo")).alias("spacing"))
        d = linear_interp(dst.select(F.col("idx").alias("dst"), "centre"), "centre", spacing, "spacing", f"s{name}")
        n = nearest_index(src, dst).select("dst", F.col("distance").alias(f"d{name}"))
        return d.join(F.broadcast(n), "dst").select(F.col("dst").alias(f"dst_{name}"), f"s{name}", f"d{name}")
    g = axis(src_y, dst_y, "y").crossJoin(F.broadcast(axis(src_x, dst_x, "x")))  # the destination grid itself
    dist = F.hypot("dy", "dx")
    q = dist / F.hypot("sy", "sx")
    return g.select("dst_y", "dst_x", dist.alias("distance"), (1 / (1 + q * q)).alias("confidence"))


def densify(cells: DataFrame, by, height: int, width: int, values) -> DataFrame:
    """Every grid cell of every field; an absent cell stays null with present = false, never zero."""
    by = list(by)
    grid = (cells.select(*by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))))
    have = cells.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *values, F.lit(True).alias("_p"))
    return (grid.join(have, [*by, "y", "x"], "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p"))


#: Side of the tiles in which neighbourhoods are worked out.
TILE = 64


def _tiled(dense: DataFrame, by, low: int, high: int, inputs: dict[str, Column], work, schema: str) -> DataFrame:
    """``dense`` with what ``work`` gives for each pixel from the pixels at offsets ``low`` to ``high`` in both directions.

    Pixels are dealt once, by (by, tile). A pixel near a tile's edge goes to the tiles beside it too, as halo, so a tile has all
    that its own pixels need and is a bounded group of (TILE + high - low) squared pixels. ``work`` takes the rows of a tile as an
    Arrow table, with places of all pixels and numbers of its own ones, and returns columns for the latter.
    """
    by = list(by)

    def tiles(c):
        return F.explode(F.sequence(F.floor((F.col(c) - high) / TILE), F.floor((F.col(c) - low) / TILE)))
    kept = dense.columns
    d = dense.select(*kept, *[v.alias(f"_in_{k}") for k, v in inputs.items()]).withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))
    own = (F.floor(F.col("y") / TILE) == F.col("_ty")) & (F.floor(F.col("x") / TILE) == F.col("_tx"))
    out = StructType([*dense.schema.fields, *StructType.fromDDL(schema).fields])

    def run(t: pa.Table) -> pa.Table:
        y, x = np.asarray(t["y"]).astype(np.int64), np.asarray(t["x"]).astype(np.int64)
        mine = np.flatnonzero(np.asarray(t["_own"]))
        place = (y - y.min(), x - x.min())
        shape = (int(place[0].max()) + 1, int(place[1].max()) + 1)
        rows = t.take(pa.array(mine)).select(kept)
        for name, column in work(t, place, shape, mine).items():
            rows = rows.append_column(name, column)
        return rows
    return d.withColumn("_own", own).groupBy(*by, "_ty", "_tx").applyInArrow(run, out)


def _moved_sum(grid: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """For each place the sum of ``grid`` at offsets ``low`` to ``high`` along ``axis``; nothing lies outside."""
    out = np.zeros_like(grid)
    n = grid.shape[axis]
    for k in range(low, high + 1):
        if abs(k) < n:
            to, of = [slice(None)] * 2, [slice(None)] * 2
            to[axis], of[axis] = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
            out[tuple(to)] += grid[tuple(of)]
    return out


def neighbourhood_sum(dense: DataFrame, by, length: int, values: dict[str, Column]) -> DataFrame:
    """WN08: sums over the even square -(L/2-1)..+L/2, cut at the border; null where no value lies in it. One shuffle, by tile."""
    lo, hi = -(length // 2 - 1), length // 2
    kinds = {f.name: f.dataType for f in dense.select(*[v.alias(k) for k, v in values.items()]).schema}
    whole = {k: isinstance(t, (ByteType, ShortType, IntegerType, LongType)) for k, t in kinds.items()}
    inputs = {k: v.cast("long" if whole[k] else "double") for k, v in values.items()}

    def work(t, place, shape, mine):
        out = {}
        for k in whole:
            column = t[f"_in_{k}"].combine_chunks()
            there = np.asarray(column.is_valid())
            grid, seen = np.zeros(shape, dtype=np.int64 if whole[k] else np.float64), np.zeros(shape, dtype=np.int64)
            grid[place], seen[place] = np.asarray(column.fill_null(0)), there
            for axis in (1, 0):
                grid, seen = _moved_sum(grid, lo, hi, axis), _moved_sum(seen, lo, hi, axis)
            at = (place[0][mine], place[1][mine])
            out[k] = pa.array(grid[at], mask=seen[at] == 0)
        return out
    return _tiled(dense, by, lo, hi, inputs, work, ", ".join(f"`{k}` {'bigint' if whole[k] else 'double'}" for k in values))


def chebyshev_bin(dense: DataFrame, by, invalid: Column) -> DataFrame:
    """WN09: distance class to the nearest invalid cell: 0, 1-2, 3-8, far. One shuffle, by tile."""
    def work(t, place, shape, mine):
        bad = np.zeros(shape, dtype=np.int64)
        bad[place] = np.asarray(t["_in_bad"].combine_chunks().fill_null(0))
        at = (place[0][mine], place[1][mine])
        label = np.full(len(mine), "far", dtype=object)
        for reach, name in ((8, "3-8"), (2, "1-2"), (0, "0")):
            near = _moved_sum(_moved_sum(bad, -reach, reach, 1), -reach, reach, 0)
            label[near[at] > 0] = name
        return {"distance_bin": pa.array(label, pa.string())}
    return _tiled(dense, by, -8, 8, {"bad": invalid.cast("long")}, work, "distance_bin string")


def curvilinear_spacing(grid: DataFrame, by=()) -> DataFrame:
    """WN14: grid (y, x, gx, gy in metres) to cell width and height in km; averaged inside, one-sided at edges."""
    by = list(by)

    def along(axis, other, out):
        w = W.partitionBy(*by, other).orderBy(axis)

        def dist(f):
            return F.hypot(f("gx").over(w) - F.col("gx"), f("gy").over(w) - F.col("gy")) / 1000
        a, b = dist(F.lag), dist(F.lead)
        return F.coalesce((a + b) / 2, a, b).alias(out)
    return grid.select(*grid.columns, along("x", "y", "width_km"), along("y", "x", "height_km"))


def orient_grid(fields: DataFrame, key) -> DataFrame:
    """PR26: rows (key, y, x, lat, value): north-to-south fields are flipped; direction read from the end rows."""
    key = list(key)
    ends = fields.groupBy(*key).agg((F.max_by("lat", "y") < F.min_by("lat", "y")).alias("flipped"), F.max("y").alias("_top"), F.min("y").alias("_base"))
    j = fields.join(ends, key)
    return j.withColumn("y", F.when(F.col("flipped"), F.col("_top") + F.col("_base") - F.col("y")).otherwise(F.col("y"))).drop("_top", "_base")


def axis_violations(axis: DataFrame, key) -> DataFrame:
    """SC13: fields whose axis is not strictly monotone."""
    key = list(key)
    w = W.partitionBy(*key).orderBy("y")
    d = axis.select(*key, (F.col("lat") - F.lag("lat").over(w)).alias("_d")).filter("_d is not null")
    return d.groupBy(*key).agg((F.min("_d") > 0).alias("_up"), (F.max("_d") < 0).alias("_down")).filter("not (_up or _down)").select(*key)


def near_mean(stations: DataFrame, cells: DataFrame, key, radius: float, x0: float, y0: float, dx: float, dy: float, value: str = "fc") -> DataFrame:
    """JN27: per station (key, sx, sy) the mean of ``value`` over the cells (cx, cy) whose centres lie within ``radius``.

    The plane is cut in square tiles of two radii. A station lies in one tile; a cell is listed in the tiles that a
    radius around its centre reaches, four at most. They meet by tile, and the distance decides.
    """
    key, side = list(key), 2.0 * radius

    def tile(c):
        return F.floor(c / side)
    at = cells.filter(F.col(value).isNotNull()).select(((F.col("cx") + 0.5) * dx + x0).alias("_x"), ((F.col("cy") + 0.5) * dy + y0).alias("_y"), F.col(value).alias("_v"))
    listed = at.withColumn("_tx", F.explode(F.sequence(tile(F.col("_x") - radius), tile(F.col("_x") + radius)))).withColumn(
        "_ty", F.explode(F.sequence(tile(F.col("_y") - radius), tile(F.col("_y") + radius))))
    there = stations.select(*key, "sx", "sy").withColumn("_tx", tile(F.col("sx"))).withColumn("_ty", tile(F.col("sy")))
    far = (F.col("_x") - F.col("sx")) * (F.col("_x") - F.col("sx")) + (F.col("_y") - F.col("sy")) * (F.col("_y") - F.col("sy"))
    return there.join(listed, ["_tx", "_ty"]).filter(far <= radius * radius).groupBy(*key).agg(F.avg("_v").alias(f"{value}_near"), F.count(F.lit(1)).alias("cells_near"))


def collocation_scores(pairs: DataFrame, by, thresholds, fc: str = "fc", near: str = "fc_near", obs: str = "obs") -> DataFrame:
    """JN27: bias (also of the near mean), MAE, correlation, contingency at every threshold and quantiles of the error, per group."""
    from .sampling import grouped_quantiles
    by = list(by)
    d = pairs.withColumn("_e", F.col(fc) - F.col(obs))
    f, o = F.col(fc), F.col(obs)
    counts = []
    for i, t in enumerate(thresholds):
        counts += [F.count_if((f >= t) & (o >= t)).alias(f"hits_{i}"), F.count_if((f < t) & (o >= t)).alias(f"misses_{i}"), F.count_if((f >= t) & (o < t)).alias(f"false_alarms_{i}")]
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("bias"), F.avg(F.col(near) - o).alias("near_bias"), F.avg(F.abs("_e")).alias("mae"), F.corr(fc, obs).alias("r"), *counts)
    q = grouped_quantiles(d, by, "_e", {"q10": 0.1, "median_bias": 0.5, "q90": 0.9}).drop("n")
    return g.join(q, by)


def collocate(stations: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """JN27: station (sx, sy) to the grid cell that holds it, by equi-join on the cell number."""
    at = stations.withColumn("cx", F.floor((F.col("sx") - x0) / dx)).withColumn("cy", F.floor((F.col("sy") - y0) / dy))
    return at.join(cells, ["cx", "cy"])
