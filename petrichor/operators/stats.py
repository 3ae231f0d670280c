"""Mergeable moments, normalization, block support and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.values import clip
from ..session import small_side


def masked_moments(df: DataFrame, by, value: str = "v", valid: str = "valid") -> DataFrame:
    """AG09: population moments over valid values; built-in central moments merge partials stably.

    A group without a valid value stays, with n = 0 and null moments.
    """
    v = F.when(F.col(valid), F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"),
                               F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def moments_state(df: DataFrame, by, value: str = "v", valid: str = "valid") -> DataFrame:
    """UD04: partial state (n, mean, m2, min, max) that can be stored and merged later."""
    return masked_moments(df, by, value, valid).withColumn("m2", F.coalesce(F.col("variance") * F.col("n"), F.lit(0.0))).drop("variance", "sd")


def merge_moments(states: DataFrame, by) -> DataFrame:
    """AG10: combine stored states without raw rows.

    m2 is rebuilt from group means by one aggregate: the variance of the means, weighted by n, comes from
    deviations about a common shift to avoid cancellation. Empty states (n = 0) add nothing, and a group of only such
    states stays. The shift is one row a group, so the states aren't shuffled on a few group keys.
    """
    by = list(by)
    shift = small_side(states.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_g")))
    same = [F.col(f"_s.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in by]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = states.alias("_s").join(shift.alias("_t"), cond).select("_s.*", "_g")
    dev = F.col("mean") - F.col("_g")
    return (j.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_g").alias("mean"),
                               F.sum(F.col("m2") + F.coalesce(F.col("n") * dev * dev, F.lit(0.0))).alias("m2"),
                               F.min("min").alias("min"), F.max("max").alias("max"))
            .withColumn("variance", F.when(F.col("n") > 0, F.try_divide(F.col("m2"), F.col("n")))).withColumn("sd", F.sqrt("variance")))


def degenerate_channels(stats: DataFrame, by) -> DataFrame:
    """Channels that must not be used: nothing valid or no spread."""
    return stats.filter("n = 0 or sd = 0").select(*by)


def train_universe(items: DataFrame, horizon_minutes: int = 360) -> DataFrame:
    """AG11: distinct training issue times with the hours they may read (trajectory end, access closed later)."""
    t0 = items.filter("split = 'outer_train'").select("t0_utc").distinct()
    hours = t0.select("t0_utc", F.explode(T.native_hours(F.col("t0_utc"))).alias("valid_time"))
    return hours.filter(T.trajectory_mask(F.col("valid_time"), F.col("t0_utc"), horizon_minutes)).select("valid_time").distinct()


def fit_normalization(groups: dict[str, DataFrame]) -> DataFrame:
    """AG12: one statistics table over named groups of (channel, v, valid) rows."""
    out = None
    for name, df in groups.items():
        part = masked_moments(df, ["channel"]).withColumn("grp", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def zscore(df: DataFrame, stats: DataFrame, on, value="v", valid: Column | None = None) -> DataFrame:
    """PR30: exactly 0 where invalid or absent; presence and validity stay columns of their own."""
    s = small_side(stats.select(*on, F.col("mean").alias("_m"), F.col("sd").alias("_s")))
    ok = valid if valid is not None else F.lit(True)
    return df.join(s, list(on), "left").withColumn(
        "z", F.when(ok & F.col("_s").isNotNull(), F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).otherwise(F.lit(0.0))).drop("_m", "_s")


def zscore_named(df: DataFrame, stats: DataFrame, scaled, channel: str = "channel", value: str = "v") -> DataFrame:
    """PR31: only the named channels are scaled, the rest pass through."""
    s = small_side(stats.select(channel, F.col("mean").alias("_m"), F.col("sd").alias("_s")))
    return df.join(s, channel, "left").withColumn(
        "z", F.when(F.col(channel).isin(*scaled), (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.col(value))).drop("_m", "_s")


def weighted_moments(df: DataFrame, by, value: str, weight: str) -> DataFrame:
    """AG13: mean and population variance over positive weights, in two passes (the second about the mean)."""
    by = list(by)
    pos = df.filter(F.col(weight) > 0)
    mean = pos.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"))
    dev = F.col(value) - F.col("mean")
    mean = small_side(mean)
    j = pos.join(mean, by) if by else pos.join(mean)
    return j.groupBy(*by).agg(F.first("mean").alias("mean"),
                              (F.sum(F.col(weight) * dev * dev) / F.sum(weight)).alias("variance"), F.sum(weight).alias("mass"))


def block_masses(df: DataFrame, by, block: str, weight: str, positive: Column | None = None) -> DataFrame:
    """Rows to one row per (cell, block); everything about support is read from here."""
    w = F.col(weight)
    aggs = [F.sum(w).alias("mass")]
    if positive is not None:
        aggs += [F.max(((w > 0) & positive).cast("int")).alias("pos"), F.max(((w > 0) & ~positive).cast("int")).alias("neg")]
    return df.groupBy(*by, block).agg(*aggs)


def block_support(masses: DataFrame, by) -> DataFrame:
    """AG14: blocks, effective number of blocks, blocks with a positive / negative label."""
    live = F.when(F.col("mass") > 0, F.col("mass"))
    aggs = [F.count(live).alias("blocks"),
            F.coalesce(F.sum(live) * F.sum(live) / F.sum(live * live), F.lit(0.0)).alias("ess")]
    if "pos" in masses.columns:
        aggs += [F.sum("pos").alias("pos_blocks"), F.sum("neg").alias("neg_blocks")]
    return masses.groupBy(*by).agg(*aggs)


def coarsen_grid(grid: DataFrame, by: int, bx: int) -> DataFrame:
    """AG27: block cells with footprint, centre and area-weighted valid fraction.

    ``grid`` has y, x, cell edges (y_lo, y_hi, x_lo, x_hi) and valid.
    """
    area = (F.col("y_hi") - F.col("y_lo")) * (F.col("x_hi") - F.col("x_lo"))
    g = grid.groupBy(F.floor(F.col("y") / by).alias("cy"), F.floor(F.col("x") / bx).alias("cx")).agg(
        F.min("y_lo").alias("_a"), F.max("y_hi").alias("_b"), F.min("x_lo").alias("_c"), F.max("x_hi").alias("_d"),
        (F.sum(F.when(F.col("valid"), area).otherwise(0.0)) / F.sum(area)).alias("valid_fraction"))
    return g.select("cy", "cx", (F.col("_b") - F.col("_a")).alias("height"), (F.col("_d") - F.col("_c")).alias("width"),
                    ((F.col("_a") + F.col("_b")) / 2).alias("centre_y"), ((F.col("_c") + F.col("_d")) / 2).alias("centre_x"),
                    "valid_fraction")


def hurdle_scores(preds: DataFrame, by, lam: float = 1.0) -> DataFrame:
    """AG24: preds (p, m, obs, w): weighted occurrence loss, wet-only amount error, mean error.

    Numerators and denominators are sums, so partials over any partitioning add up; empty denominators are 1.
    """
    w, y = F.col("w"), F.col("obs")
    p = clip(F.col("p"), 1e-6, 1 - 1e-6)
    wet = (y > 0).cast("double")
    z = F.log1p(y)
    bce = -(wet * F.ln(p) + (1 - wet) * F.log1p(-p))
    amount, mean = F.col("m") - z, F.col("p") * F.col("m") - z
    g = preds.groupBy(*by).agg(F.sum(w * bce).alias("_b"), F.sum(w * wet * amount * amount).alias("_a"),
                               F.sum(w * mean * mean).alias("_m"), F.sum(w).alias("mass"), F.sum(w * wet).alias("wet_mass"))
    d, dw = F.greatest(F.col("mass"), F.lit(1.0)), F.greatest(F.col("wet_mass"), F.lit(1.0))
    return (g.withColumn("occurrence", F.col("_b") / d).withColumn("amount", F.col("_a") / dw).withColumn("mean_error", F.col("_m") / d)
            .withColumn("loss", F.col("occurrence") + F.col("amount") + lam * F.col("mean_error")).drop("_b", "_a", "_m"))


def direct_scores(preds: DataFrame, by, q: float) -> DataFrame:
    """AG25: weighted squared error and pinball loss of a direct prediction."""
    e = F.col("obs") - F.col("pred")
    return preds.groupBy(*by).agg((F.sum(F.col("w") * e * e) / F.sum("w")).alias("mse"),
                                  (F.sum(F.col("w") * F.greatest(q * e, (q - 1) * e)) / F.sum("w")).alias("pinball"))


def timeline_shares(items: DataFrame) -> DataFrame:
    """AG30: season shares by split with subtotals."""
    cells = items.groupBy("split", "season", "block_id").agg(F.count(F.lit(1)).alias("_n"))  # rows shrink before they are expanded
    return cells.rollup("split", "season").agg(F.sum("_n").alias("n"), F.count_distinct("block_id").alias("blocks"))


def block_concentration(items: DataFrame) -> DataFrame:
    """AG30: share of the largest block and the effective number of blocks."""
    per = items.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("blocks"), (F.max("n") / F.sum("n")).alias("largest_share"),
                   (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_blocks"))


def validity_report(pixels: DataFrame, by, limit: float) -> tuple[DataFrame, DataFrame]:
    """AG31: invalid fraction per item, and items to drop (only in the training split)."""
    per = pixels.groupBy(*by).agg(F.avg((~F.col("valid")).cast("double")).alias("invalid_fraction"))
    return per, per.filter((F.col("invalid_fraction") > limit) & (F.col("split") == "outer_train"))


def rollup_report(scores: DataFrame, dims, numerator: str, denominator: str) -> DataFrame:
    """AG32: every combination with subtotals; sums first, ratio last. ``level`` tells a subtotal from a null key."""
    return scores.cube(*dims).agg(F.grouping_id().alias("level"), F.sum(numerator).alias("num"), F.sum(denominator).alias("den")
                                  ).withColumn("ratio", F.when(F.col("den") != 0, F.col("num") / F.col("den")))
