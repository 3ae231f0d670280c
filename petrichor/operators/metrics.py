"""Forecast verification. Numerators and denominators are summed first; ratios come last.

Ensemble rows hold ``m`` (ARRAY<DOUBLE> members) and ``y``; deterministic rows ``f`` and ``o``; probability rows
``p``, ``w`` (0/1) and weight ``omega``. A ratio with denominator zero is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import members as M
from ..session import cut_lineage, small_side
from .grid import neighbourhood_sum
from .ordered import hashed_index
from .sampling import grouped_quantiles


def ratio(a, b) -> Column:
    return F.when(b != 0, a / b)


def continuous_errors(df: DataFrame, by) -> DataFrame:
    """ME01: absolute error on the lower median; RMSE, bias and total on the ensemble mean."""
    e = M.mean(F.col("m")) - F.col("y")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(M.lower_median(F.col("m")) - F.col("y"))).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.sum(M.mean(F.col("m"))).alias("total"))


def contingency(df: DataFrame, by, thresholds, min_blocks: dict[float, int] | None = None, block: str | None = None) -> DataFrame:
    """ME02: one pass of conditional counts; the table is unfolded after aggregation, not before."""
    by = list(by)
    aggs, tops = [], []
    for i, t in enumerate(thresholds):
        f, o = F.col("f") >= t, F.col("o") >= t
        aggs += [F.count_if(f & o).alias(f"h{i}"), F.count_if(~f & o).alias(f"m{i}"), F.count_if(f & ~o).alias(f"a{i}"), F.count_if(~f & ~o).alias(f"c{i}")]
        tops += [F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "hmac"]
        tops.append(F.count_if(F.col(f"h{i}") + F.col(f"m{i}") > 0).alias(f"b{i}"))
    # blocks with an event come from a second level over (cell, block) counts, so no row is expanded for a distinct
    g = df.groupBy(*by, block).agg(*aggs).groupBy(*by).agg(*tops) if block else df.groupBy(*by).agg(*aggs)
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("misses"),
                      F.col(f"a{i}").alias("false_alarms"), F.col(f"c{i}").alias("negatives"),
                      (F.col(f"b{i}") if block else F.lit(None).cast("long")).alias("event_blocks"),
                      F.lit((min_blocks or {}).get(t, 0)).alias("_need")) for i, t in enumerate(thresholds)]
    d = g.select(*by, F.inline(F.array(*parts)))
    if block:
        d = d.filter(F.col("event_blocks") >= F.col("_need"))
    h, m, a = F.col("hits"), F.col("misses"), F.col("false_alarms")
    n = h + m + a + F.col("negatives")
    chance = (h + m) * (h + a) / n
    return d.select(*by, "threshold", "hits", "misses", "false_alarms", "negatives", "event_blocks",
                    ratio(h, h + m + a).alias("csi"), ratio(h, h + m).alias("pod"), ratio(a, h + a).alias("far"),
                    ratio(h + a, h + m).alias("freq_bias"), ratio(h - chance, h + m + a - chance).alias("ets"))


def fss(dense: DataFrame, by, pool, threshold: float, length: int, min_valid: float = 0.8) -> DataFrame:
    """ME03: dense fields (by, y, x, f, o, valid); fractions share the valid count of their window."""
    ok = F.col("valid")

    def hit(c):
        return (ok & (F.col(c) >= threshold)).cast("long")
    d = neighbourhood_sum(dense, by, length, {"nf": hit("f"), "no": hit("o"), "nv": ok.cast("long")})
    fr, ob = F.col("nf") / F.col("nv"), F.col("no") / F.col("nv")
    d = d.filter((F.col("nv") > 0) & (F.col("nv") >= min_valid * length * length))
    return d.groupBy(*pool).agg(F.count(F.lit(1)).alias("windows"), F.sum((fr - ob) * (fr - ob)).alias("_n"), F.sum(fr * fr + ob * ob).alias("_d")).select(
        *pool, "windows", F.when(F.col("_d") != 0, 1 - F.col("_n") / F.col("_d")).alias("fss"))


def crps(df: DataFrame, by) -> DataFrame:
    """ME04 averaged."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(M.fair_crps(F.col("m"), F.col("y"))).alias("crps"))


def neighbourhood_crps(dense: DataFrame, by, pool, members: list[str], obs: str, length: int, min_valid: float = 0.8) -> DataFrame:
    """ME05: members and observation averaged over the same window, then scored; members stay columns."""
    ok = F.col("valid")
    vals = {f"s_{c}": F.when(ok, F.col(c)).otherwise(0.0) for c in [*members, obs]}
    d = neighbourhood_sum(dense, by, length, {**vals, "nv": ok.cast("long")}).filter(
        (F.col("nv") > 0) & (F.col("nv") >= min_valid * length * length))
    d = d.select(*by, *[c for c in pool if c not in by], F.array(*[F.col(f"s_{c}") / F.col("nv") for c in members]).alias("m"), (F.col(f"s_{obs}") / F.col("nv")).alias("y"))
    return crps(d, pool)


def skill(model: DataFrame, reference: DataFrame, on, score: str) -> DataFrame:
    """ME06 / ME08: 1 - model / reference."""
    r = reference.select(*on, F.col(score).alias("_r"))
    return model.join(r, list(on)).select(*on, F.col(score).alias("model"), F.col("_r").alias("reference"), (1 - ratio(F.col(score), F.col("_r"))).alias("skill"))


def climatology(train: DataFrame, pixel: str, pool: str, min_samples: int = 1000, by=("lead", "season")) -> DataFrame:
    """ME07: frequency per pixel with fallback to the pooled cell, then the domain, by sample count.

    The coarser levels are sums of the finest one, so raw rows are aggregated once.
    """
    by = list(by)
    fine = train.groupBy(*by, pixel, pool).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("k"))
    mid = fine.groupBy(*by, pool).agg(F.sum("n").alias("n1"), F.sum("k").alias("k1"))
    top = fine.groupBy(*by).agg(F.sum("n").alias("n2"), F.sum("k").alias("k2"))
    d = fine.join(mid, [*by, pool]).join(top, by)
    level = F.when(F.col("n") >= min_samples, "pixel").when(F.col("n1") >= min_samples, "pool").otherwise("domain")
    freq = (F.when(F.col("n") >= min_samples, F.col("k") / F.col("n")).when(F.col("n1") >= min_samples, F.col("k1") / F.col("n1"))
            .otherwise(F.col("k2") / F.col("n2")))
    return d.select(*by, pixel, level.alias("level"), freq.alias("freq"))


def empirical_climatology(train: DataFrame, pixel: str, pool: str, value: str, key: Column, k: int = 256, min_samples: int = 1000,
                          by=("lead", "season"), seed: int = 11107) -> DataFrame:
    """ME07: a sample of at most ``k`` values per (by, pixel), from the pixel, else the pooled cell, else the domain, by the number of values.

    A sample is the ``k`` values whose rows have the smallest hash of ``key``, all of them where there are fewer. Such samples
    merge: a pool's is that of its pixels' samples together, so raw rows are read once, and tasks pass on ``k`` rows a group
    at most. Null values take no part.
    """
    by = list(by)

    def lowest(d: DataFrame, keys: list[str]) -> DataFrame:
        first = W.partitionBy(*keys).orderBy("_u", "_v")
        return d.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r")
    rows = train.filter(F.col(value).isNotNull()).select(*by, pixel, pool, H.hash_uniform(seed, "climatology", key).alias("_u"), F.col(value).cast("double").alias("_v"))
    fine = cut_lineage(lowest(rows, [*by, pixel, pool]))
    mid = cut_lineage(lowest(fine, [*by, pool]))
    top = lowest(mid, by)
    n = rows.groupBy(*by, pixel, pool).agg(F.count(F.lit(1)).alias("n"))
    n1 = n.groupBy(*by, pool).agg(F.sum("n").alias("n1"))

    def listed(d: DataFrame, keys: list[str], name: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias(name))
    s = (n.join(n1, [*by, pool]).join(listed(fine, [*by, pixel, pool], "_a"), [*by, pixel, pool])
         .join(listed(mid, [*by, pool], "_b"), [*by, pool]).join(listed(top, by, "_c"), by))
    own, pooled = F.col("n") >= min_samples, F.col("n1") >= min_samples
    return s.select(*by, pixel, F.when(own, "pixel").when(pooled, "pool").otherwise("domain").alias("level"),
                    F.when(own, F.col("_a")).when(pooled, F.col("_b")).otherwise(F.col("_c")).alias("sample"))


def empirical_crps(sample: Column, y: Column) -> Column:
    """CRPS of the empirical distribution of a sorted ``sample``: mean distance to ``y`` less half the mean distance of two values."""
    n = F.size(sample)
    err = M.total(F.transform(sample, lambda x: F.abs(x - y))) / n
    return F.when(n > 0, err - M.total(F.transform(sample, lambda x, i: (2 * i - n + 1) * x)) / (n * n))


def climatology_crps(df: DataFrame, clim: DataFrame, cell, by, y: str = "y") -> DataFrame:
    """ME06 reference: mean CRPS of ``df`` (cell, y) under the climatology of its cell; a row without one is left out of the mean."""
    cell = list(cell)
    return df.join(clim.select(*cell, "sample"), cell, "left").groupBy(*by).agg(F.avg(empirical_crps(F.col("sample"), F.col(y))).alias("crps"))


def brier(df: DataFrame, by, p: str = "p") -> DataFrame:
    e = F.col(p) - F.col("w")
    return df.groupBy(*by).agg((F.sum(F.col("omega") * e * e) / F.sum("omega")).alias("brier"))


def climatology_brier(df: DataFrame, clim: DataFrame, cell, by) -> DataFrame:
    """ME08 reference: with a 0/1 outcome the squared error of a cell follows from two sums, so rows shrink to cells
    before they meet the climatology."""
    cell = list(cell)
    sums = df.groupBy(*cell).agg(F.sum("omega").alias("_o"), F.sum(F.col("omega") * F.col("w")).alias("_k"))
    f = F.col("freq")
    return sums.join(clim.select(*cell, "freq"), cell).groupBy(*by).agg(
        (F.sum(f * f * F.col("_o") - 2 * f * F.col("_k") + F.col("_k")) / F.sum("_o")).alias("brier"))


def reliability(df: DataFrame, by, block: str, bins: int = 20, min_blocks: int = 20) -> DataFrame:
    """ME09: equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    blocks = F.count_distinct(block)
    return df.groupBy(*by, b.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("w").alias("frequency"), F.count(F.lit(1)).alias("n"),
                                               blocks.alias("blocks"), (blocks < min_blocks).alias("sparse"))


def occurrence_gap(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """ME10: signed and absolute mean of q - p over several groupings; one pass to the finest cells first."""
    dims = sorted({c for s in sets for c in s})
    g = F.col("q") - F.col("p")
    cells = df.groupBy(*dims).agg(F.sum(g).alias("s"), F.sum(F.abs(g)).alias("a"), F.count(F.lit(1)).alias("n"))
    out = cells.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.grouping_id(*dims).alias("level"), (F.sum("s") / F.sum("n")).alias("gap"), (F.sum("a") / F.sum("n")).alias("abs_gap"), F.sum("n").alias("n"))
    return out


def spread_skill(df: DataFrame, by) -> DataFrame:
    """ME11: second moments are pooled before the root."""
    e = M.mean(F.col("m")) - F.col("y")
    n = F.size("m")
    return df.groupBy(*by).agg(F.sqrt(F.avg((1 + 1 / n) * M.sample_variance(F.col("m")))).alias("spread"), F.sqrt(F.avg(e * e)).alias("rmse"),
                               F.count(F.lit(1)).alias("n"))


def rank_histogram(df: DataFrame, by, seed: int, key: Column) -> DataFrame:
    """ME12: rank of the observation; ties are split by a hash of the row's key."""
    y = F.col("y")
    below = F.size(F.filter("m", lambda x: x < y))
    ties = F.size(F.filter("m", lambda x: x == y))
    rank = below + F.floor(H.hash_uniform(seed, "rank", key) * (ties + 1))
    return df.groupBy(*by, rank.cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def dispersion(spread: DataFrame, ranks: DataFrame, by, members: int | str, eps: float = 1e-12) -> DataFrame:
    """ME13: log ratio of spread to error, and the reliability index; empty ranks count as zero frequency.

    ``members`` is the size of the ensemble, or the column of ``spread`` that has it.
    """
    by = list(by)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("_t"))
    sized = spread.select(*by, (F.col(members) if isinstance(members, str) else F.lit(members)).cast("double").alias("_m"))
    j = ranks.join(total, by).join(sized, by)
    expect, size = 1.0 / (F.col("_m") + 1), F.max("_m")
    ri = j.groupBy(*by).agg((F.sum(F.abs(F.col("n") / F.col("_t") - expect)) + (size + 1 - F.count(F.lit(1))) / (size + 1)).alias("ri"))
    essr = F.abs(F.ln(F.greatest(F.col("spread"), F.lit(eps)) / F.greatest(F.col("rmse"), F.lit(eps))))
    return spread.select(*by, essr.alias("e_ssr")).join(ri, by)


def tail(df: DataFrame, by, threshold: float) -> DataFrame:
    """ME14: exceedance frequency of members (member-wise mean) and observation."""
    fp = F.avg(M.exceed_fraction(F.col("m"), threshold))
    fo = F.avg((F.col("y") >= threshold).cast("double"))
    return df.groupBy(*by).agg(fp.alias("f_pred"), fo.alias("f_obs"), F.abs(fp - fo).alias("e_freq"))


def wet_histogram(df: DataFrame, by, edges, obs: str = "y", members: str = "m") -> DataFrame:
    """ME14: counts of wet values only, observed and of all members, in bins [edge, next edge), the last one open; empty bins stay.

    A value below the first edge isn't wet. Counts are sums of one row each, so parts merge by adding them.
    """
    edges = [float(e) for e in edges]
    parts = list(zip(edges, [*edges[1:], float("inf")]))

    def inside(v, low, high):
        return (v >= low) & (v < F.lit(high)) if high != float("inf") else (v >= low) & ~F.isnan(v)
    seen = F.array(*[F.count_if(inside(F.col(obs), a, b)) for a, b in parts])

    def drawn_in(low, high):
        return F.sum(F.size(F.filter(members, lambda v: inside(v, low, high))).cast("long"))
    drawn = F.array(*[drawn_in(a, b) for a, b in parts])
    g = df.groupBy(*by).agg(F.arrays_zip(F.array(*[F.lit(e) for e in edges]).alias("edge"), seen.alias("observed"), drawn.alias("members")).alias("h"))
    return g.select(*by, F.posexplode("h").alias("bin", "h")).select(*by, "bin", "h.edge", "h.observed", "h.members")


def oof_shift(pairs: DataFrame, by) -> DataFrame:
    """ME15: rows (p_full, p_fold, mu_full, mu_fold, z): shifts, their quantiles, residual RMS ratio."""
    by = list(by)
    d = pairs.withColumn("dp", F.col("p_full") - F.col("p_fold")).withColumn("dmu", F.col("mu_full") - F.col("mu_fold"))
    rf, ro = F.col("z") - F.col("mu_full"), F.col("z") - F.col("mu_fold")
    g = d.groupBy(*by).agg(F.avg("dp").alias("mean_dp"), F.avg("dmu").alias("mean_dmu"),
                           F.sqrt(F.avg(rf * rf) / F.avg(ro * ro)).alias("rms_ratio"))
    q1 = grouped_quantiles(d, by, "dp", {"dp_q05": 0.05, "dp_q95": 0.95}).drop("n")
    q2 = grouped_quantiles(d, by, "dmu", {"dmu_q05": 0.05, "dmu_q95": 0.95}).drop("n")
    return g.join(q1, by).join(q2, by)


def location_diagnostics(df: DataFrame, by, z_wet: float) -> DataFrame:
    """ME16: rows (m = mu + c*r0 per member, b, d, s_oof, wet, w): support ratio, flips, dry band and leak mass."""
    shift = F.col("b") + F.col("d")
    n = F.size("m")
    flips = F.size(F.filter("m", lambda z: (z >= z_wet) != (z + shift >= z_wet)))
    band = F.size(F.filter("m", lambda z: (z + shift > 0) & (z + shift < z_wet)))
    leak = F.size(F.filter("m", lambda z: z + shift >= z_wet))
    dry = (~F.col("wet")).cast("double") * F.col("w")
    return df.groupBy(*by).agg(
        F.max(F.abs(shift) / z_wet).alias("support_ratio"), (F.sum(F.col("w") * flips) / F.sum(F.col("w") * n)).alias("flip_fraction"),
        ratio(F.sum(dry * band), F.sum(dry * n)).alias("dry_band_mass"), ratio(F.sum(dry * leak), F.sum(dry * n)).alias("dry_leak_mass"),
        F.max(z_wet / F.col("s_oof")).alias("leak_sensitivity"))


def variance_ratios(df: DataFrame, by) -> DataFrame:
    """ME17."""
    r = F.col("z") - F.col("mu")
    return df.groupBy(*by).agg(ratio(F.var_pop(r), F.var_pop("z")).alias("residual_ratio"), (1 - ratio(F.avg(r * r), F.var_pop("z"))).alias("explained"))


def mask_distance_audit(df: DataFrame, by=()) -> DataFrame:
    """ME18: rows with distance_bin, f, o."""
    e = F.col("f") - F.col("o")
    return df.filter("distance_bin <> '0'").groupBy(*by, "distance_bin").agg(F.avg(e * e).alias("mse"), F.avg(e).alias("bias"), F.count(F.lit(1)).alias("n"))


def expected_total(df: DataFrame, by) -> DataFrame:
    """ME19: sum over leads of the ensemble mean."""
    return df.groupBy(*by).agg(F.sum(M.mean(F.col("m"))).alias("total"))


def paired_arms(a: DataFrame, b: DataFrame, on, values) -> tuple[DataFrame, DataFrame]:
    """JN26: both arms on identical keys, and the keys only one arm has."""
    on = list(on)
    j = a.select(*on, *[F.col(v).alias(f"{v}_a") for v in values]).join(b.select(*on, *[F.col(v).alias(f"{v}_b") for v in values]), on)
    only_a = a.select(*on).join(b.select(*on), on, "left_anti").withColumn("only", F.lit("a"))
    only_b = b.select(*on).join(a.select(*on), on, "left_anti").withColumn("only", F.lit("b"))
    return j, only_a.unionByName(only_b)


def block_bootstrap(contrib: DataFrame, values, replicates: int = 2000, seed: int = 11101, stratum: str = "stratum",
                    block: str = "block_id") -> DataFrame:
    """ME20: sums of ``values`` per replicate after drawing whole blocks inside each stratum.

    One row per (stratum, block) holds the contributions of every arm, so all arms share the same draw. Every block
    stands for one slot of each replicate as well: it unfolds to the replicates, whose number is a parameter, and never
    a replicate to all blocks. Equal draws fold to a multiplicity before the join.
    """
    values = list(values)
    # the raw rows are read once: everything below starts from one row per block
    per = cut_lineage(contrib.groupBy(stratum, block).agg(*[F.sum(v).alias(v) for v in values]))
    idx = hashed_index(per.withColumn("_h", F.sha2(F.col(block).cast("string"), 256)), "_h", block, "_i", [stratum])
    idx = cut_lineage(idx)
    sizes = small_side(idx.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")))
    draws = idx.select(stratum, F.col("_i").alias("_slot")).join(sizes, stratum).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    u = H.hash_uniform(seed, "bootstrap", F.concat_ws("|", "replicate", stratum, "_slot"))
    pick = F.coalesce(F.floor(u * F.col("_n")), F.lit(0))
    picks = draws.withColumn("_i", pick).groupBy("replicate", stratum, "_i").agg(F.count(F.lit(1)).alias("_k"))
    return picks.join(idx, [stratum, "_i"]).groupBy("replicate").agg(*[F.sum(F.col("_k") * F.col(v)).alias(v) for v in values])


def interval(replicates: DataFrame, statistic: Column, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over replicates (their number is the parameter of the bootstrap, so it is bounded)."""
    return replicates.select(statistic.alias("s")).agg(F.percentile("s", F.lit(low)).alias("low"), F.percentile("s", F.lit(0.5)).alias("mid"),
                                                       F.percentile("s", F.lit(high)).alias("high"))


def band_score(scores: DataFrame, by, value: str) -> DataFrame:
    """ME21: leads weigh equally; ``scores`` holds one finished statistic per lead."""
    return scores.groupBy(*by).agg(F.avg(value).alias("band_score"), F.count(F.lit(1)).alias("leads"))


def seed_stability(scores: DataFrame, reference: str) -> DataFrame:
    """ME22: scores (arm, seed, score): spread per arm, pooled sigma, paired differences, practical tie."""
    ref = scores.filter(F.col("arm") == reference).select("seed", F.col("score").alias("_ref"))
    other = scores.filter(F.col("arm") != reference).join(ref, "seed")
    d = F.col("score") - F.col("_ref")
    s = other.groupBy("arm").agg(F.stddev_samp("score").alias("s_cand"), F.stddev_samp("_ref").alias("s_ref"), F.stddev_samp(d).alias("delta_sd"), F.avg(d).alias("delta"))
    sigma = F.sqrt((F.col("s_cand") * F.col("s_cand") + F.col("s_ref") * F.col("s_ref")) / 2)
    return s.withColumn("sigma", sigma).withColumn("tie", F.abs("delta") < F.col("sigma"))


# fixed values: absolute gate by lead band (hours), baseline and metric; sides as in ``gate``
BAND_RULES = (
    ("0.5-1.0", "persistence", "crps_relative", "upper_below", 0.02), ("0.5-1.0", "persistence", "fss_difference", "lower_above", -0.01),
    ("0.5-1.0", "pysteps", "crps_relative", "upper_below", 0.02), ("0.5-1.0", "pysteps", "fss_difference", "lower_above", -0.01),
    ("1.5-2.0", "persistence", "crps_gain", "lower_over", 0.0), ("1.5-2.0", "persistence", "fss_difference", "lower_over", 0.0),
    ("1.5-2.0", "pysteps", "crps_gain", "lower_over", 0.0), ("1.5-2.0", "pysteps", "fss_difference", "lower_over", 0.0),
    ("2.5-4.0", "radar_only", "crps_gain", "lower_over", 0.0), ("2.5-4.0", "radar_only", "bss_difference", "lower_over", 0.0),
    ("4.5-6.0", "coarse_tp", "crps_gain", "lower_over", 0.0), ("4.5-6.0", "radar_only", "crps_gain", "lower_over", 0.0),
    ("all", "climatology", "bss", "lower_over", 0.0),
)
# fixed values: an arm that breaks either isn't trained further
CULL_RULES = (("E1", "upper_below", 0.05), ("E2", "lower_above", -0.02))


def band_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(BAND_RULES), "band string, baseline string, metric string, side string, bound double")


def cull_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(CULL_RULES), "metric string, side string, bound double")


def gate(intervals: DataFrame, rules: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """ME23: intervals (arm, baseline, metric, low, high) against rules (metric, side, bound); AND over all.

    Rules may name a ``band`` and a ``baseline`` of their own; intervals then have these columns too. Rules without baseline hold
    for every baseline of an arm: those in ``pairs`` (arm, baseline) if given, else those that it has intervals for. Sides:
    ``upper_below`` (high <= bound), ``lower_above`` (low >= bound), ``lower_over`` (low > bound), any other is never met.

    Fails closed: a rule whose interval is missing, or whose interval or bound is null or NaN, is a failed rule, and so is every
    arm where there are no rules. ``failed`` counts rules over the arm's baselines.
    """
    def at_most(a, b):  # NaN counts as the largest number, so it is refused by name
        return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a <= b), F.lit(False))
    ok = F.when(F.col("side") == "upper_below", at_most(F.col("high"), F.col("bound"))).when(
        F.col("side") == "lower_above", at_most(F.col("bound"), F.col("low"))).when(
        F.col("side") == "lower_over", at_most(F.col("bound"), F.col("low")) & (F.col("bound") != F.col("low"))).otherwise(F.lit(False))
    on = [c for c in ("band", "baseline", "metric") if c in rules.columns]
    unit = ["arm"] if "baseline" in on else ["arm", "baseline"]
    met = (intervals.join(rules, on).groupBy(*dict.fromkeys([*unit, *on, "side"])).agg(F.bool_and(ok).alias("ok"))
           .groupBy(*unit).agg(F.count_if("ok").alias("_met")))
    asked = rules.select(*on, "side").distinct().agg(F.count(F.lit(1)).alias("_asked"))  # one row
    every = (intervals if pairs is None else pairs).select(*unit).distinct().join(met, unit, "left").join(F.broadcast(asked))
    short = F.col("_asked") - F.coalesce("_met", F.lit(0))
    return every.groupBy("arm").agg(((F.max(short) == 0) & (F.max("_asked") > 0)).alias("passed"), F.sum(short).alias("failed"))


def finalists(scores: DataFrame, k: int, always: list[str]) -> DataFrame:
    """SO06: k best passing arms by score, and the named arms in any case (one row per arm)."""
    named = F.col("arm").isin(*always)
    best = scores.filter(F.col("passed")).orderBy("score", "arm").limit(k)  # each task keeps k rows
    return best.filter(~named).unionByName(scores.filter(named))


def uncalibrated_mass(df: DataFrame, by, limit: float = 0.01) -> DataFrame:
    """ME24: weight share of fallback cells."""
    share = F.sum(F.when(F.col("terminal"), F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")
    return df.groupBy(*by).agg(share.alias("share"), (share > limit).alias("failed"))
