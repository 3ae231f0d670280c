"""Pooling ladder, residual scales, location/scale/spread and probability fits, record lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import members as M
from ..functions import signature as SG
from ..functions.values import clip
from ..session import cut_lineage, small_side
from .manifest import union_all, violation

# fixed values: ladder levels, finest first, and the support gate
LEVELS = ("full_cell", "lead_provider_era_present", "lead_provider", "lead_only")
MIN_BLOCKS, MIN_ESS, MIN_LABEL_BLOCKS = 30, 20.0, 20


def _ladder_keys(sig):
    keys = (sig, SG.provider_era(sig), SG.provider(sig), F.lit("*"))
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("level"), k.alias("key"))
                     for i, (n, k) in enumerate(zip(LEVELS, keys))])


def ladder_blocks(masses: DataFrame, sums=("mass",), maxima=()) -> DataFrame:
    """Expand exact (lead, signature, block) rows to the four nested levels.

    The input is already one row per cell and block, so the fourfold expansion touches small rows only.
    """
    d = masses.withColumn("_k", F.explode(_ladder_keys(F.col("condition_signature"))))
    return d.groupBy("lead", F.col("_k.rank").alias("rank"), F.col("_k.level").alias("level"), F.col("_k.key").alias("key"), "block_id").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def ladder_support(blocks: DataFrame, sums=()) -> DataFrame:
    live = F.when(F.col("mass") > 0, F.col("mass"))
    extra = [F.sum(c).alias(c) for c in sums]
    if "pos" in blocks.columns:
        extra += [F.sum("pos").alias("pos_blocks"), F.sum("neg").alias("neg_blocks")]
    return blocks.groupBy("lead", "rank", "level", "key").agg(
        F.count(live).alias("blocks"), F.coalesce(F.sum(live) * F.sum(live) / F.sum(live * live), F.lit(0.0)).alias("ess"), *extra)


def select_level(cells: DataFrame, support: DataFrame, keep=(), min_blocks=MIN_BLOCKS, min_ess=MIN_ESS,
                 min_labels: int | None = None) -> DataFrame:
    """AG15: first passing level of each exact (lead, signature) cell; null level = terminal."""
    ok = (F.col("blocks") >= min_blocks) & (F.col("ess") >= min_ess)
    if min_labels is not None:
        ok = ok & (F.col("pos_blocks") >= min_labels) & (F.col("neg_blocks") >= min_labels)
    keyed = cells.select("lead", "condition_signature", F.explode(_ladder_keys(F.col("condition_signature"))).alias("_k")).select(
        "lead", "condition_signature", F.col("_k.level").alias("level"), F.col("_k.key").alias("key"))
    j = keyed.join(support, ["lead", "level", "key"])
    pick = F.min(F.when(ok, F.struct("rank", "level", "key", "blocks", "ess", *keep)))
    g = j.groupBy("lead", "condition_signature").agg(pick.alias("_p"))
    return g.select("lead", "condition_signature", *[F.col(f"_p.{c}").alias(c) for c in ("level", "key", "blocks", "ess", *keep)],
                    F.col("_p").isNull().alias("terminal"))


def pooling_ladder(masses: DataFrame, min_blocks=MIN_BLOCKS, min_ess=MIN_ESS, min_labels: int | None = None) -> DataFrame:
    maxima = ("pos", "neg") if "pos" in masses.columns else ()
    support = ladder_support(ladder_blocks(masses, ("mass",), maxima))
    return select_level(masses.select("lead", "condition_signature").distinct(), support, (), min_blocks, min_ess, min_labels)


# --- residual scales ----------------------------------------------------------------------------------
def residual_blocks(rows: DataFrame) -> DataFrame:
    """AG16 state: rows (lead, condition_signature, block_id, z, mu, valid, omega) to exact cell x block sums."""
    r = F.col("z") - F.col("mu")
    return rows.filter("valid").groupBy("lead", "condition_signature", "block_id").agg(
        F.sum("omega").alias("mass"), F.sum(F.col("omega") * r * r).alias("sq"), F.count(F.lit(1)).alias("pixels"))


def merge_scale_states(states: DataFrame) -> DataFrame:
    """AG17: partial states add up by cell and block."""
    return states.groupBy("lead", "condition_signature", "block_id").agg(
        F.sum("mass").alias("mass"), F.sum("sq").alias("sq"), F.sum("pixels").alias("pixels"))


def residual_scales(states: DataFrame, floor: float = 1e-3, min_blocks=MIN_BLOCKS, min_ess=MIN_ESS) -> DataFrame:
    """Weighted RMS from the first passing level; no level = null scale, flagged, never an identity."""
    sums = ("mass", "sq", "pixels")
    states = cut_lineage(states)  # read three times below: the raw rows are scanned once
    support = ladder_support(ladder_blocks(states, sums), sums)
    cells = states.groupBy("lead", "condition_signature").agg(F.sum("pixels").alias("cell_pixels"))
    chosen = select_level(cells, support, ("mass", "sq", "pixels"), min_blocks, min_ess)
    # greatest() skips nulls, so the unsupported cell is kept null by hand
    scale = F.when(~F.col("terminal"), F.greatest(F.sqrt(F.col("sq") / F.col("mass")), F.lit(floor)))
    return (chosen.join(cells, ["lead", "condition_signature"])
            .select("lead", "condition_signature", "level", "blocks", "ess", "cell_pixels", scale.alias("scale"),
                    F.col("terminal").alias("unsupported")))


def scale_state_violations(states: DataFrame, totals: DataFrame) -> DataFrame:
    """VA05: counts and squares non-negative, block masses add up to the stated weight of the cell."""
    c = F.col
    per = states.groupBy("lead", "condition_signature").agg(F.sum("mass").alias("m"))
    j = per.join(totals, ["lead", "condition_signature"], "full_outer")
    key = F.concat_ws("|", "lead", "condition_signature")
    return union_all([
        violation(states.filter("pixels < 0 or sq < 0 or mass < 0"), "negative", F.concat_ws("|", "lead", "condition_signature", "block_id")),
        violation(j.filter(c("m").isNull() | c("weight").isNull()), "missing_cell", key),
        violation(j.filter(F.abs(c("m") - c("weight")) > 1e-9 * F.greatest(F.lit(1.0), c("weight"))), "mass", key),
    ])


# --- location, scale, spread -----------------------------------------------------------------------------
def fold_moments(rows: DataFrame, cell, fold: str, residual: str, weight: str) -> DataFrame:
    w, r = F.col(weight), F.col(residual)
    return rows.filter(w > 0).groupBy(*cell, fold).agg(F.sum(w).alias("mass"), (F.sum(w * r) / F.sum(w)).alias("mean"),
                                                       (F.sum(w * r * r) / F.sum(w)).alias("second"))


def fit_location_scale(folds: DataFrame, full: DataFrame, cell, eps: float = 1e-12) -> DataFrame:
    """AG18: c from full over mixture variance, b from the means; folds weigh by their out-of-fold mass.

    ``folds``: (cell, fold, mass, mean, second); ``full``: (cell, mean, variance) of the full model.
    """
    cell = list(cell)
    mix = folds.groupBy(*cell).agg(F.count(F.lit(1)).alias("folds"), (F.sum(F.col("mass") * F.col("mean")) / F.sum("mass")).alias("mix_mean"),
                                   (F.sum(F.col("mass") * F.col("second")) / F.sum("mass")).alias("mix_second"))
    var = F.greatest(F.col("mix_second") - F.col("mix_mean") * F.col("mix_mean"), F.lit(0.0))
    c = F.sqrt(F.col("variance") / F.greatest(F.col("mix_variance"), F.lit(eps)))
    return (mix.withColumn("mix_variance", var).join(full.select(*cell, "mean", "variance"), cell).filter("folds >= 2")
            .withColumn("c", c).withColumn("b", F.col("mean") - F.col("c") * F.col("mix_mean"))
            .select(*cell, "b", "c", "mix_mean", "mix_variance", F.col("mean").alias("full_mean"), F.col("variance").alias("full_variance")))


def fit_sampler(rows: DataFrame, records: DataFrame, cell, d_enabled: bool, eps: float = 1e-12) -> DataFrame:
    """AG19: rows (cell, m ARRAY, residual, w) with records (cell, b, c) to d, gamma and the bias fraction."""
    cell = list(cell)
    mean = M.mean(F.col("m"))
    d0 = rows.join(small_side(records.select(*cell, "b", "c")), cell).withColumn("e0", F.col("residual") - (F.col("b") + F.col("c") * mean))
    w = F.col("w")
    e = (d0.filter(w > 0).groupBy(*cell).agg((F.sum(w * F.col("e0")) / F.sum(w)).alias("mean_e0"),
                                            F.sqrt(F.sum(w * F.col("e0") * F.col("e0")) / F.sum(w)).alias("rmse")))
    bias = F.col("mean_e0") if d_enabled else F.lit(0.0)
    e = e.withColumn("d", bias).withColumn("bias_fraction", F.abs("mean_e0") / F.greatest(F.col("rmse"), F.lit(eps)))
    j = d0.join(small_side(e), cell)
    err = F.col("e0") - F.col("d")
    s2 = F.col("c") * F.col("c") * M.sample_variance(F.col("m"))
    return (j.groupBy(*cell).agg(F.first("d").alias("d"), F.first("bias_fraction").alias("bias_fraction"),
                                 F.sum(w * err * err).alias("_n"), F.sum(w * (1 + 1 / F.size("m")) * s2).alias("_s"))
            .select(*cell, "d", F.sqrt(F.col("_n") / F.greatest(F.col("_s"), F.lit(eps))).alias("gamma"), "bias_fraction"))


# --- probability -----------------------------------------------------------------------------------------
def fit_probability(rows: DataFrame, cell, supported: DataFrame | None = None, tol: float = 1e-10, gtol: float = 1e-11, min_slope: float = 1e-8, patience: int = 60) -> DataFrame:
    """IT03: weighted logistic fit on logit(p) for all cells at once; rows (cell, p, y, w).

    Equal forecasts of a cell are folded first (the sums are sufficient). Each Newton step is one aggregation
    to a handful of sums per cell and a closed 2x2 solve; the slope is held at its bound when it would pass it.
    A cell rests once its mean gradient vanishes (also one whose classes are separable, far out on the slope).
    The parameter table (one row per cell) is checkpointed each round. Rounds go on while the largest step still falls
    below its smallest value so far within ``patience`` rounds; otherwise the fit raises.

    Every cell of ``rows`` is in the result. Cells without support (not in ``supported``, if that is given), without any
    weight, with one class only or without spread get the identity (alpha 0, slope 1) and ``terminal`` true.
    """
    cell = list(cell)
    cells = cut_lineage(rows.select(*cell).distinct())
    q = clip(F.col("p"), 1e-6, 1 - 1e-6)
    folded = cut_lineage(rows.filter("w > 0").withColumn("_q", q).groupBy(*cell, "_q").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).withColumn("x", F.ln("_q") - F.log1p(-F.col("_q"))))
    rate = F.sum("wy") / F.sum("w")
    first = folded.groupBy(*cell).agg(rate.alias("_r"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("_m"))
    dev = F.col("x") - F.col("_m")  # the spread is taken about the mean: a difference of large squares would cancel
    start = folded.join(small_side(first), cell).groupBy(*cell).agg(F.first("_r").alias("_r"), (F.sum(F.col("w") * dev * dev) / F.sum("w")).alias("_v")).filter(
        "_r > 0 and _r < 1 and _v > 1e-12")
    if supported is not None:
        start = start.join(supported.select(*cell).distinct(), cell, "left_semi")
    r = clip(F.col("_r"), 1e-6, 1 - 1e-6)
    params = small_side(start.select(*cell, F.ln(r / (1 - r)).alias("alpha"), F.lit(1.0).alias("slope")))
    w, x = F.col("w"), F.col("x")
    least, waited = float("inf"), 0
    while True:
        f = 1 / (1 + F.exp(-(F.col("alpha") + F.col("slope") * x)))
        g0, h = w * F.col("_f") - F.col("wy"), w * F.col("_f") * (1 - F.col("_f"))
        s = (folded.join(params, cell).withColumn("_f", f).groupBy(*cell, "alpha", "slope").agg(
            F.sum(g0).alias("a"), F.sum(g0 * x).alias("b"), F.sum(h).alias("haa"), F.sum(h * x).alias("hab"), F.sum(h * x * x).alias("hbb"), F.sum("w").alias("mass")))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        rest = F.greatest(F.abs("a"), F.abs("b")) < gtol * F.col("mass")

        def step(top, bottom):
            return F.when(rest, F.lit(0.0)).otherwise(clip(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)), -4.0, 4.0))
        slope = F.greatest(F.lit(min_slope), F.col("slope") - step(F.col("haa") * F.col("b") - F.col("hab") * F.col("a"), det))
        free = slope > min_slope
        alpha = F.col("alpha") - F.when(free, step(F.col("hbb") * F.col("a") - F.col("hab") * F.col("b"), det)).otherwise(step(F.col("a"), F.col("haa")))
        nxt = small_side(s.select(*cell, alpha.alias("alpha"), slope.alias("slope"),
                                   F.greatest(F.abs(alpha - F.col("alpha")), F.abs(slope - F.col("slope"))).alias("_moved")))
        moved = nxt.agg(F.max("_moved")).first()[0]  # one number
        params = nxt.drop("_moved")
        if moved is None or moved < tol:
            break
        least, waited = (moved, 0) if moved < least else (least, waited + 1)
        if waited > patience:
            raise RuntimeError(f"probability fit does not settle: steps stay at {least}")
    beta = F.when(F.col("slope") > 30, F.col("slope")).otherwise(F.ln(F.expm1("slope")))
    return (cells.join(params.withColumn("_fit", F.lit(True)), cell, "left").withColumn("terminal", F.col("_fit").isNull())
            .withColumn("alpha", F.coalesce("alpha", F.lit(0.0))).withColumn("slope", F.coalesce("slope", F.lit(1.0))).drop("_fit").withColumn("beta_raw", beta))


# --- records ---------------------------------------------------------------------------------------------
def required_keys(leads: DataFrame, signatures: DataFrame, thresholds: list[float], arms: list[str]) -> DataFrame:
    """JN21: leads x signatures x arms x thresholds. Both inputs are small key tables (12 leads, a few signatures)."""
    return (leads.crossJoin(F.broadcast(signatures)).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
            .withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))))


def resolve_calibration(cells: DataFrame, records: DataFrame, keys, params: dict[str, float], disabled: str | None = None) -> DataFrame:
    """JN22: exact-key lookup. mode = fitted / terminal_identity / selection_disabled; a key without a record is an error row.

    ``disabled`` names a boolean column of the records: where it holds, selection has left this calibration out, the raw value passes
    as with a terminal record, and the mode says which of the two it is.
    """
    keys = list(keys)
    off = F.coalesce(F.col(disabled), F.lit(False)) if disabled else F.lit(False)
    r = records.select(*keys, F.lit(True).alias("_hit"), off.alias("_off"), (F.col("terminal") & ~off).alias("_t"), *[F.col(p).alias(f"_{p}") for p in params])
    j = cells.join(r, keys, "left")
    hit = F.coalesce("_hit", F.lit(False))
    mode = F.when(~hit, "missing_record").when(F.col("_off"), "selection_disabled").when(F.col("_t"), "terminal_identity").otherwise("fitted")
    return j.select(*cells.columns, mode.alias("mode"), *[
        F.when(hit, F.when(F.col("_t") | F.col("_off"), F.lit(float(v))).otherwise(F.col(f"_{p}"))).alias(p) for p, v in params.items()])


def resolve_scale(cells: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN23: (cells with a scale, cells for the regression-only output)."""
    j = cells.join(scales.select("lead", "condition_signature", "scale", "unsupported"), ["lead", "condition_signature"], "left")
    off = F.coalesce("unsupported", F.lit(True))
    return j.filter(~off).drop("unsupported"), j.filter(off).drop("unsupported", "scale")


def record_violations(records: DataFrame, masses: DataFrame, min_blocks=MIN_BLOCKS, min_ess=MIN_ESS) -> DataFrame:
    """VA06: recompute the ladder and compare level and support; effective blocks cannot exceed blocks."""
    again = pooling_ladder(masses, min_blocks, min_ess).select("lead", "condition_signature", F.col("level").alias("_level"), F.col("terminal").alias("_terminal"))
    j = records.join(again, ["lead", "condition_signature"], "full_outer")
    key = F.concat_ws("|", "lead", "condition_signature")
    return union_all([
        violation(records.filter("ess > blocks + 1e-9"), "ess_above_blocks", key),
        violation(j.filter(~F.col("level").eqNullSafe(F.col("_level"))), "not_first_passing", key),
        violation(j.filter(~F.col("terminal").eqNullSafe(F.col("_terminal"))), "terminal_flag", key),
    ])

