"""Value-space transforms as closed Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the data contract
A_WET = 0.1                       # mm, inclusive wet threshold
A0 = 1.0                          # mm, scale of log1p
NULL_CODES = (-30000, -25000)     # raw codes without data; -20000 is a valid value
CONTEXT_THRESHOLD = 0.153765      # mm/h, rate of the 10 dBZ cutoff
MAX_RATE = 1000.0                 # mm/h at normalized value 1
# fixed values: channel names that only exist after the issue time
FUTURE_NAMES = (
    "future_target", "future_target_validity", "m_target", "m_target_tau", "target_label",
    "target_validity", "target_wet_label", "target_z", "training_label",
)


def clip(c, low: float, high: float) -> Column:
    """Bounds that keep null null: greatest() and least() alone would turn a missing value into a bound.

    NaN is null too: in this engine it is above every number and would come out as the upper bound.
    """
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def rate_from_normalized(v) -> Column:
    """PR08."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), (45.0 * v - 15.0) / 10.0))


def normalized_from_rate(r) -> Column:
    """PR09: at or below the smallest rate is 0, bounded by 1; null for what is no rate: negative, NaN, or above the maximum."""
    return (F.when((r < 0) | F.isnan(r) | (r > MAX_RATE * (1 + 1e-6)), F.lit(None).cast("double")).when(r == 0, F.lit(0.0))
            .otherwise(clip((10.0 * F.log10(r) + 15.0) / 45.0, 0.0, 1.0)))


def wet(raw, a_wet: float = A_WET) -> Column:
    """At or above the threshold; null for null and NaN."""
    return F.when(~F.isnan(raw), raw >= F.lit(a_wet))


def censored(raw, a_wet: float = A_WET) -> Column:
    """PR10: amount after the wet threshold."""
    return F.when(wet(raw, a_wet), raw).when(raw.isNotNull() & ~F.isnan(raw), F.lit(0.0))


def log_amount(raw, a_wet: float = A_WET, a0: float = A0) -> Column:
    return F.log1p(censored(raw, a_wet) / F.lit(a0))


def raw_valid(raw) -> Column:
    """PR13."""
    return ~raw.isin(*NULL_CODES)


def reflectivity(raw, valid) -> Column:
    """PR11: null where invalid."""
    return F.when(valid, raw / 100.0)


def rate_from_dbz(dbz, floor_dbz: float = 10.0) -> Column:
    """PR12: Z = 200 R^1.6; below the floor no rain."""
    return (F.when(dbz < F.lit(floor_dbz), F.lit(0.0))
            .otherwise(F.pow(F.pow(F.lit(10.0), dbz / 10.0) / 200.0, F.lit(1.0 / 1.6))))


def regression_mean(p, m) -> Column:
    """PR37: mean in transformed space."""
    return p * m


def physical_point(mu_z, a0: float = A0) -> Column:
    return F.lit(a0) * F.expm1(mu_z)


def map_probability(p, alpha, beta_raw, eps: float = 1e-6) -> Column:
    """PR35: sigmoid(alpha + softplus(beta) * logit(clipped p))."""
    q = clip(p, eps, 1.0 - eps)
    slope = F.greatest(beta_raw, F.lit(0.0)) + F.log1p(F.exp(-F.abs(beta_raw)))
    x = alpha + slope * (F.ln(q) - F.log1p(-q))
    return 1.0 / (1.0 + F.exp(-x))


def clip_weight(w, maximum: float | None) -> Column:
    """PR36."""
    return w if maximum is None else F.when(w > maximum, F.lit(float(maximum))).otherwise(w)
