"""Ensemble members held as ARRAY<DOUBLE>: reductions without exploding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import A0, A_WET


def total(m) -> Column:
    return F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x)


def mean(m) -> Column:
    return total(m) / F.size(m)


def sample_variance(m) -> Column:
    """ddof = 1, two passes over the array."""
    mu = mean(m)
    return total(F.transform(m, lambda x: (x - mu) * (x - mu))) / (F.size(m) - 1)


def lower_median(m) -> Column:
    """PR33: order statistic (N-1)//2, no interpolation."""
    return F.element_at(F.array_sort(m), F.floor((F.size(m) - 1) / 2).cast("int") + 1)


def exceed_fraction(m, threshold: float) -> Column:
    """PR34."""
    return F.size(F.filter(m, lambda x: x >= F.lit(threshold))) / F.size(m)


def fair_crps(m, y) -> Column:
    """ME04: sorted form of the pair sum; one member falls back to the absolute error."""
    n = F.size(m)
    err = total(F.transform(m, lambda x: F.abs(x - y))) / n
    pairs = total(F.transform(F.array_sort(m), lambda x, i: (2 * i - n + 1) * x))
    return F.when(n < 2, err).otherwise(err - pairs / (n * (n - 1)))


def calibrated(m, b, d, c, gamma) -> Column:
    """Location and scale first, then spread about the unchanged member mean; identity passes through."""
    first = F.transform(m, lambda x: b + d + c * x)
    mu = mean(first)
    spread = F.transform(first, lambda x: mu + gamma * (x - mu))
    identity = (b == 0) & (c == 1) & (d == 0) & (gamma == 1)
    return F.when(identity, m).when(gamma == 1, first).otherwise(spread)


def to_physical(mu_z, m, a0: float = A0, a_wet: float = A_WET) -> Column:
    amounts = F.transform(m, lambda x: F.when(mu_z + x > 0, F.lit(a0) * F.expm1(mu_z + x)).when((mu_z + x).isNotNull(), F.lit(0.0)))
    return F.transform(amounts, lambda a: F.when(a >= F.lit(a_wet), a).when(a.isNotNull(), F.lit(0.0)))


def restore(m, scale, mu_z, b, d, c, gamma) -> Column:
    """PR32: scale, calibrate, add the regression mean, invert, censor."""
    return to_physical(mu_z, calibrated(F.transform(m, lambda x: x * scale), b, d, c, gamma))
