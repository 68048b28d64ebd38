"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fisher_mean(r: Column) -> Column:
    """tanh of the mean of atanh; correlations of exactly 1 or -1 count as the largest below."""
    edge = 1 - 2.0**-52
    return F.tanh(F.avg(F.atanh(F.least(F.greatest(r, F.lit(-edge)), F.lit(edge)))))


def wrap_phase(x: Column) -> Column:
    """An angle brought into (-pi, pi]."""
    turns = F.ceil((x - math.pi) / (2 * math.pi))
    return x - turns * (2 * math.pi)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two sums of products, as an aggregate; null where a side is zero."""
    return F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))


def ci95(x: Column) -> Column:
    """Half the width of the 95 % interval of a mean."""
    return 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))


def complex_power(magnitude: Column, phase: Column, exponent: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a complex number raised to a real exponent."""
    m = F.pow(magnitude, exponent)
    return m * F.cos(exponent * phase), m * F.sin(exponent * phase)


def period_seconds(phase: Column, step_seconds: float) -> Column:
    """Seconds for a full turn at `phase` radians a step."""
    return F.try_divide(F.lit(2 * math.pi * step_seconds), phase)


def swap_hemisphere(channel: Column, half: int = 180) -> Column:
    """The channel at the same place of the other half: 1..half and half + 1..2 half change places."""
    return F.when(channel <= half, channel + half).otherwise(channel - half)


def bucketise(x: Column, low: float, high: float, buckets: int = 256) -> Column:
    """1..buckets for values clamped to [low, high]."""
    inside = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.greatest(F.ceil((inside - low) / (high - low) * buckets), F.lit(1)).cast("int")


def predicted_dfc(phase_difference: Column) -> Column:
    """Closed form of sliding-correlation spread for two sinusoids of a phase difference."""
    return 0.13 * F.sin(2 * (phase_difference - math.pi / 4)) + 0.26
