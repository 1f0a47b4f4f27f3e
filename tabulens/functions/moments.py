"""Small expressions over aggregates: bias-corrected shape, guarded ratios, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_round(c: Column, digits: int = 6) -> Column:
    """Round, with NaN and the infinities as NULL."""
    c = c.cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, F.round(c, digits))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def skew_g1(x: Column) -> Column:
    """Sample skewness: NULL below 3 values, 0 without variance."""
    n = F.count(x).cast("double")
    corrected = ratio(F.sqrt(n * F.greatest(n - 1, F.lit(0.0))), n - 2) * F.skewness(x)
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def kurt_g2(x: Column) -> Column:
    """Sample excess kurtosis: NULL below 4 values, 0 without variance."""
    n = F.count(x).cast("double")
    corrected = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from centred moments; NULL where a side is constant."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(ratio(part * 100.0, whole), F.lit(0.0)), digits)
