"""Tail probabilities of the t and chi-square distributions.

The inputs are one row per feature, so the vectorised functions below see a handful of values.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_DOF = 1e7  # from here on the two differ by less than 1e-7


def _series_lower_gamma(a: float, x: float) -> float:
    term = total = 1.0 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1.0
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def _fraction(pairs) -> float:
    """Evaluate b0 + a1/(b1 + a2/(b2 + ...)) by the Lentz recurrence; the first pair is (_, b0)."""
    floor = 1e-300
    _, b0 = next(pairs)
    value = c = b0 or floor
    d = 0.0
    for a, b in pairs:
        d = 1.0 / ((b + a * d) or floor)
        c = (b + a / c) or floor
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    if abs(c * d - 1.0) > 1e-9:
        raise ArithmeticError("the tail probability did not converge")
    return value


def chi2_tail(stat: float, dof: float) -> float:
    """P(X >= stat) for chi-square with ``dof`` degrees of freedom."""
    if stat <= 0:
        return 1.0
    a, x = dof / 2.0, stat / 2.0
    if x < a + 1.0:
        return 1.0 - _series_lower_gamma(a, x)

    def terms():
        yield 0.0, x + 1.0 - a
        for i in range(1, 10000):
            yield -i * (i - a), x + 2 * i + 1.0 - a

    return math.exp(a * math.log(x) - x - math.lgamma(a)) / _fraction(terms())


def _beta_fraction(a: float, b: float, x: float) -> float:
    def terms():
        yield 0.0, 1.0
        for i in range(1, 10000):
            m = i // 2
            if i % 2:
                num = -(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i))
            else:
                num = m * (b - m) * x / ((a + i - 1) * (a + i))
            yield num, 1.0

    return 1.0 / _fraction(terms())


def t_tail(t: float, dof: float) -> float:
    """Two-sided P(|T| >= |t|) for Student's t; beyond NORMAL_DOF degrees of freedom of the normal."""
    if dof > NORMAL_DOF:
        return math.erfc(abs(t) / math.sqrt(2.0))
    a, b = dof / 2.0, 0.5
    x = dof / (dof + t * t)
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _apply(fn, first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(u) or pd.isna(v) or v <= 0 else fn(u, v) for u, v in zip(first, second)],
        dtype="float64",
    )


def chi2_p(stat: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(s: pd.Series, d: pd.Series) -> pd.Series:
        return _apply(chi2_tail, s, d)

    return tail(stat, dof)


def t_p(stat: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(s: pd.Series, d: pd.Series) -> pd.Series:
        return _apply(t_tail, s, d)

    return tail(stat, dof)


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, in plain SQL expressions."""
    n, m = n.cast("double"), m.cast("double")
    lam = d * F.sqrt(n * m / (n + m))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    )
