"""Point samples and straight-line fits of features against a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import as_double, dtype_of, is_numeric, present, ref, rows_of, union_all
from tabulens.functions.hashing import row_order, sample_n
from tabulens.functions.moments import clean_round, ratio
from tabulens.functions.tails import t_p
from tabulens.operators.engineer import attach_code, label_classes

# Allowed and default numbers of points.
POINTS_ALLOWED = (10, 5000)
POINTS_DEFAULT = 500
GRID_POINTS = 300


def _as_numbers(df: DataFrame, cols: list[str], extra: list[str]) -> DataFrame:
    out = df.select(*[ref(c) for c in dict.fromkeys([*cols, *extra])])
    for c in cols:
        if not is_numeric(dtype_of(df, c)):
            classes = label_classes(df.where(present(df, c).isNotNull()), c)
            out = attach_code(out, c, classes, f"_n_{c}")  # a missing value finds no class
        else:
            out = out.withColumn(f"_n_{c}", as_double(df, c))
    return out


def scatter_sample(
    df: DataFrame, feature: str, target: str, key: str, max_points: int = POINTS_DEFAULT, seed: int = 42
) -> DataFrame:
    """(x, y) of at most max_points rows with both values, text as label codes."""
    if not POINTS_ALLOWED[0] <= max_points <= POINTS_ALLOWED[1]:
        raise ValueError("max_points must be between 10 and 5000")
    both = df.where(present(df, feature).isNotNull() & present(df, target).isNotNull())
    numbers = _as_numbers(both, [feature, target], [key])
    return sample_n(numbers, max_points, key, seed).select(
        ref(f"_n_{feature}").cast("double").alias("x"), ref(f"_n_{target}").cast("double").alias("y")
    )


def linregress(df: DataFrame, features: str | list[str], target: str) -> DataFrame:
    """One least-squares line per feature over all rows with both values, in one aggregation."""
    features = [features] if isinstance(features, str) else features
    numbers = _as_numbers(df.where(present(df, target).isNotNull()), [*features, target], [])
    y = ref(f"_n_{target}").cast("double")
    rows = []
    for f in features:
        x = ref(f"_n_{f}").cast("double")
        both = x.isNotNull() & y.isNotNull()
        u, v = F.when(both, x), F.when(both, y)
        rows.append(
            {
                "feature": F.lit(f),
                "n": F.count(u),
                "b": F.regr_slope(v, u),
                "a": F.regr_intercept(v, u),
                "r2": F.regr_r2(v, u),
                "x0": F.min(u),
                "x1": F.max(u),
            }
        )
    fit = rows_of(numbers, rows)
    dof = F.col("n").cast("double") - 2
    t = F.sqrt(ratio(F.col("r2") * dof, F.lit(1.0) - F.col("r2")))
    p = F.when(F.col("r2") >= 1.0, F.lit(0.0)).otherwise(t_p(t, dof))
    return fit.select(
        "feature",
        clean_round(F.col("b")).alias("slope"),
        clean_round(F.col("a")).alias("intercept"),
        clean_round(F.col("r2")).alias("r_squared"),
        clean_round(p).alias("p_value"),
        "x0",
        "x1",
        (F.col("a") + F.col("b") * F.col("x0")).alias("y0"),
        (F.col("a") + F.col("b") * F.col("x1")).alias("y1"),
    )


def scatter_grid(
    df: DataFrame, features: list[str], target: str, key: str, max_points: int = GRID_POINTS, seed: int = 42
) -> DataFrame:
    """(feature, x, y): the point samples of several features in one frame."""
    order = row_order(df, key, seed)
    both = df.where(present(df, target).isNotNull())  # classes seen without a target get no code
    numbers = _as_numbers(both, [*features, target], [key]).withColumn("_h", order)
    tops = [
        numbers.where(ref(f"_n_{f}").isNotNull() & ref(f"_n_{target}").isNotNull())
        .orderBy("_h", ref(key))
        .limit(max_points)
        .select(
            F.lit(f).alias("feature"),
            ref(f"_n_{f}").cast("double").alias("x"),
            ref(f"_n_{target}").cast("double").alias("y"),
        )
        for f in features
    ]
    return union_all(tops)
