"""Dropping, filling and sampling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import (
    as_double,
    dtype_of,
    is_integral,
    is_numeric,
    numeric_columns,
    present,
    ref,
    require_columns,
    unify_missing,
)
from tabulens.operators.profile import missing_counts, top_values
from tabulens.operators.ranks import medians


def drop_columns(df: DataFrame, cols: list[str], keep_at_least: int = 0) -> DataFrame:
    require_columns(df, cols)
    if len(df.columns) - len(cols) < keep_at_least:
        raise ValueError(f"at least {keep_at_least} columns must remain")
    return df.select(*[ref(c) for c in df.columns if c not in cols])


def drop_feature(df: DataFrame, name: str) -> DataFrame:
    """Drop one column, but never go below two."""
    return drop_columns(df, [name], keep_at_least=2)


def drop_rows_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop a row when any of the listed columns is missing."""
    require_columns(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & present(df, c).isNotNull()
    return df.where(keep)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


def _fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Fill numeric columns with a double; an integer column becomes a double column."""
    return _replace(
        df, {c: F.coalesce(as_double(df, c), F.lit(v).cast("double")) for c, v in values.items()}
    )


def _numeric_only(df: DataFrame, cols: list[str]) -> list[str]:
    require_columns(df, cols)
    return [c for c in cols if is_numeric(dtype_of(df, c))]


def _means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    if not cols:
        return {}
    return df.agg(*[F.avg(as_double(df, c)).alias(c) for c in cols]).first().asDict()


def _modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column, ties to the smallest, in the column's own type."""
    if not cols:
        return {}
    return {r["column"]: r["value"] for f in top_values(df, cols) for r in f.collect()}


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text columns are left as they are."""
    return _fill(df, _means(df, _numeric_only(df, cols)))


def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    return _fill(df, medians(df, _numeric_only(df, cols)))


def fill_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    require_columns(df, cols)
    return _replace(
        df,
        {
            c: F.coalesce(present(df, c), F.lit(v).cast(dtype_of(df, c)))
            for c, v in _modes(df, cols).items()
        },
    )


def fill_constant(df: DataFrame, name: str, value: str) -> DataFrame:
    """Fill with a literal. A numeric column keeps its type, so the literal must be a number."""
    t = dtype_of(df, name)
    if not is_numeric(t):
        return _replace(df, {name: F.coalesce(present(df, name), F.lit(value).cast(t))})
    try:
        number = float(value)
    except ValueError:
        raise ValueError(f"'{value}' is not a number, but column '{name}' is numeric") from None
    if is_integral(t) and number.is_integer():
        return _replace(df, {name: F.coalesce(present(df, name), F.lit(int(number)).cast(t))})
    return _fill(df, {name: number})


def clean_missing(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Apply one strategy per column: drop columns, then drop rows, then fill.

    Strategies: mean, median, mode, constant:VALUE, drop_rows, drop_col. The fill
    statistics are those of the rows that remain after dropping.
    """
    here = {c: s for c, s in strategies.items() if c in df.columns}
    df = unify_missing(df)
    df = drop_columns(df, [c for c, s in here.items() if s == "drop_col"])
    df = drop_rows_missing(df, [c for c, s in here.items() if s == "drop_rows"])
    by = lambda kind: [c for c, s in here.items() if s == kind]
    means = _means(df, _numeric_only(df, by("mean")))
    mids = medians(df, _numeric_only(df, by("median")))
    modes = _modes(df, by("mode"))
    out = _fill(df, {**means, **mids})
    out = _replace(
        out,
        {c: F.coalesce(ref(c), F.lit(v).cast(dtype_of(df, c))) for c, v in modes.items()},
    )
    for c, s in here.items():
        if s.startswith("constant:"):
            out = fill_constant(out, c, s[len("constant:") :])
    return out


def clean_summary(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """(rows_before, rows_dropped, cols_dropped) of ``clean_missing``."""
    here = {c: s for c, s in strategies.items() if c in df.columns}
    gone = F.lit(False)
    for c, s in here.items():
        if s == "drop_rows":
            gone = gone | present(df, c).isNull()
    dropped = [c for c, s in here.items() if s == "drop_col"]
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(gone).alias("rows_dropped"),
        F.lit(len(dropped)).cast("bigint").alias("cols_dropped"),
    )


def default_strategies(df: DataFrame) -> DataFrame:
    """(column, strategy) for the columns with missing values."""
    numeric = numeric_columns(df)
    return (
        missing_counts(df)
        .where("missing_count > 0")
        .select(
            "column",
            F.when(F.col("column").isin(numeric), "median").otherwise("mode").alias("strategy"),
        )
    )


def select_features_cols(df: DataFrame, cols: dict[str, T.DataType] | list[str]) -> DataFrame:
    """Columns by name in the given order; a name that is absent becomes a NULL column.

    Pass a mapping name -> type to say what type an absent column takes (double otherwise).
    """
    types = cols if isinstance(cols, dict) else {c: T.DoubleType() for c in cols}
    return df.select(
        *[ref(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    )


