"""Column access, type families and the single notion of a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """A column by its exact name; generated names hold signs such as the minus or times sign."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise ValueError(f"column '{name}' not found")


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, FLOATING)


def is_number(t: T.DataType) -> bool:
    """Numbers proper; booleans are not among them."""
    return is_integral(t) or is_floating(t)


def is_numeric(t: T.DataType) -> bool:
    """Columns that take the numeric branch of a profile: numbers and booleans."""
    return is_number(t) or isinstance(t, T.BooleanType)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that one test finds every missing value."""
    t = dtype_of(df, name)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.nanvl(ref(name), F.lit(None).cast(t))
    return ref(name)


def unify_missing(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def as_double(df: DataFrame, name: str) -> Column:
    t = dtype_of(df, name)
    if not is_numeric(t):
        raise ValueError(f"column '{name}' must be numeric")
    return present(df, name).cast("double")


def family(t: T.DataType) -> str:
    """The type a column is compared in when several columns share one long frame."""
    if is_integral(t):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def long_values(df: DataFrame, names: list[str]) -> list[DataFrame]:
    """One (column, value) frame per type family, in the values' own type."""
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(family(dtype_of(df, n)), []).append(n)
    return [
        df.select(*[present(df, n).cast(kind).alias(n) for n in members]).unpivot(
            [], [ref(n) for n in members], "column", "value"
        )
        for kind, members in groups.items()
    ]


def rows_of(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Aggregate ``df`` once and lay the results out as one row per entry of ``rows``."""
    structs = [F.struct(*[e.alias(k) for k, e in r.items()]) for r in rows]
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dtype_name(t: T.DataType, has_null: bool) -> str:
    """The dtype label a nullable column would carry in a data frame of the NumPy kind."""
    if is_integral(t):
        return "float64" if has_null else "int64"
    if is_floating(t):
        return "float64"
    if isinstance(t, T.BooleanType):
        return "object" if has_null else "bool"
    if isinstance(t, DATETIME):
        return "datetime64[ns]"
    if isinstance(t, T.StringType):
        return "object"
    return t.simpleString()
