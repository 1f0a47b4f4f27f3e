"""Column profiles, problem-type rules, target suggestions and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import (
    DATETIME,
    as_double,
    dtype_name,
    dtype_of,
    is_floating,
    is_integral,
    is_number,
    is_numeric,
    long_values,
    numeric_columns,
    present,
    ref,
    require_columns,
    rows_of,
    text_columns,
    union_all,
)
from tabulens.functions.hashing import row_order
from tabulens.functions.moments import clean_round, kurt_g2, percent, skew_g1
from tabulens.operators.ranks import column_facts, percentiles

# Thresholds and labels of the column rules.
CLASS_LIMIT_INT = 20
CLASS_LIMIT_FLOAT = 5
CLASS_RATIO = 0.05
CLASSIFICATION = "classification"
REGRESSION = "regression"
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)
# Names that hint at a target column.
TARGET_WORDS = (
    "target", "label", "labels", "outcome", "output", "result",
    "y", "class", "category", "response", "dependent", "predict",
    "prediction", "diagnosis", "status", "flag", "churn", "default",
    "price", "sales", "revenue", "score", "grade",
)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as a frame: one row per column."""
    rows = [(i, f.name, is_numeric(f.dataType), is_number(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, is_numeric boolean, is_number boolean"
    )


def null_flags(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    return {c: present(df, c).isNull() for c in cols}


def _dtype_expr(t: T.DataType, has_null: Column) -> Column:
    return F.when(has_null, dtype_name(t, True)).otherwise(dtype_name(t, False))


def effective_dtype(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, dtype): integers with a missing value count as float, booleans as object."""
    cols = cols or df.columns
    return rows_of(
        df,
        [
            {
                "column": F.lit(c),
                "dtype": _dtype_expr(dtype_of(df, c), F.count_if(present(df, c).isNull()) > 0),
            }
            for c in cols
        ],
    )


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_unique) over non-missing values, one shuffle per type family."""
    cols = cols or df.columns
    if approx:
        return rows_of(
            df,
            [{"column": F.lit(c), "n_unique": F.approx_count_distinct(present(df, c))} for c in cols],
        )
    pairs = [f.where("value is not null").distinct() for f in long_values(df, cols)]
    counted = [p.groupBy("column").agg(F.count("*").alias("n")) for p in pairs]
    zero = df.sparkSession.createDataFrame([(c, 0) for c in cols], "column string, n bigint")
    return (
        union_all([*counted, zero]).groupBy("column").agg(F.sum("n").cast("bigint").alias("n_unique"))
    )


def few_distinct(df: DataFrame, cols: list[str], limit: int) -> dict[str, int]:
    """Distinct counts that are exact up to ``limit``; larger ones are only known to exceed it.

    A sketch rules out the columns far above the limit in one scan without a shuffle;
    only the remaining ones, which have few values, are counted exactly.
    """
    if not cols:
        return {}
    rough = df.agg(*[F.approx_count_distinct(present(df, c)).alias(c) for c in cols]).first().asDict()
    near = [c for c in cols if rough[c] <= 4 * limit + 20]
    exact = {r["column"]: r["n_unique"] for r in distinct_counts(df, near).collect()} if near else {}
    return {c: exact.get(c, rough[c]) for c in cols}


def _looks_like_date(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, is_date): do all non-missing values read as dates in one format? One scan."""
    values = df.select(*[ref(c) for c in cols]).unpivot([], [ref(c) for c in cols], "column", "value")
    parsed = values.where("value is not null").groupBy("column").agg(
        F.greatest(
            *[F.min(F.try_to_timestamp("value", F.lit(f)).isNotNull()) for f in DATE_FORMATS]
        ).alias("is_date")
    )
    empty = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    # a column without values reads as a date, as it does for the usual date parsers
    return empty.join(parsed, "column", "left").withColumn("is_date", F.coalesce("is_date", F.lit(True)))


def classify_columns(df: DataFrame) -> DataFrame:
    """(column, dtype, column_type) by the type rules."""
    ints = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    few = few_distinct(df, ints, CLASS_LIMIT_INT)
    rows = []
    for f in df.schema.fields:
        t, c = f.dataType, f.name
        has_null = F.count_if(present(df, c).isNull()) > 0
        if is_integral(t):
            name = "integer (categorical)" if few[c] <= CLASS_LIMIT_INT else "integer"
            label = F.when(has_null, "float").otherwise(name)
        elif is_floating(t):
            label = F.lit("float")
        elif isinstance(t, T.BooleanType):
            label = F.when(has_null, "text / categorical").otherwise("boolean")
        elif isinstance(t, DATETIME):
            label = F.lit("datetime")
        elif isinstance(t, T.StringType):
            label = F.lit("text / categorical")
        else:
            label = F.lit(t.simpleString())
        rows.append({"column": F.lit(c), "dtype": _dtype_expr(t, has_null), "column_type": label})
    out = rows_of(df, rows)
    if not texts:
        return out
    dates = _looks_like_date(df, texts)
    return out.join(F.broadcast(dates), "column", "left").select(
        "column",
        "dtype",
        F.when(F.coalesce("is_date", F.lit(False)), "datetime (string)")
        .otherwise(F.col("column_type"))
        .alias("column_type"),
    )


def suggested_transform(skewness: Column, minimum: Column) -> Column:
    heavy = F.abs(F.coalesce(skewness, F.lit(0.0))) > 1.0
    low = F.coalesce(minimum, F.lit(0.0))
    return F.when(heavy & (low > 0), "log").when(heavy & (low >= 0), "sqrt").otherwise("none")


def skew_severity(profile: DataFrame) -> DataFrame:
    size = F.abs("skewness")
    return profile.withColumn(
        "severity", F.when(size > 2, "high").when(size > 1, "moderate").otherwise("ok")
    )


def _long_doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, x): every numeric value under its column's name, in the scanning task."""
    return df.select(*[as_double(df, c).alias(c) for c in cols]).unpivot(
        [], [ref(c) for c in cols], "column", "x"
    )


QUARTILES = [0.25, 0.5, 0.75]


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Moments and quartiles of all numeric columns in two scans.

    The first gives moments and the quantile sketch, in long form, so its code does not grow with the
    number of columns and each task sends one row per column; the second the exact quartiles.
    """
    cols = cols or numeric_columns(df)
    facts = column_facts(
        df, cols, QUARTILES,
        sum=lambda x: clean_round(F.coalesce(F.sum(x), F.lit(0.0))),
        low=F.min,
        max=lambda x: clean_round(F.max(x)),
        mean=lambda x: clean_round(F.avg(x)),
        std=lambda x: clean_round(F.stddev_samp(x)),
        skewness=lambda x: clean_round(skew_g1(x)),
        kurtosis=lambda x: clean_round(kurt_g2(x)),
    )
    quart = percentiles(df, cols, QUARTILES, facts)
    names = ("sum", "low", "max", "mean", "std", "skewness", "kurtosis")
    rows = [(c, is_number(dtype_of(df, c)), facts[c]["n"], *[facts[c][k] for k in names], *quart[c]) for c in cols]
    found = df.sparkSession.createDataFrame(
        rows,
        "column string, is_number boolean, count bigint, "
        + ", ".join(f"{k} double" for k in (*names, "q25", "median", "q75")),
    )
    full = lambda c: F.when(F.col("is_number"), F.col(c)).alias(c)
    return found.withColumn("min", clean_round(F.col("low"))).select(
        "column",
        "count",
        "sum",
        # a boolean has no range, spread or quartiles, but has the rest
        *[full(c) for c in ("min", "max", "mean", "std")],
        clean_round(F.col("median")).alias("median"),
        *[F.when(F.col("is_number"), clean_round(F.col(c))).alias(c) for c in ("q25", "q75")],
        "skewness",
        "kurtosis",
        suggested_transform(F.col("skewness"), F.col("low")).alias("suggested_transform"),
    )


def shape_statistics(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, skewness, kurtosis) alone."""
    x = F.col("x")
    return _long_doubles(df, cols).groupBy("column").agg(
        clean_round(skew_g1(x)).alias("skewness"), clean_round(kurt_g2(x)).alias("kurtosis")
    )


def transform_suggestions(df: DataFrame, cols: list[str]) -> DataFrame:
    x = F.col("x")
    found = _long_doubles(df, cols).groupBy("column").agg(
        clean_round(skew_g1(x)).alias("skewness"), F.min(x).alias("low")
    )
    return found.select(
        "column", suggested_transform(F.col("skewness"), F.col("low")).alias("suggested_transform")
    )


def top_values(df: DataFrame, cols: list[str]) -> list[DataFrame]:
    """(column, value, n) per type family: the most frequent value, ties to the smallest."""
    return [
        f.where("value is not null")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("t"))
        .select("column", F.col("t.value").alias("value"), (-F.col("t.m")).alias("n"))
        for f in long_values(df, cols)
    ]


def profile_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, top_value, top_value_count); a column without values keeps its row with 0."""
    cols = cols or text_columns(df)
    found = union_all(
        [f.select("column", F.col("value").cast("string").alias("value"), "n") for f in top_values(df, cols)]
    )
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(found, "column", "left").select(
        "column",
        F.col("value").alias("top_value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("top_value_count"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    return rows_of(
        df,
        [
            {
                "column": F.lit(c),
                "missing_count": F.count_if(m),
                "missing_pct": percent(F.count_if(m), F.count("*")),
            }
            for c, m in null_flags(df, df.columns).items()
        ],
    )


def profile_nulls_distinct(df: DataFrame, approx: bool = False) -> DataFrame:
    return (
        missing_counts(df)
        .withColumn("has_missing", F.col("missing_count") > 0)
        .join(distinct_counts(df, approx=approx), "column")
        .select("column", "n_unique", "missing_count", "missing_pct", "has_missing")
    )


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """The whole column profile, one row per column."""
    out = classify_columns(df).join(profile_nulls_distinct(df, approx), "column")
    if numeric_columns(df):
        out = out.join(profile_numeric(df), "column", "left")
    if text_columns(df):
        out = out.join(profile_categorical(df), "column", "left")
    return out


def missing_by_column(df: DataFrame) -> DataFrame:
    return missing_counts(df).where("missing_count > 0").orderBy(F.desc("missing_count"), "column")


def missing_totals(df: DataFrame) -> DataFrame:
    flags = [m.cast("int") for m in null_flags(df, df.columns).values()]
    in_row = flags[0]
    for f in flags[1:]:
        in_row = in_row + f
    k = len(df.columns)
    per_row = df.select(in_row.alias("n"), *[f.alias(f"m{i}") for i, f in enumerate(flags)])
    columns_hit = F.lit(0)
    for i in range(k):
        columns_hit = columns_hit + F.coalesce(F.max(f"m{i}"), F.lit(0))
    return per_row.agg(
        F.count("*").alias("total_rows"),
        F.lit(k).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_missing_cells"),
        (F.count("*") * k).alias("total_cells"),
        percent(F.sum("n"), F.count("*") * k).alias("overall_missing_pct"),
        columns_hit.cast("bigint").alias("columns_with_missing"),
        F.count_if(F.col("n") > 0).alias("rows_with_any_missing"),
        F.count_if(F.col("n") == 0).alias("complete_rows"),
    )


def missing_heatmap(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """(row, column, missing) over the n rows first in hash order."""
    order = row_order(df, key, seed)
    flags = [m.cast("int").alias(c) for c, m in null_flags(df, df.columns).items()]
    top = (
        df.select(order.alias("_h"), ref(key).alias("_k"), F.struct(*flags).alias("_m"))
        .orderBy("_h", "_k")
        .limit(n)
    )
    numbered = top.select(
        (F.row_number().over(Window.orderBy("_h", "_k")) - 1).alias("row"), "_m.*"
    )  # the window sees the n sampled rows only
    return numbered.unpivot(["row"], [ref(c) for c in df.columns], "column", "missing")


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row per column with its dtype and kind, and the shape of the table."""
    shape = df.agg(F.count("*").alias("rows"))
    return (
        effective_dtype(df)
        .join(F.broadcast(schema_rows(df)), "column")
        .crossJoin(F.broadcast(shape))  # a single row
        .select(
            F.col("position").cast("bigint").alias("position"),
            "column",
            "dtype",
            F.when(F.col("is_number"), "numeric").otherwise("categorical").alias("kind"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
        )
    )


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    return unified(df).orderBy(*[ref(c) for c in order_by]).limit(n)


def unified(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def problem_type(dtype: Column, n_unique: Column, n_total: Column) -> Column:
    by_count = lambda limit: F.when(n_unique <= limit, CLASSIFICATION).otherwise(REGRESSION)
    share = F.try_divide(n_unique.cast("double"), F.greatest(n_total, F.lit(1)).cast("double"))
    return (
        F.when(dtype.isin("bool", "object"), CLASSIFICATION)
        .when(dtype == "int64", by_count(CLASS_LIMIT_INT))
        .when(dtype == "float64", by_count(CLASS_LIMIT_FLOAT))
        .otherwise(F.when(share > CLASS_RATIO, REGRESSION).otherwise(CLASSIFICATION))
    )


def problem_facts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, dtype, n_total) in one scan; n_total counts non-missing values."""
    return rows_of(
        df,
        [
            {
                "column": F.lit(c),
                "dtype": _dtype_expr(dtype_of(df, c), F.count_if(present(df, c).isNull()) > 0),
                "n_total": F.count(present(df, c)),
            }
            for c in cols
        ],
    )


def detect_problem_type(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """(column, dtype, problem_type). Exact distinct counts only where a rule depends on them."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    require_columns(df, cols)
    dates = [c for c in cols if isinstance(dtype_of(df, c), DATETIME)]
    few = few_distinct(df, [c for c in cols if is_number(dtype_of(df, c))], CLASS_LIMIT_INT)
    if dates:
        few.update({r["column"]: r["n_unique"] for r in distinct_counts(df, dates).collect()})
    counts = df.sparkSession.createDataFrame(
        [(c, int(few.get(c, 0))) for c in cols], "column string, n_unique bigint"
    )
    facts = problem_facts(df, cols).join(F.broadcast(counts), "column")
    return facts.select(
        "column",
        "dtype",
        problem_type(F.col("dtype"), F.col("n_unique"), F.col("n_total")).alias("problem_type"),
    )


def problem_hint(df: DataFrame) -> DataFrame:
    return detect_problem_type(df, df.columns[-1])


def suggest_target(df: DataFrame, n: int = 3) -> DataFrame:
    """Up to n likely target columns, scored by name, position, type and cardinality."""
    words = F.array(*map(F.lit, TARGET_WORDS))
    name = F.trim(F.lower("column"))
    total = len(df.columns)
    facts = (
        problem_facts(df, df.columns)
        .join(F.broadcast(schema_rows(df)), "column")
        .join(distinct_counts(df), "column")
    )
    score = (
        F.when(F.array_contains(words, name), 0.50)
        .when(F.exists(words, lambda w: F.contains(name, w)), 0.30)
        .otherwise(0.0)
        + (F.col("position") + 1) / F.lit(float(total)) * 0.30
        + F.when(F.col("dtype").isin("int64", "float64", "bool"), 0.10).otherwise(0.0)
        + F.when(F.col("n_unique").between(2, 20), 0.10).otherwise(0.0)
    )
    return (
        facts.select(
            "column",
            F.round(F.least(score, F.lit(1.0)), 4).alias("confidence"),
            problem_type(F.col("dtype"), F.col("n_unique"), F.col("n_total")).alias("problem_type"),
            "n_unique",
            "dtype",
            "position",
        )
        .orderBy(F.desc("confidence"), "position")
        .limit(n)
        .drop("position")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows per class with the imbalance of the whole target."""
    counts = (
        df.select(present(df, target).cast("string").alias("class"))
        .where("class is not null")
        .groupBy("class")
        .agg(F.count("*").alias("count"))
    )
    whole = counts.agg(
        F.round(F.max("count") / F.min("count"), 4).alias("imbalance_ratio"),
        F.count("*").alias("n_classes"),
    )
    return counts.crossJoin(F.broadcast(whole)).select(  # a single row
        "class",
        "count",
        "imbalance_ratio",
        (F.col("imbalance_ratio") > 3).alias("is_severe"),
        "n_classes",
    )
