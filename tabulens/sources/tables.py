"""Reading tables: Parquet, and CSV with encoding, missing-token and type detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import ref

# The texts that stand for a missing value in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# How numbers and truth values are written.
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")
SURPLUS = "_surplus_field"  # a column for what a row has beyond the header


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_traits(spark: SparkSession, path: str) -> dict:
    """One scan over the lines: valid UTF-8 throughout? any quoted line break?"""
    row = (
        spark.read.text(path)
        .agg(
            F.coalesce(F.min(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
            F.coalesce(
                F.max(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1), F.lit(False)
            ).alias("multi_line"),
        )
        .first()
    )
    return {"encoding": "UTF-8" if row["utf8"] else "ISO-8859-1", "multi_line": row["multi_line"]}


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as text columns. Files stay splittable unless a quoted field spans lines.

    A row with fewer fields than the header ends in NULLs; one with more that are not empty raises.
    """
    traits = csv_traits(spark, path)

    def reader():
        return (
            spark.read.option("header", True)
            .option("encoding", traits["encoding"])
            .option("multiLine", traits["multi_line"])
            .option("escape", '"')
        )

    names = reader().csv(path).columns
    if not names:
        return reader().csv(path)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, SURPLUS])
    rows = reader().schema(schema).csv(path)
    if rows.where(F.col(SURPLUS).isNotNull()).take(1):
        raise ValueError("a row of the CSV has more fields than its header")
    return rows.drop(SURPLUS)


def na_tokens(df: DataFrame) -> DataFrame:
    """Text columns with every missing-value token turned into NULL."""
    texts = {n for n, t in df.dtypes if t == "string"}
    return df.select(
        *[
            (F.when(~F.trim(ref(c)).isin(*NA_TOKENS), ref(c)).alias(c) if c in texts else ref(c))
            for c in df.columns
        ]
    )


def _fits(c: str) -> Column:
    """Counts of the non-missing values that do not read as each type, and of all of them."""
    v = F.trim(ref(c))
    bad = lambda ok: F.count_if(v.isNotNull() & ~ok)
    return F.struct(
        F.count(v).alias("n"),
        bad(v.rlike(INT_PATTERN) & v.try_cast("bigint").isNotNull()).alias("int"),
        bad(F.lower(v).rlike(FLOAT_PATTERN)).alias("float"),
        bad(v.isin(*TRUE_WORDS, *FALSE_WORDS)).alias("bool"),
    )


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Type per text column: bigint, double, boolean or string; a column without values is double."""
    row = df.agg(*[_fits(c).alias(c) for c in df.columns]).first()
    out = {}
    for c in df.columns:
        f = row[c]
        if f["n"] == 0:
            out[c] = "double"
        elif f["bool"] == 0:
            out[c] = "boolean"
        elif f["int"] == 0:
            out[c] = "bigint"
        elif f["float"] == 0:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def infer_schema(df: DataFrame) -> DataFrame:
    """(column, type) of a frame of text columns."""
    return df.sparkSession.createDataFrame(
        list(inferred_types(df).items()), "column string, type string"
    )


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def cast(c: str) -> Column:
        if types[c] == "string":
            return ref(c)
        if types[c] == "boolean":
            return F.when(ref(c).isNotNull(), F.trim(ref(c)).isin(*TRUE_WORDS))
        return F.trim(ref(c)).try_cast(types[c])

    return df.select(*[cast(c).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with detected encoding, missing tokens as NULL and inferred types."""
    if not path.lower().rstrip("/").endswith((".csv", ".csv.gz")) and "*" not in path:
        raise ValueError("only .csv files are read; convert spreadsheets first")
    text = na_tokens(read_csv_text(spark, path))
    return with_types(text, inferred_types(text))


def validate_dataset(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(check, message) for every failed check; no rows means the table can be used."""
    problems = []
    if len(df.columns) < 2:
        problems.append(("columns", "the table needs at least 2 columns"))
    for c in required or []:
        if c not in df.columns:
            problems.append(("column_exists", f"column '{c}' not found"))
    lowered = [c.lower() for c in df.columns]
    for c in sorted({c for c in lowered if lowered.count(c) > 1}):
        problems.append(("column_case", f"several columns are named '{c}' but for case"))
    if df.isEmpty():
        problems.append(("rows", "the table has no rows"))
    return df.sparkSession.createDataFrame(problems, "check string, message string")
