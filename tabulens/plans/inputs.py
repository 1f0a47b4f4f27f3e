"""Input frames shared by the queries, with the same text used in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulens.sources.tables import table

# The driver tables hold no missing value, so these expressions take some away.
ORDER_GAPS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END",
    "o_orderstatus": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END",
    "o_totalprice": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END",
    "is_open": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus = 'O' END",
    "o_orderpriority": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END",
}
REVENUE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
LINE_KEY = "l_orderkey * 8 + l_linenumber"


def sql_select(exprs: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {source}"


def picked(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


GAPS_SQL = sql_select(ORDER_GAPS, "orders")


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    return picked(table(spark, folder, "orders"), ORDER_GAPS)


LINE_FEATURES = {
    "k": LINE_KEY,
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "l_discount",
    "l_tax": "l_tax",
    "l_returnflag": "l_returnflag",
    "rev": REVENUE,
    "l_shipdate": "l_shipdate",
}
LINES_SQL = sql_select(LINE_FEATURES, "lineitem")


def lines(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    df = picked(table(spark, folder, "lineitem"), LINE_FEATURES)
    return df.select(*cols) if cols else df


def hash_sql(key: str, seed: int = 42) -> str:
    key = f"({key})::BIGINT"
    upper = f"(xor(({key} >> 31) & 2147483647, {key} >> 62) * 1540483477) & 2147483647"
    h = f"(((xor({key} & 2147483647, {upper}) + {seed}) * 2654435761) % 4294967296)"
    return f"(xor({h}, {h} >> 15) * 1540483477) % 4294967296"
