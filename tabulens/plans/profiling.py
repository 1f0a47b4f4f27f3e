"""Queries: sources, schema, profile, missing values, targets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulens.operators import profile as P
from tabulens.plans import plan, union
from tabulens.plans.inputs import GAPS_SQL, ORDER_GAPS, gaps, hash_sql, picked, sql_select
from tabulens.session import shared_dir
from tabulens.sources import tables as S

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@plan("read_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_parquet(spark, folder):
    return S.read_parquet(spark, f"{folder}/customer.parquet")


@plan(
    "read_csv",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def read_csv(spark, folder):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    src = S.table(spark, folder, "customer").withColumn(
        "c_mktsegment", F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'N/A' ELSE c_mktsegment END")
    )
    src.write.option("header", True).csv(path)
    return S.read_csv(spark, path)


TEXTS = {
    "o_orderkey": "CAST(o_orderkey AS {s})",
    "price": "CASE WHEN o_orderkey % 10 = 0 THEN 'NaN' ELSE CAST(o_totalprice AS {s}) END",
    "cust": "CASE WHEN o_orderkey % 9 = 0 THEN 'NA' ELSE CAST(o_custkey AS {s}) END",
    "wide_id": "CAST(1234567890123456789 + o_orderkey AS {s})",
    "flag": "CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END",
    "status": "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE o_orderstatus END",
    "nothing": "CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE 'None' END",
}
TOKENS_SQL = ", ".join(f"'{t}'" for t in S.NA_TOKENS)


def _texts(kind):
    return {k: v.format(s=kind) for k, v in TEXTS.items()}


def _no_tokens(c):
    return f"CASE WHEN trim({c}) IN ({TOKENS_SQL}) THEN NULL ELSE {c} END"


TEXT_SQL = sql_select(_texts("VARCHAR"), "orders")
CLEAN_SQL = f"SELECT {', '.join(f'{_no_tokens(c)} AS {c}' for c in TEXTS)} FROM ({TEXT_SQL})"


@plan(
    "na_tokens",
    f"SELECT o_orderkey, cust, flag, status, nothing FROM ({CLEAN_SQL})",
)
def na_tokens(spark, folder):
    texts = picked(S.table(spark, folder, "orders"), _texts("STRING"))
    return S.na_tokens(texts).select("o_orderkey", "cust", "flag", "status", "nothing")


@plan(
    "infer_schema",
    f"WITH t AS ({CLEAN_SQL})\n"
    + union(
        f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'double'
        WHEN bool_and(lower({c}) IN ('true', 'false')) THEN 'boolean'
        WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN 'bigint'
        WHEN bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN 'double'
        ELSE 'string' END AS type FROM t WHERE {c} IS NOT NULL"""
        for c in TEXTS
    ),
)
def infer_schema(spark, folder):
    texts = picked(S.table(spark, folder, "orders"), _texts("STRING"))
    return S.infer_schema(S.na_tokens(texts))


@plan(
    "validate_dataset",
    """SELECT 'column_exists' AS "check", 'column ''l_margin'' not found' AS message
       FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0""",
)
def validate_dataset(spark, folder):
    return S.validate_dataset(S.table(spark, folder, "lineitem"), ["l_quantity", "l_margin"])


def _dtype_sql(c):
    full, gap = {
        "o_orderkey": ("int64", "float64"),
        "o_custkey": ("int64", "float64"),
        "o_totalprice": ("float64", "float64"),
        "is_open": ("bool", "object"),
    }.get(c, ("object", "object"))
    return f"CASE WHEN count(*) > count({c}) THEN '{gap}' ELSE '{full}' END"


@plan(
    "effective_dtype",
    f"WITH t AS ({GAPS_SQL})\n"
    + union(f"SELECT '{c}' AS \"column\", {_dtype_sql(c)} AS dtype FROM t" for c in ORDER_GAPS),
)
def effective_dtype(spark, folder):
    return P.effective_dtype(gaps(spark, folder))


CLASSIFY = {
    **ORDER_GAPS,
    "month": "CAST(o_orderkey % 12 AS INT)",
    "day_text": "substring(CAST(o_orderdate AS {s}), 1, 10)",
    "o_orderdate": "o_orderdate",
}


def _int_label(c):
    return f"CASE WHEN count(*) > count({c}) THEN 'float' WHEN count(DISTINCT {c}) <= 20 THEN 'integer (categorical)' ELSE 'integer' END"


def _text_label(c):
    return f"""(SELECT CASE WHEN bool_and(try_strptime(v, '%Y-%m-%d') IS NOT NULL)
        THEN 'datetime (string)' ELSE 'text / categorical' END
        FROM (SELECT {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 5))"""


_LABELS = {
    "o_orderkey": ("int64", "float64", _int_label("o_orderkey")),
    "o_custkey": ("int64", "float64", _int_label("o_custkey")),
    "o_orderstatus": ("object", "object", _text_label("o_orderstatus")),
    "o_totalprice": ("float64", "float64", "'float'"),
    "is_open": (
        "bool",
        "object",
        "CASE WHEN count(*) > count(is_open) THEN 'text / categorical' ELSE 'boolean' END",
    ),
    "o_orderpriority": ("object", "object", _text_label("o_orderpriority")),
    "month": ("int64", "float64", _int_label("month")),
    "day_text": ("object", "object", _text_label("day_text")),
    "o_orderdate": ("datetime64[ns]", "datetime64[ns]", "'datetime'"),
}


@plan(
    "classify_columns",
    "WITH t AS ("
    + sql_select({k: v.format(s="VARCHAR") for k, v in CLASSIFY.items()}, "orders")
    + ")\n"
    + union(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(*) > count({c}) THEN '{b}' ELSE '{a}' END AS dtype, {e} AS column_type FROM t"
        for c, (a, b, e) in _LABELS.items()
    ),
)
def classify_columns(spark, folder):
    src = {k: v.format(s="STRING") for k, v in CLASSIFY.items()}
    return P.classify_columns(picked(S.table(spark, folder, "orders"), src))


def _numeric_sql(c, source):
    x = f"CAST({c} AS DOUBLE)"
    skew = f"round(coalesce(skewness({x}), 0), 6)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(sum({x}), 2) AS sum,
    round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean,
    round(stddev_samp({x}), 6) AS std, round(quantile_cont({x}, 0.5), 6) AS median,
    round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.75), 6) AS q75,
    {skew} AS skewness, round(coalesce(kurtosis({x}), 0), 6) AS kurtosis,
    CASE WHEN abs({skew}) > 1 AND min({c}) > 0 THEN 'log'
         WHEN abs({skew}) > 1 AND min({c}) >= 0 THEN 'sqrt' ELSE 'none' END AS suggested_transform
    FROM {source}"""


@plan("profile_numeric", union(_numeric_sql(c, "lineitem") for c in LINE_NUMBERS))
def profile_numeric(spark, folder):
    out = P.profile_numeric(S.table(spark, folder, "lineitem"))
    return out.withColumn("sum", F.round("sum", 2))


SKEWED = [("events", "value"), ("documents", "n_chars"), ("customer", "c_acctbal")]


def _skewed(spark, folder, fn):
    out = None
    for t, c in SKEWED:
        part = fn(S.table(spark, folder, t), [c])
        out = part if out is None else out.unionByName(part)
    return out


@plan(
    "skew_g1",
    union(
        f"SELECT '{c}' AS \"column\", round(skewness(CAST({c} AS DOUBLE)), 6) AS skewness FROM {t}"
        for t, c in SKEWED
    ),
)
def skew_g1(spark, folder):
    return _skewed(spark, folder, P.shape_statistics).select("column", "skewness")


@plan(
    "kurt_g2",
    union(
        f"SELECT '{c}' AS \"column\", round(kurtosis(CAST({c} AS DOUBLE)), 5) AS kurtosis FROM {t}"
        for t, c in SKEWED
    ),
)
def kurt_g2(spark, folder):
    out = _skewed(spark, folder, P.shape_statistics)
    return out.select("column", F.round("kurtosis", 5).alias("kurtosis"))


@plan(
    "suggest_transform",
    union(
        f"""SELECT '{c}' AS "column", CASE WHEN abs(skewness({c})) > 1 AND min({c}) > 0 THEN 'log'
        WHEN abs(skewness({c})) > 1 AND min({c}) >= 0 THEN 'sqrt' ELSE 'none' END AS suggested_transform FROM {t}"""
        for t, c in SKEWED
    ),
)
def suggest_transform(spark, folder):
    return _skewed(spark, folder, P.transform_suggestions)


@plan(
    "skew_severity",
    union(
        f"""SELECT '{c}' AS "column", CASE WHEN abs(skewness({c})) > 2 THEN 'high'
        WHEN abs(skewness({c})) > 1 THEN 'moderate' ELSE 'ok' END AS severity FROM {t}"""
        for t, c in SKEWED
    ),
)
def skew_severity(spark, folder):
    return P.skew_severity(_skewed(spark, folder, P.shape_statistics)).select("column", "severity")


CATEGORICAL = ["o_orderstatus", "o_orderpriority"]


def _top_sql(c, source):
    return f"""SELECT '{c}' AS "column", {c} AS top_value, n AS top_value_count FROM
    (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""


@plan("profile_categorical", f"WITH t AS ({GAPS_SQL})\n" + union(_top_sql(c, "t") for c in CATEGORICAL))
def profile_categorical(spark, folder):
    return P.profile_categorical(gaps(spark, folder))


def _nulls_sql(c, source):
    return f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS missing_count,
    round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, count(*) > count({c}) AS has_missing FROM {source}"""


@plan("profile_nulls_distinct", f"WITH t AS ({GAPS_SQL})\n" + union(_nulls_sql(c, "t") for c in ORDER_GAPS))
def profile_nulls_distinct(spark, folder):
    return P.profile_nulls_distinct(gaps(spark, folder))


@plan("profile_lineitem_distinct", union(_nulls_sql(c, "lineitem") for c in LINE_COLUMNS))
def profile_lineitem_distinct(spark, folder):
    return P.profile_nulls_distinct(S.table(spark, folder, "lineitem"))


@plan(
    "missing_by_column",
    f"WITH t AS ({GAPS_SQL}) SELECT * FROM (\n"
    + union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM t"""
        for c in ORDER_GAPS
    )
    + ") WHERE missing_count > 0",
)
def missing_by_column(spark, folder):
    return P.missing_by_column(gaps(spark, folder))


_MISSES = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ORDER_GAPS)


@plan(
    "missing_totals",
    f"""WITH t AS (SELECT *, {_MISSES} AS misses FROM ({GAPS_SQL}))
    SELECT count(*) AS total_rows, CAST({len(ORDER_GAPS)} AS BIGINT) AS total_columns,
    CAST(sum(misses) AS BIGINT) AS total_missing_cells, count(*) * {len(ORDER_GAPS)} AS total_cells,
    round(sum(misses) * 100.0 / (count(*) * {len(ORDER_GAPS)}), 2) AS overall_missing_pct,
    CAST({' + '.join(f'max(CAST({c} IS NULL AS INT))' for c in ORDER_GAPS)} AS BIGINT) AS columns_with_missing,
    count_if(misses > 0) AS rows_with_any_missing, count_if(misses = 0) AS complete_rows FROM t""",
)
def missing_totals(spark, folder):
    return P.missing_totals(gaps(spark, folder))


@plan(
    "missing_heatmap",
    f"""WITH t AS (SELECT row_number() OVER (ORDER BY {hash_sql('o_orderkey')}, o_orderkey) - 1 AS "row", *
        FROM ({GAPS_SQL})), s AS (SELECT * FROM t WHERE "row" < 200)\n"""
    + union(
        f"SELECT CAST(\"row\" AS INT) AS \"row\", '{c}' AS \"column\", CAST({c} IS NULL AS INT) AS missing FROM s"
        for c in ORDER_GAPS
    ),
)
def missing_heatmap(spark, folder):
    return P.missing_heatmap(gaps(spark, folder), "o_orderkey")


_KINDS = {"o_orderstatus": "categorical", "o_orderpriority": "categorical", "is_open": "categorical"}


@plan(
    "dataset_overview",
    f"WITH t AS ({GAPS_SQL})\n"
    + union(
        f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", {_dtype_sql(c)} AS dtype,
        '{_KINDS.get(c, 'numeric')}' AS kind, count(*) AS "rows", CAST({len(ORDER_GAPS)} AS BIGINT) AS "columns" FROM t"""
        for i, c in enumerate(ORDER_GAPS)
    ),
)
def dataset_overview(spark, folder):
    return P.dataset_overview(gaps(spark, folder))


@plan("preview", f"SELECT * FROM ({GAPS_SQL}) ORDER BY o_orderkey LIMIT 10")
def preview(spark, folder):
    return P.preview(gaps(spark, folder), ["o_orderkey"])


DETECT = {
    **ORDER_GAPS,
    "month": "CAST(o_orderkey % 12 AS INT)",
    "month_gap": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS INT) END",
    "quarter": "CAST(o_orderkey % 4 AS DOUBLE)",
    "o_orderdate": "o_orderdate",
}


def _detect_sql(c, dtypes=None):
    full, gap = (dtypes or {}).get(c) or {
        "o_orderkey": ("int64", "float64"),
        "o_custkey": ("int64", "float64"),
        "month": ("int64", "float64"),
        "month_gap": ("int64", "float64"),
        "quarter": ("float64", "float64"),
        "o_totalprice": ("float64", "float64"),
        "is_open": ("bool", "object"),
        "o_orderdate": ("datetime64[ns]", "datetime64[ns]"),
    }.get(c, ("object", "object"))
    return f"""SELECT '{c}' AS "column", CASE WHEN count(*) > count({c}) THEN '{gap}' ELSE '{full}' END AS dtype,
    count(DISTINCT {c}) AS d, count({c}) AS n FROM t"""


_TYPE_RULE = """CASE WHEN dtype IN ('bool', 'object') THEN 'classification'
    WHEN dtype = 'int64' THEN CASE WHEN d <= 20 THEN 'classification' ELSE 'regression' END
    WHEN dtype = 'float64' THEN CASE WHEN d <= 5 THEN 'classification' ELSE 'regression' END
    ELSE CASE WHEN d / greatest(n, 1) > 0.05 THEN 'regression' ELSE 'classification' END END"""


@plan(
    "detect_problem_type",
    f"WITH t AS ({sql_select(DETECT, 'orders')})\nSELECT \"column\", dtype, {_TYPE_RULE} AS problem_type FROM (\n"
    + union(_detect_sql(c) for c in DETECT)
    + ")",
)
def detect_problem_type(spark, folder):
    src = picked(S.table(spark, folder, "orders"), DETECT)
    return P.detect_problem_type(src, src.columns)


@plan(
    "problem_hint",
    f"WITH t AS (SELECT * FROM labels)\nSELECT \"column\", dtype, {_TYPE_RULE} AS problem_type FROM ("
    + _detect_sql("toxic", {"toxic": ("int64", "float64")})
    + ")",
)
def problem_hint(spark, folder):
    return P.problem_hint(S.table(spark, folder, "labels"))


_LINE_TYPES = {
    **{c: ("int64", "float64") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")},
    **{c: ("float64", "float64") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    "l_shipdate": ("datetime64[ns]", "datetime64[ns]"),
}
TARGET_COLUMNS = [*LINE_COLUMNS, "price_class", "outcome"]
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in P.TARGET_WORDS) + "]"
TARGET_SRC = {
    **{c: c for c in LINE_COLUMNS},
    "price_class": "CAST(floor(l_extendedprice / 10000) AS INT)",
    "outcome": "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END",
}


@plan(
    "suggest_target",
    f"""WITH t AS ({sql_select(TARGET_SRC, 'lineitem')}), f AS (
    SELECT *, {_TYPE_RULE} AS problem_type FROM (
    {union(f"SELECT {i} AS pos, * FROM ({_detect_sql(c, {**_LINE_TYPES, 'price_class': ('int64', 'float64'), 'outcome': ('int64', 'float64')})})" for i, c in enumerate(TARGET_COLUMNS))})),
    s AS (SELECT "column", problem_type, d AS n_unique, dtype, pos, round(least(
      CASE WHEN list_contains({_WORDS_SQL}, lower("column")) THEN 0.5
           WHEN len(list_filter({_WORDS_SQL}, lambda w: contains(lower("column"), w))) > 0 THEN 0.3 ELSE 0 END::DOUBLE
      + (pos + 1) / {float(len(TARGET_COLUMNS))}::DOUBLE * 0.3::DOUBLE
      + CASE WHEN dtype IN ('int64', 'float64', 'bool') THEN 0.1 ELSE 0 END::DOUBLE
      + CASE WHEN d BETWEEN 2 AND 20 THEN 0.1 ELSE 0 END::DOUBLE, 1.0::DOUBLE), 4) AS confidence FROM f)
    SELECT "column", confidence, problem_type, n_unique, dtype FROM s ORDER BY confidence DESC, pos LIMIT 3""",
)
def suggest_target(spark, folder):
    return P.suggest_target(picked(S.table(spark, folder, "lineitem"), TARGET_SRC))


@plan(
    "class_balance",
    """WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM labels GROUP BY quality)
    SELECT class, count, round((SELECT max(count) * 1.0 / min(count) FROM c), 4)::DOUBLE AS imbalance_ratio,
    (SELECT max(count) * 1.0 / min(count) FROM c) > 3 AS is_severe, (SELECT count(*) FROM c) AS n_classes FROM c""",
)
def class_balance(spark, folder):
    return P.class_balance(S.table(spark, folder, "labels"), "quality")
