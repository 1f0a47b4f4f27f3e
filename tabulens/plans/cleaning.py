"""Queries: dropping, filling, sampling, derived columns, transforms, label codes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.operators import clean as C
from tabulens.operators import engineer as E
from tabulens.functions.hashing import sample_n
from tabulens.plans import plan, union
from tabulens.plans.inputs import GAPS_SQL, ORDER_GAPS, gaps, hash_sql, picked
from tabulens.sources.tables import table


@plan("drop_columns", f"SELECT o_orderkey, o_totalprice, is_open FROM ({GAPS_SQL})")
def drop_columns(spark, folder):
    return C.drop_columns(gaps(spark, folder), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@plan("drop_feature", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def drop_feature(spark, folder):
    return C.drop_feature(table(spark, folder, "part"), "p_type")


@plan(
    "drop_rows_missing",
    f"SELECT * FROM ({GAPS_SQL}) WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL",
)
def drop_rows_missing(spark, folder):
    return C.drop_rows_missing(gaps(spark, folder), ["o_custkey", "o_totalprice"])


@plan(
    "fill_mean",
    f"""WITH t AS ({GAPS_SQL}) SELECT o_orderkey,
    round(coalesce(o_custkey, (SELECT avg(o_custkey) FROM t)), 4) AS o_custkey,
    round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) AS o_totalprice, o_orderstatus FROM t""",
)
def fill_mean(spark, folder):
    out = C.fill_mean(gaps(spark, folder), ["o_custkey", "o_totalprice", "o_orderstatus"])
    return out.select(
        "o_orderkey",
        F.round("o_custkey", 4).alias("o_custkey"),
        F.round("o_totalprice", 4).alias("o_totalprice"),
        "o_orderstatus",
    )


@plan(
    "fill_median",
    f"""WITH t AS ({GAPS_SQL}) SELECT o_orderkey,
    coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM t)) AS o_custkey,
    round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 4) AS o_totalprice FROM t""",
)
def fill_median(spark, folder):
    out = C.fill_median(gaps(spark, folder), ["o_custkey", "o_totalprice"])
    return out.select("o_orderkey", "o_custkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def _mode(c):
    return f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@plan(
    "fill_mode",
    f"""WITH t AS ({GAPS_SQL}) SELECT o_orderkey, coalesce(o_orderstatus, {_mode('o_orderstatus')}) AS o_orderstatus,
    coalesce(o_orderpriority, {_mode('o_orderpriority')}) AS o_orderpriority,
    coalesce(o_custkey, {_mode('o_custkey')}) AS o_custkey FROM t""",
)
def fill_mode(spark, folder):
    out = C.fill_mode(gaps(spark, folder), ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")


@plan(
    "fill_constant",
    f"""SELECT o_orderkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority,
    coalesce(o_totalprice, -1.5) AS o_totalprice FROM ({GAPS_SQL})""",
)
def fill_constant(spark, folder):
    out = C.fill_constant(gaps(spark, folder), "o_orderpriority", "unknown")
    return C.fill_constant(out, "o_totalprice", "-1.5").select(
        "o_orderkey", "o_orderpriority", "o_totalprice"
    )


STRATEGIES = {
    "is_open": "drop_col",
    "o_custkey": "drop_rows",
    "o_totalprice": "median",
    "o_orderstatus": "mode",
    "o_orderpriority": "constant:none given",
}


@plan(
    "clean_missing",
    f"""WITH t AS (SELECT * EXCLUDE (is_open) FROM ({GAPS_SQL}) WHERE o_custkey IS NOT NULL)
    SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, {_mode('o_orderstatus')}) AS o_orderstatus,
    round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 4) AS o_totalprice,
    coalesce(o_orderpriority, 'none given') AS o_orderpriority FROM t""",
)
def clean_missing(spark, folder):
    out = C.clean_missing(gaps(spark, folder), STRATEGIES)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@plan(
    "clean_summary",
    f"""SELECT count(*) AS rows_before, count(*) - count(o_custkey) AS rows_dropped,
    CAST(1 AS BIGINT) AS cols_dropped FROM ({GAPS_SQL})""",
)
def clean_summary(spark, folder):
    return C.clean_summary(gaps(spark, folder), STRATEGIES)


@plan(
    "default_strategies",
    f"WITH t AS ({GAPS_SQL})\n"
    + union(
        f"""SELECT '{c}' AS "column", '{'mode' if c in ('o_orderstatus', 'o_orderpriority') else 'median'}' AS strategy
        FROM t HAVING count(*) > count({c})"""
        for c in ORDER_GAPS
    ),
)
def default_strategies(spark, folder):
    return C.default_strategies(gaps(spark, folder))


@plan(
    "sample_n",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 250",
)
def sample(spark, folder):
    return sample_n(table(spark, folder, "orders"), 250, "o_orderkey").select("o_orderkey", "o_totalprice")


@plan(
    "select_features_cols",
    "SELECT c_acctbal, CAST(NULL AS DOUBLE) AS c_credit, c_custkey, CAST(NULL AS VARCHAR) AS c_region FROM customer",
)
def select_features_cols(spark, folder):
    wanted = {
        "c_acctbal": T.DoubleType(),
        "c_credit": T.DoubleType(),
        "c_custkey": T.LongType(),
        "c_region": T.StringType(),
    }
    return C.select_features_cols(table(spark, folder, "customer"), wanted)


# --- derived columns: every row of lineitem, compared through its values -------------------------

PAIRS = {
    "eng_add": (E.eng_add, "l_extendedprice + l_tax"),
    "eng_subtract": (E.eng_subtract, "l_extendedprice - l_tax"),
    "eng_multiply": (E.eng_multiply, "l_extendedprice * l_tax"),
    "eng_divide": (E.eng_divide, "CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END"),
}


def _pair_plan(name, fn, text):
    @plan(name, f"SELECT l_orderkey, l_linenumber, round({text}, 6) AS derived FROM lineitem")
    def run(spark, folder):
        out = fn(table(spark, folder, "lineitem"), "l_extendedprice", "l_tax", "derived")
        return out.select("l_orderkey", "l_linenumber", F.round("derived", 6).alias("derived"))


for _name, (_fn, _text) in PAIRS.items():
    _pair_plan(_name, _fn, _text)


@plan("tx_log1p", "SELECT event_id, round(ln(1 + value), 8) AS value_log1p FROM events")
def tx_log1p(spark, folder):
    out = E.tx_log1p(table(spark, folder, "events"), "value")
    return out.select("event_id", F.round("value_log1p", 8).alias("value_log1p"))


@plan("tx_sqrt", "SELECT event_id, round(sqrt(value), 8) AS value_sqrt FROM events")
def tx_sqrt(spark, folder):
    out = E.tx_sqrt(table(spark, folder, "events"), "value")
    return out.select("event_id", F.round("value_sqrt", 8).alias("value_sqrt"))


@plan("tx_square", "SELECT c_custkey, round(c_acctbal * c_acctbal, 3) AS c_acctbal_sq FROM customer")
def tx_square(spark, folder):
    out = E.tx_square(table(spark, folder, "customer"), "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal_sq", 3).alias("c_acctbal_sq"))


@plan(
    "tx_reciprocal",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN NULL ELSE 1 / l_discount END, 6) AS l_discount_inv FROM lineitem",
)
def tx_reciprocal(spark, folder):
    out = E.tx_reciprocal(table(spark, folder, "lineitem"), "l_discount")
    return out.select("l_orderkey", "l_linenumber", F.round("l_discount_inv", 6).alias("l_discount_inv"))


@plan(
    "tx_yeo_johnson",
    """SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.7) - 1) / 0.7
    ELSE -(pow(1 - c_acctbal, 1.3) - 1) / 1.3 END, 5) AS c_acctbal_yj FROM customer""",
)
def tx_yeo_johnson(spark, folder):
    out = E.tx_yeo_johnson(table(spark, folder, "customer"), "c_acctbal", lam=0.7)
    return out.select("c_custkey", F.round("c_acctbal_yj", 5).alias("c_acctbal_yj"))


@plan("tx_yeo_johnson_fit")
def tx_yeo_johnson_fit(spark, folder):
    out = E.tx_yeo_johnson(table(spark, folder, "events"), "value")
    return out.select("event_id", F.round("value_yj", 4).alias("value_yj"))


def _edges(c, n, source):
    probs = ", ".join(f"{i}/{n}.0" for i in range(n + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) FROM {source})"


def _code(c, edges):
    return f"len(list_filter(list_slice({edges}, 2, len({edges}) - 1), lambda b: b < {c}))"


@plan(
    "tx_quantile_bin",
    f"""WITH e AS (SELECT {_edges('value', 7, 'events')} AS edges)
    SELECT event_id, CAST({_code('value', 'edges')} AS INT) AS value_bin7 FROM events, e""",
)
def tx_quantile_bin(spark, folder):
    return E.tx_quantile_bin(table(spark, folder, "events"), "value", 7).select("event_id", "value_bin7")


@plan(
    "tx_quantile_bin_ties",
    f"""WITH e AS (SELECT {_edges('l_linenumber', 12, 'lineitem')} AS edges)
    SELECT l_orderkey, l_linenumber, CAST({_code('l_linenumber', 'edges')} AS INT) AS l_linenumber_bin12 FROM lineitem, e""",
)
def tx_quantile_bin_ties(spark, folder):
    out = E.tx_quantile_bin(table(spark, folder, "lineitem"), "l_linenumber", 12)
    return out.select("l_orderkey", "l_linenumber", "l_linenumber_bin12")


@plan(
    "tx_width_bin",
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, CAST(len(list_filter(range(1, 8), lambda i: value > lo + (hi - lo) * i / 8)) AS INT) AS value_bin8
    FROM events, r""",
)
def tx_width_bin(spark, folder):
    return E.tx_width_bin(table(spark, folder, "events"), "value", 8).select("event_id", "value_bin8")


@plan(
    "tx_clip",
    """WITH r AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
    SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value_clipped
    FROM events, r""",
)
def tx_clip(spark, folder):
    out = E.tx_clip(table(spark, folder, "events"), "value")
    return out.select("event_id", F.round("value_clipped", 6).alias("value_clipped"))


@plan(
    "tx_polynomial",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) AS l_quantity_sq,
    round(l_discount * l_discount, 6) AS l_discount_sq, round(l_tax * l_tax, 6) AS l_tax_sq,
    round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
    round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem""",
)
def tx_polynomial(spark, folder):
    src = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    out = E.tx_polynomial(src, ["l_quantity", "l_discount", "l_tax"])
    new = [c for c in out.columns if c not in src.columns]
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in new])


_LABEL = "coalesce(o_orderstatus, '__MISSING__')"


@plan(
    "label_encode",
    f"""SELECT o_orderkey, dense_rank() OVER (ORDER BY {_LABEL}) - 1 AS o_orderstatus_code FROM ({GAPS_SQL})""",
)
def label_encode(spark, folder):
    return E.label_encode(gaps(spark, folder), "o_orderstatus").select("o_orderkey", "o_orderstatus_code")


@plan(
    "label_encode_names",
    "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_code FROM customer",
)
def label_encode_names(spark, folder):
    return E.label_encode(table(spark, folder, "customer"), "c_name").select("c_custkey", "c_name_code")


@plan("label_decode", f"SELECT o_orderkey, {_LABEL} AS status FROM ({GAPS_SQL})")
def label_decode(spark, folder):
    src = gaps(spark, folder)
    classes = E.label_classes(src, "o_orderstatus")
    coded = E.attach_code(src, "o_orderstatus", classes, "code")
    return E.label_decode(coded, "code", classes, "status").select("o_orderkey", "status")


@plan(
    "to_numeric_coerce",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 7.5 ELSE CAST(o_custkey AS DOUBLE) END AS cust FROM orders",
)
def to_numeric_coerce(spark, folder):
    text = {
        "o_orderkey": "o_orderkey",
        "cust": "CASE WHEN o_orderkey % 9 = 0 THEN 'not known' ELSE CAST(o_custkey AS STRING) END",
    }
    return E.to_numeric_coerce(picked(table(spark, folder, "orders"), text), "cust", 7.5)
