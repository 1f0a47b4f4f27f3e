"""Queries: metrics, curves, confusion, bootstrap and drift on scored frames built from lineitem."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulens.operators import drift as D
from tabulens.operators import meta as MT
from tabulens.operators import metrics as M
from tabulens.plans import plan, union
from tabulens.plans.inputs import LINE_KEY, REVENUE, hash_sql, picked, sql_select
from tabulens.sources.tables import table

CLASSES = ["A", "N", "R"]


def _prob(c, other):
    return f"floor((CASE WHEN l_returnflag = '{c}' THEN 0.3 ELSE 0.2 END + {other}) * 1000) / 1000"


SCORED = {
    "k": LINE_KEY,
    "actual": "CASE WHEN l_extendedprice * (1 - l_discount) > 30000 THEN 1 ELSE 0 END",
    "predicted": "CASE WHEN l_extendedprice > 33000 THEN 1 ELSE 0 END",
    "score": "floor((l_extendedprice / 110000 + l_tax * 5 + l_discount * 3) / 2 * 1000) / 1000",
    "y": REVENUE,
    "fit": "l_extendedprice",
    "flag": "l_returnflag",
    "flag_fit": "CASE WHEN l_linenumber = 3 THEN 'A' WHEN l_linenumber = 5 THEN 'N' ELSE l_returnflag END",
    "p_a": _prob("A", "l_tax * 3"),
    "p_n": _prob("N", "l_discount * 2"),
    "p_r": _prob("R", "l_quantity / 200"),
}
SCORED_SQL = sql_select(SCORED, "lineitem")


def scored(spark, folder):
    return picked(table(spark, folder, "lineitem"), SCORED)


@plan(
    "metrics_regression",
    f"""SELECT count(*) AS n_samples, round(1 - sum((y - fit) * (y - fit)) / (var_pop(y) * count(*)), 6) AS r2,
    round(avg(abs(y - fit)), 4) AS mae, round(sqrt(avg((y - fit) * (y - fit))), 4) AS rmse FROM ({SCORED_SQL})""",
)
def metrics_regression(spark, folder):
    out = M.metrics_regression(scored(spark, folder), "y", "fit")
    return out.select("n_samples", "r2", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


def _f1_sql(actual, predicted, source):
    return f"""WITH t AS (SELECT {actual} AS a, {predicted} AS p FROM {source}),
    c AS (SELECT a AS c, count(*) AS s, count(*) FILTER (a = p) AS tp,
          (SELECT count(*) FROM t q WHERE q.p = t.a) AS pr FROM t GROUP BY a)
    SELECT CAST(sum(s) AS BIGINT) AS n_samples, round(sum(tp) / sum(s), 6) AS accuracy,
    round(sum(s * 2 * tp / (s + pr)) / sum(s), 6) AS f1 FROM c"""


@plan("metrics_classification", _f1_sql("actual", "predicted", f"({SCORED_SQL})"))
def metrics_classification(spark, folder):
    return M.metrics_classification(scored(spark, folder), "actual", "predicted")


@plan("metrics_multiclass", _f1_sql("flag", "flag_fit", f"({SCORED_SQL})"))
def metrics_multiclass(spark, folder):
    return M.metrics_classification(scored(spark, folder), "flag", "flag_fit")


def _auc_expr(y, s):
    return f"""(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT {y} AS y,
    rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r FROM t))"""


@plan(
    "roc_auc",
    f"WITH t AS ({SCORED_SQL}) SELECT round({_auc_expr('actual', 'score')}, 6) AS roc_auc",
)
def roc_auc(spark, folder):
    return M.roc_auc(scored(spark, folder), "actual", "score")


def _curve_cte(tag, y, s, points, source="t"):
    """CTEs ending in ``curve_<tag>`` (point, fpr, tpr)."""
    return f"""c_{tag} AS (SELECT {s} AS s, count(*) FILTER ({y}) AS pos, count(*) FILTER (NOT ({y})) AS neg FROM {source} GROUP BY 1),
    o_{tag} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS p2, lead(neg) OVER w AS n2,
      row_number() OVER w AS i FROM c_{tag} WINDOW w AS (ORDER BY s DESC)),
    k_{tag} AS (SELECT tp, fp, row_number() OVER (ORDER BY i) AS point FROM o_{tag} WHERE i = 1 OR p2 IS NULL OR pos <> p2 OR neg <> n2
      UNION ALL SELECT 0, 0, 0),
    l_{tag} AS (SELECT max(point) AS l, max(tp) AS p, max(fp) AS n FROM k_{tag}),
    curve_{tag} AS (SELECT point, round(fp / n, 4) AS fpr, round(tp / p, 4) AS tpr FROM k_{tag}, l_{tag} WHERE l < {points} OR point = l
      OR point IN (SELECT floor(j * (l / {points - 1}.0::DOUBLE))::BIGINT FROM l_{tag}, (SELECT unnest(range({points - 1})) AS j)))"""


@plan(
    "roc_curve",
    f"WITH t AS ({SCORED_SQL}), {_curve_cte('b', 'actual = 1', 'score', 200)} SELECT point, fpr, tpr FROM curve_b",
)
def roc_curve(spark, folder):
    return M.roc_curve(scored(spark, folder), "actual", "score", M.ROC_TRAIN_POINTS)


@plan(
    "roc_curve_evaluate",
    f"WITH t AS ({SCORED_SQL}), {_curve_cte('b', 'actual = 1', 'score', 100)} SELECT point, fpr, tpr FROM curve_b",
)
def roc_curve_evaluate(spark, folder):
    return M.roc_curve(scored(spark, folder), "actual", "score", M.ROC_EVAL_POINTS)


_PROBS = dict(zip(CLASSES, ("p_a", "p_n", "p_r")))
_OVR = f"WITH t AS ({SCORED_SQL}), " + ", ".join(
    _curve_cte(c, f"flag = '{c}'", p, 200) for c, p in _PROBS.items()
)


def _ovr_auc(c):
    return f"round({_auc_expr(f'(flag = {chr(39)}{c}{chr(39)})::INT', _PROBS[c])}, 4)"


@plan(
    "roc_ovr",
    f"{_OVR}\n" + union(f"SELECT '{c}' AS label, point, fpr, tpr, {_ovr_auc(c)} AS auc FROM curve_{c}" for c in CLASSES),
)
def roc_ovr(spark, folder):
    src = scored(spark, folder).withColumn("probs", F.array("p_a", "p_n", "p_r"))
    return M.roc_ovr(src, "flag", "probs", CLASSES)


@plan(
    "roc_align",
    f"""{_OVR}, v AS ({union(f"SELECT '{c}' AS label, fpr, tpr FROM curve_{c}" for c in CLASSES)}),
    f AS (SELECT DISTINCT fpr AS spot FROM v UNION SELECT 0 UNION SELECT 1),
    j AS (SELECT spot, label, tpr, row_number() OVER (PARTITION BY spot, label ORDER BY abs(fpr - spot), fpr, tpr) AS r
          FROM f JOIN v ON abs(fpr - spot) < 0.02)
    SELECT spot AS fpr, label, tpr FROM j WHERE r = 1""",
)
def roc_align(spark, folder):
    src = scored(spark, folder).withColumn("probs", F.array("p_a", "p_n", "p_r"))
    return M.roc_align(M.roc_ovr(src, "flag", "probs", CLASSES).select("label", "fpr", "tpr"))


_CONFUSION = f"""WITH t AS ({SCORED_SQL}), l AS (SELECT flag AS l FROM t UNION SELECT flag_fit FROM t),
    m AS (SELECT a.l AS actual, p.l AS predicted, (SELECT count(*) FROM t WHERE flag = a.l AND flag_fit = p.l) AS n FROM l a, l p)"""


@plan("confusion_matrix", f"{_CONFUSION} SELECT actual, predicted, n FROM m")
def confusion_matrix(spark, folder):
    return M.confusion_matrix(scored(spark, folder), "flag", "flag_fit")


@plan(
    "confusion_row_pct",
    f"{_CONFUSION} SELECT actual, predicted, n, round(n * 100.0 / sum(n) OVER (PARTITION BY actual), 2) AS pct FROM m",
)
def confusion_row_pct(spark, folder):
    return M.confusion_row_pct(M.confusion_matrix(scored(spark, folder), "flag", "flag_fit"))


@plan(
    "calibration_curve",
    f"""SELECT CAST(len(list_filter(range(1, 10), lambda i: score > i / 10)) AS INT) AS bin, round(avg(score), 6) AS mean_predicted,
    round(avg(actual), 6) AS fraction_of_positives FROM ({SCORED_SQL}) GROUP BY 1""",
)
def calibration_curve(spark, folder):
    return M.calibration_curve(scored(spark, folder), "actual", "score")


# the order key of these samples must be unique, so they use orders
_ORDERS = {"o_orderkey": "o_orderkey", "actual": "o_totalprice", "predicted": "o_totalprice * 0.9 + o_custkey"}


@plan(
    "predictions_sample",
    f"""SELECT actual, round(predicted, 4) AS predicted FROM ({sql_select(_ORDERS, 'orders')})
    ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 500""",
)
def predictions_sample(spark, folder):
    src = picked(table(spark, folder, "orders"), _ORDERS)
    out = M.predictions_sample(src, "actual", "predicted", "o_orderkey")
    return out.withColumn("predicted", F.round("predicted", 4))


@plan(
    "residuals",
    f"SELECT round(fit, 4) AS fitted, round(y - fit, 6) AS residual FROM ({SCORED_SQL})",
)
def residuals(spark, folder):
    out = M.residuals(scored(spark, folder), "y", "fit")
    return out.withColumn("fitted", F.round("fitted", 4))


# --- bootstrap -----------------------------------------------------------------------------------------

_POISSON = " + ".join(
    f"(u >= {sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1))!r})::INT" for k in range(12)
)
_REPLICAS = """rep AS (SELECT x.*, b FROM {blocks} x, (SELECT unnest(range(500)) AS b)),
    u AS (SELECT *, ('0x' || substr(md5(concat_ws('_', block, b, 42)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM rep),
    w AS (SELECT *, {poisson} AS w FROM u)"""
_CI = "SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 3) AS ci_lower, round(quantile_cont({m}, 0.975), 3) AS ci_upper FROM v"


@plan(
    "bootstrap_ci",
    f"""WITH t AS (SELECT CAST(floor(({hash_sql('k')}) / 4294967296.0::DOUBLE * 1024) AS INT) AS block, y, fit, (SELECT avg(y) FROM ({SCORED_SQL})) AS c FROM ({SCORED_SQL})),
    s AS (SELECT block, count(*) AS n, sum(y - c) AS d, sum((y - c) * (y - c)) AS dd, sum(abs(y - fit)) AS ae,
          sum((y - fit) * (y - fit)) AS ee FROM t GROUP BY block),
    {_REPLICAS.format(blocks='s', poisson=_POISSON)},
    p AS (SELECT b, sum(w * n) AS n, sum(w * d) AS d, sum(w * dd) AS dd, sum(w * ae) AS ae, sum(w * ee) AS ee FROM w GROUP BY b),
    v AS (SELECT 1 - ee / (dd - d * d / n) AS r2, ae / n AS mae, sqrt(ee / n) AS rmse FROM p)\n"""
    + union(_CI.format(m=m) for m in ("r2", "mae", "rmse")),
)
def bootstrap_ci(spark, folder):
    out = M.bootstrap_ci(scored(spark, folder), "y", "fit", "k", "regression")
    return out.select("metric", *[F.round(c, 3).alias(c) for c in ("ci_lower", "ci_upper")])


@plan(
    "bootstrap_ci_class",
    f"""WITH s AS (SELECT CAST(floor(({hash_sql('k')}) / 4294967296.0::DOUBLE * 1024) AS INT) AS block, flag, flag_fit, count(*) AS n FROM ({SCORED_SQL}) GROUP BY ALL),
    {_REPLICAS.format(blocks='s', poisson=_POISSON)},
    c AS (SELECT b, flag AS a, flag_fit AS p, sum(w * n) AS n FROM w GROUP BY ALL),
    k AS (SELECT b, a AS l, sum(n) AS s, sum(n) FILTER (a = p) AS tp FROM c GROUP BY b, a),
    f AS (SELECT b, p AS l, sum(n) AS pr FROM c GROUP BY b, p),
    v AS (SELECT b, sum(tp) / sum(s) AS accuracy, sum(s * 2 * tp / (s + pr)) / sum(s) AS f1 FROM k JOIN f USING (b, l) GROUP BY b)\n"""
    + union(_CI.format(m=m) for m in ("accuracy", "f1")),
)
def bootstrap_ci_class(spark, folder):
    out = M.bootstrap_ci(scored(spark, folder), "flag", "flag_fit", "k", "classification")
    return out.select("metric", *[F.round(c, 3).alias(c) for c in ("ci_lower", "ci_upper")])


# --- drift -----------------------------------------------------------------------------------------------

CUTOFF = "TIMESTAMP '1995-06-17 00:00:00'"
SIDES = {
    "early": f"l_shipdate < {CUTOFF}",
    "l_quantity": "l_quantity",
    "l_extendedprice": f"CASE WHEN l_shipdate < {CUTOFF} THEN l_extendedprice ELSE l_extendedprice * 1.1 END",
    "l_tax": "l_tax",
    "l_returnflag": f"CASE WHEN l_shipdate >= {CUTOFF} AND l_returnflag = 'R' THEN 'X' ELSE l_returnflag END",
    "l_linestatus": "l_linestatus",
}
SIDES_SQL = sql_select(SIDES, "lineitem")
KS_COLUMNS = ["l_quantity", "l_extendedprice", "l_tax"]


def sides(spark, folder):
    exprs = {k: v.replace("TIMESTAMP ", "TIMESTAMP_NTZ ") for k, v in SIDES.items()}
    df = picked(table(spark, folder, "lineitem"), exprs)
    return df.where("early").drop("early"), df.where("not early").drop("early")


def _ks_sql(c):
    return f"""SELECT '{c}' AS feature, max(abs(a / n - b / m)) AS d, any_value(n) AS n, any_value(m) AS m FROM (
    SELECT sum(count(*) FILTER (early)) OVER w AS a, sum(count(*) FILTER (NOT early)) OVER w AS b,
    (SELECT count(*) FROM t WHERE early)::DOUBLE AS n, (SELECT count(*) FROM t WHERE NOT early)::DOUBLE AS m
    FROM t GROUP BY {c} WINDOW w AS (ORDER BY {c}))"""


_KS = f"""ks AS (SELECT feature, d, d * sqrt(n * m / (n + m)) AS lam FROM ({union(map(_ks_sql, KS_COLUMNS))})),
    kp AS (SELECT feature, d, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101),
      lambda i: (CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE * i * i * lam * lam))), 0), 1) END AS p FROM ks)"""


@plan(
    "drift_ks",
    f"""WITH t AS ({SIDES_SQL}), {_KS}
    SELECT feature, round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drifted FROM kp""",
)
def drift_ks(spark, folder):
    out = D.drift_ks(*sides(spark, folder), KS_COLUMNS)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("statistic", "p_value")], "drifted")


TEXT_COLUMNS = ["l_returnflag", "l_linestatus"]


@plan(
    "drift_chi2",
    f"WITH t AS ({SIDES_SQL})\n"
    + union(
        f"""SELECT '{c}' AS feature, round(sum((b - e) * (b - e) / e) / 1e6, 4) AS statistic_millions, count(*) - 1 AS dof FROM (
        SELECT count(*) FILTER (NOT early) AS b, greatest(count(*) FILTER (early) / (SELECT count(*) FROM t WHERE early)
        * (SELECT count(*) FROM t WHERE NOT early), 1e-9) AS e FROM t GROUP BY {c})"""
        for c in TEXT_COLUMNS
    ),
)
def drift_chi2(spark, folder):
    out = D.chi2_statistic(*sides(spark, folder), TEXT_COLUMNS)
    return out.select("feature", F.round(F.col("statistic") / 1e6, 4).alias("statistic_millions"), "dof")


_FEW = ["l_quantity", "l_tax"]


@plan(
    "drift_stored",
    f"""WITH t AS ({SIDES_SQL}), {_KS}
    SELECT feature, round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drifted, 0.0::DOUBLE AS error
    FROM kp WHERE feature IN ('l_quantity', 'l_tax')""",
)
def drift_stored(spark, folder):
    """Columns of few values, for which a stored distribution is the whole one."""
    train, other = sides(spark, folder)
    out = D.stored_ks(MT.fit_meta(train, None, _FEW), other, _FEW)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("statistic", "p_value")], "drifted", "error")


@plan("drift_report")
def drift_report(spark, folder):
    return D.drift_report(*sides(spark, folder), KS_COLUMNS + TEXT_COLUMNS)
