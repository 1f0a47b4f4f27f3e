"""Queries: preparation, correlation, feature scores, ranking, collinearity, lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulens.operators import correlation as K
from tabulens.operators import scatter as L
from tabulens.operators import scores as R
from tabulens.operators.ranks import avg_rank
from tabulens.plans import plan, union
from tabulens.plans.inputs import GAPS_SQL, LINES_SQL, gaps, hash_sql, lines
from tabulens.session import shared_dir
from tabulens.sources import sinks
from tabulens.sources.tables import table


def _median(c, source):
    return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {source})"


def _label(c):
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, '__MISSING__')) - 1 AS DOUBLE)"


@plan(
    "prepare_features",
    f"""WITH t AS ({GAPS_SQL}) SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey,
    coalesce(CAST(o_custkey AS DOUBLE), {_median('o_custkey', 't')}) AS o_custkey,
    {_label('o_orderpriority')} AS o_orderpriority, {_label('o_orderstatus')} AS o_orderstatus,
    round(coalesce(o_totalprice, {_median('o_totalprice', 't')}), 4) AS o_totalprice FROM t""",
)
def prepare_features(spark, folder):
    src = gaps(spark, folder).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"
    )
    return K.prepare_features(src, "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 4))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rev"]


def _matrix_sql(cols, source, expr):
    return union(
        f"SELECT '{a}' AS x, '{b}' AS y, round({expr(a, b)}, 4) AS value FROM {source}"
        for a in cols
        for b in cols
    )


def _corr(a, b):
    return f"corr({a}, {b})"


@plan("corr_pearson_matrix", f"WITH t AS ({LINES_SQL})\n" + _matrix_sql(CORR, "t", _corr))
def corr_pearson_matrix(spark, folder):
    return K.corr_pearson_matrix(lines(spark, folder), CORR)


@plan(
    "corr_pearson_mixed",
    f"""WITH g AS ({GAPS_SQL}), t AS (SELECT coalesce(CAST(o_custkey AS DOUBLE), {_median('o_custkey', 'g')}) AS o_custkey,
    coalesce(o_totalprice, {_median('o_totalprice', 'g')}) AS o_totalprice, {_label('o_orderpriority')} AS o_orderpriority FROM g)\n"""
    + _matrix_sql(["o_custkey", "o_totalprice", "o_orderpriority"], "t", _corr),
)
def corr_pearson_mixed(spark, folder):
    return K.corr_pearson_matrix(gaps(spark, folder), ["o_custkey", "o_totalprice", "o_orderpriority"])


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _ranked_sql(cols, source):
    return "SELECT " + ", ".join(f"CAST({_rank(c)} AS DOUBLE) AS {c}" for c in cols) + f" FROM {source}"


@plan(
    "corr_spearman_matrix",
    f"WITH t AS ({_ranked_sql(CORR, f'({LINES_SQL})')})\n" + _matrix_sql(CORR, "t", _corr),
)
def corr_spearman_matrix(spark, folder):
    return K.corr_spearman_matrix(lines(spark, folder), CORR)


TAU = {"c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal", "band": "CAST(floor(c_acctbal / 2000) AS INT)"}


def _tau_sql(a, b, source):
    return f"""SELECT '{a}' AS x, '{b}' AS y, round(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}))
    / sqrt(sum(abs(sign(p.{a} - q.{a}))) * sum(abs(sign(p.{b} - q.{b})))), 4) AS value FROM {source} p, {source} q"""


@plan(
    "corr_kendall_matrix",
    "WITH t AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in TAU.items()) + " FROM customer)\n"
    + union(_tau_sql(a, b, "t") for a in TAU for b in TAU),
)
def corr_kendall_matrix(spark, folder):
    src = table(spark, folder, "customer").selectExpr(*[f"{e} AS {n}" for n, e in TAU.items()])
    return K.corr_kendall_matrix(src)


@plan("corr_kendall_lineitem")
def corr_kendall_lineitem(spark, folder):
    return K.corr_kendall_matrix(lines(spark, folder), ["l_quantity", "l_extendedprice", "rev"])


@plan("avg_rank", f"SELECT k, l_tax, {_rank('l_tax')} AS l_tax_rank FROM ({LINES_SQL})")
def avg_rank_query(spark, folder):
    return avg_rank(lines(spark, folder, "k", "l_tax"), "l_tax")


@plan(
    "avg_rank_wide",
    f"SELECT k, round(rev, 6) AS rev, {_rank('rev')} AS rev_rank FROM ({LINES_SQL})",
)
def avg_rank_wide(spark, folder):
    out = avg_rank(lines(spark, folder, "k", "rev"), "rev")
    return out.withColumn("rev", F.round("rev", 6))


_MATRIX = f"WITH t AS ({LINES_SQL}), m AS ({_matrix_sql(CORR, 't', _corr)})"


@plan(
    "corr_top_pairs",
    f"{_MATRIX} SELECT x, y, value FROM m WHERE x < y ORDER BY abs(value) DESC, x, y LIMIT 6",
)
def corr_top_pairs(spark, folder):
    return K.corr_top_pairs(K.corr_pearson_matrix(lines(spark, folder), CORR))


@plan(
    "corr_strength",
    f"""{_MATRIX} SELECT x, y, value, CASE WHEN abs(value) >= 0.8 THEN 'very strong' WHEN abs(value) >= 0.6 THEN 'strong'
    WHEN abs(value) >= 0.4 THEN 'moderate' WHEN abs(value) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
    CASE WHEN abs(value) < 0.2 THEN 'none' WHEN value > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m""",
)
def corr_strength(spark, folder):
    return K.corr_strength(K.corr_pearson_matrix(lines(spark, folder), CORR))


# --- scores ------------------------------------------------------------------------------------------

REG = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
CLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rev"]
_REG_T = (
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, "
    f"{_label('l_returnflag')} AS l_returnflag, rev AS y FROM ({LINES_SQL})"
)
_CLS_T = (
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, rev, "
    f"{_label('l_returnflag')} AS y FROM ({LINES_SQL})"
)


def _reg(spark, folder):
    return K.prepare_features(lines(spark, folder, *REG, "rev"), "rev")


def _cls(spark, folder):
    return K.prepare_features(lines(spark, folder, *CLS, "l_returnflag"), "l_returnflag")


def _rounded(df, digits=5):
    return df.select("column", F.round("score", digits).alias("score"))


def _pearson_sql(cols, source):
    return union(f"SELECT '{c}' AS \"column\", abs(corr({c}, y)) AS score FROM {source}" for c in cols)


_RANKED = f"(SELECT {', '.join(f'CAST({_rank(c)} AS DOUBLE) AS {c}' for c in [*REG, 'y'])} FROM t)"


def _info_sql(cols, text, y_binned):
    """Plug-in information on 32 equal-frequency bins."""

    def code(c):
        probs = ", ".join(f"{i}/32.0" for i in range(33))
        edges = f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) FROM t)"
        return f"len(list_filter(list_slice({edges}, 2, len({edges}) - 1), lambda b: b < {c}))"

    codes = ", ".join(f"{c if c in text else code(c)} AS {c}" for c in cols)
    coded = f"(SELECT {codes}, {code('y') if y_binned else 'y'} AS y FROM t)"
    return union(
        f"""SELECT '{c}' AS "column", sum(n * ln(n * t / (nx * ny)) / t) AS score FROM (
        SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {c})::DOUBLE AS nx,
        sum(count(*)) OVER (PARTITION BY y)::DOUBLE AS ny, sum(count(*)) OVER ()::DOUBLE AS t FROM {coded} GROUP BY {c}, y)"""
        for c in cols
    )


_SCORE = 'SELECT "column", round(score, 5) AS score FROM ({})'


@plan("score_pearson", f"WITH t AS ({_REG_T}) " + _SCORE.format(_pearson_sql(REG, "t")))
def score_pearson(spark, folder):
    return _rounded(R.score_pearson(_reg(spark, folder), "rev"))


@plan("score_spearman", f"WITH t AS ({_REG_T}), r AS {_RANKED} " + _SCORE.format(_pearson_sql(REG, "r")))
def score_spearman(spark, folder):
    return _rounded(R.score_spearman(_reg(spark, folder), "rev"))


@plan(
    "score_mutual_info_reg",
    f"WITH t AS ({_REG_T}) " + _SCORE.format(_info_sql(REG, ["l_returnflag"], True)),
)
def score_mutual_info_reg(spark, folder):
    return _rounded(
        R.score_mutual_info(_reg(spark, folder), "rev", "regression", categories=["l_returnflag"])
    )


@plan("score_mutual_info_class", f"WITH t AS ({_CLS_T}) " + _SCORE.format(_info_sql(CLS, [], False)))
def score_mutual_info_class(spark, folder):
    return _rounded(R.score_mutual_info(_cls(spark, folder), "l_returnflag", "classification"))


def _anova_sql(c):
    return f"""SELECT '{c}' AS "column", (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM t) AS g FROM t GROUP BY y)"""


def _chi2_sql(c):
    return f"""SELECT '{c}' AS "column", sum((o - e) * (o - e) / e) AS score FROM (
    SELECT sum(x) AS o, count(*) * (SELECT sum({c} - s) FROM t, (SELECT least(min({c}), 0) AS s FROM t)) / (SELECT count(*) FROM t) AS e
    FROM (SELECT y, {c} - (SELECT least(min({c}), 0) FROM t) AS x FROM t) GROUP BY y)"""


@plan("score_anova_f", f"WITH t AS ({_CLS_T}) " + _SCORE.format(union(map(_anova_sql, CLS))))
def score_anova_f(spark, folder):
    return _rounded(R.score_anova_f(_cls(spark, folder), "l_returnflag"))


@plan(
    "score_chi2",
    f"WITH t AS ({_CLS_T}) " + 'SELECT "column", round(score, 4) AS score FROM (' + union(map(_chi2_sql, CLS)) + ")",
)
def score_chi2(spark, folder):
    return _rounded(R.score_chi2(_cls(spark, folder), "l_returnflag"), 4)


@plan("score_rf_importance")
def score_rf_importance(spark, folder):
    return _rounded(R.score_rf_importance(_reg(spark, folder), "rev", "regression"))


@plan("score_rf_importance_class")
def score_rf_importance_class(spark, folder):
    out = R.score_rf_importance(_cls(spark, folder), "l_returnflag", "classification", trees=20)
    return _rounded(out)


_RAW = (
    f"WITH t AS ({_REG_T}), r AS {_RANKED}, raw AS (\n"
    + union(
        f"SELECT \"column\", '{m}' AS method, score AS raw_score FROM ({q})"
        for m, q in (
            ("pearson", _pearson_sql(REG, "t")),
            ("spearman", _pearson_sql(REG, "r")),
            ("mutual_info", _info_sql(REG, ["l_returnflag"], True)),
        )
    )
    + """), norm AS (SELECT "column", method, raw_score, CASE WHEN max(raw_score) OVER w = min(raw_score) OVER w THEN 1
    ELSE (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) END AS score
    FROM raw WINDOW w AS (PARTITION BY method)),
    fin AS (SELECT "column", sum(score * CASE method WHEN 'pearson' THEN 0.3 ELSE 0.25 END) AS f FROM norm GROUP BY "column"),
    ranked AS (SELECT CAST(row_number() OVER (ORDER BY round(f, 6) DESC, "column") AS INT) AS rank, "column",
    round(f, 4) AS final_score FROM fin)"""
)
SQL_METHODS = ["pearson", "spearman", "mutual_info"]


def _normal(spark, folder):
    raw = R.raw_scores(_reg(spark, folder), "rev", "regression", ["l_returnflag"], methods=SQL_METHODS)
    return R.normalize_scores(raw)


@plan(
    "normalize_scores",
    f'{_RAW} SELECT "column", method, round(raw_score, 5) AS raw_score, round(score, 5) AS score FROM norm',
)
def normalize_scores(spark, folder):
    out = _normal(spark, folder)
    return out.select("column", "method", *[F.round(c, 5).alias(c) for c in ("raw_score", "score")])


@plan("weighted_rank", f'{_RAW} SELECT rank, "column", final_score FROM ranked')
def weighted_rank(spark, folder):
    out = R.weighted_rank(_normal(spark, folder), "regression")
    return out.withColumn("final_score", F.round("final_score", 4))


@plan(
    "corr_direction",
    f"WITH t AS ({_REG_T})\n"
    + union(
        f"SELECT '{c}' AS \"column\", CASE WHEN corr({c}, y) >= 0 THEN 'positive' ELSE 'negative' END AS correlation_direction FROM t"
        for c in REG
    ),
)
def corr_direction(spark, folder):
    return R.corr_direction(_reg(spark, folder), "rev", "regression")


def _ranking(spark, folder):
    return R.select_features(lines(spark, folder, *REG, "rev"), "rev", "regression", methods=SQL_METHODS)


@plan(
    "rank_views",
    f"""{_RAW} SELECT method, n."column" AS "column", round(score, 4) AS score FROM norm n JOIN ranked r ON n."column" = r."column" WHERE rank <= 5""",
)
def rank_views(spark, folder):
    out = R.rank_methods(_ranking(spark, folder), 5)
    return out.withColumn("score", F.round("score", 4))


@plan(
    "rank_top_band",
    f"""{_RAW} SELECT rank, "column", final_score, CASE WHEN final_score >= 0.7 THEN 'high' WHEN final_score >= 0.4 THEN 'medium'
    ELSE 'low' END AS band FROM ranked WHERE rank <= 3""",
)
def rank_top_band(spark, folder):
    out = R.weighted_rank(_normal(spark, folder), "regression")
    banded = R.score_band(R.rank_top(out, 3))
    return banded.withColumn("final_score", F.round("final_score", 4))


@plan("select_features")
def select_features(spark, folder):
    return R.select_features(lines(spark, folder, *REG, "rev"), "rev", trees=20)


@plan("select_features_class")
def select_features_class(spark, folder):
    return R.select_features(lines(spark, folder, *CLS, "l_returnflag"), "l_returnflag", trees=20)


@plan(
    "write_rankings",
    f"""{_RAW} SELECT CAST(r.rank AS INT) AS rank, r."column" AS "column", round(max(score) FILTER (method = 'pearson'), 4) AS pearson,
    round(max(score) FILTER (method = 'spearman'), 4) AS spearman FROM norm n JOIN ranked r ON n."column" = r."column" GROUP BY 1, 2""",
)
def write_rankings(spark, folder):
    path = f"{shared_dir(spark)}/rank-{uuid.uuid4().hex}"
    sinks.write_rankings(_ranking(spark, folder), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.select("rank", "column", *[F.round(c, 4).alias(c) for c in ("pearson", "spearman")])


# --- collinearity and lines ------------------------------------------------------------------------------


@plan(
    "vif",
    f"""WITH g AS (SELECT sum(l_extendedprice * l_extendedprice) AS a, sum(l_extendedprice * rev) AS b, sum(rev * rev) AS c FROM ({LINES_SQL}))
    SELECT unnest(['l_extendedprice', 'rev']) AS feature, round(a * c / (a * c - b * b), 3) AS vif FROM g""",
)
def vif(spark, folder):
    out = K.vif(lines(spark, folder), ["l_extendedprice", "rev"])
    return out.withColumn("vif", F.round("vif", 3))


@plan("vif_many")
def vif_many(spark, folder):
    return K.vif(lines(spark, folder), CORR)


@plan(
    "vif_band",
    f"""WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) AS c FROM ({LINES_SQL}))
    SELECT unnest(['l_quantity', 'l_tax']) AS feature, round(a * c / (a * c - b * b), 3) AS vif,
    CASE WHEN a * c / (a * c - b * b) < 5 THEN 'ok' WHEN a * c / (a * c - b * b) < 10 THEN 'warn' ELSE 'high' END AS band FROM g""",
)
def vif_band(spark, folder):
    out = K.vif_band(K.vif(lines(spark, folder), ["l_quantity", "l_tax"]))
    return out.withColumn("vif", F.round("vif", 3))


LINE_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plan(
    "linregress",
    f"WITH t AS ({LINES_SQL})\n"
    + union(
        f"""SELECT '{c}' AS feature, round(regr_slope(rev, {c}), 4) AS slope, round(regr_intercept(rev, {c}), 4) AS intercept,
        round(regr_r2(rev, {c}), 6) AS r_squared, min({c}) AS x0, max({c}) AS x1,
        round(regr_intercept(rev, {c}) + regr_slope(rev, {c}) * min({c}), 4) AS y0,
        round(regr_intercept(rev, {c}) + regr_slope(rev, {c}) * max({c}), 4) AS y1 FROM t"""
        for c in LINE_X
    ),
)
def linregress(spark, folder):
    out = L.linregress(lines(spark, folder), LINE_X, "rev").drop("p_value")
    four = ("slope", "intercept", "y0", "y1")
    return out.select(*[F.round(c, 4).alias(c) if c in four else c for c in out.columns])


@plan("linregress_p")
def linregress_p(spark, folder):
    return L.linregress(lines(spark, folder), LINE_X, "rev").select("feature", "p_value")


@plan(
    "scatter_sample",
    f"""SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS x, o_totalprice AS y FROM ({GAPS_SQL})
    WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 500""",
)
def scatter_sample(spark, folder):
    return L.scatter_sample(gaps(spark, folder), "o_orderstatus", "o_totalprice", "o_orderkey")


@plan(
    "scatter_grid",
    union(
        f"""SELECT * FROM (SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, o_totalprice AS y FROM ({GAPS_SQL})
        WHERE {f} IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 300)"""
        for f in ("o_custkey", "o_orderkey")
    ),
)
def scatter_grid(spark, folder):
    return L.scatter_grid(gaps(spark, folder), ["o_custkey", "o_orderkey"], "o_totalprice", "o_orderkey")
