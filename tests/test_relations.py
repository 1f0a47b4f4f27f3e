"""Correlations, scores, collinearity and tails against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions import tails as T
from tabulens.operators import correlation as K
from tabulens.operators import ranks as R
from tabulens.operators import scatter as L
from tabulens.operators import scores as S


def frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, n).astype(float)
    y = np.where(rng.random(n) < 0.34, 3.0, x + rng.normal(size=n).round(1))
    pdf = pd.DataFrame({"x": x, "y": y, "z": rng.permutation(n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def tau_b(a, b):
    da, db = np.sign(a[:, None] - a[None]), np.sign(b[:, None] - b[None])
    return (da * db).sum() / np.sqrt(abs(da).sum() * abs(db).sum())


@pytest.mark.parametrize("bits", [2, 16])
def test_kendall_equals_all_pairs(spark, monkeypatch, bits):
    """Small rank buckets force the path that adds the totals of earlier buckets."""
    monkeypatch.setattr(K, "RANK_BUCKET_BITS", bits)
    pdf, df = frame(spark)
    got = {(r.x, r.y): r.value for r in K.corr_kendall_matrix(df).collect()}
    for a in pdf:
        for b in pdf:
            assert got[a, b] == pytest.approx(tau_b(pdf[a].values, pdf[b].values), abs=5.1e-5)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(spark, method):
    pdf, df = frame(spark)
    want = pdf.corr(method=method)
    for r in K.correlation_matrix(df, method=method).collect():
        assert r.value == pytest.approx(want.loc[r.x, r.y], abs=5.1e-5)


def test_constant_column_correlates_with_nothing(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, v double")
    for method in ("pearson", "spearman", "kendall"):
        got = {(r.x, r.y): r.value for r in K.correlation_matrix(df, method=method).collect()}
        assert got["c", "v"] is None and got["c", "c"] is None and got["v", "v"] == 1.0


def test_a_forest_task_keeps_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "FOREST_ROWS", 100)
    fitted = []
    fit = S.RandomForestRegressor.fit
    monkeypatch.setattr(S.RandomForestRegressor, "fit", lambda forest, rows: fitted.append(rows) or fit(forest, rows))
    x = F.floor(F.col("id") / 600)  # half of the rows are equal
    df = spark.range(0, 1200, 1, 1).select(F.when(x == 0, 0).otherwise(F.col("id")).cast("double").alias("x"), F.rand(1).alias("z"))
    scores = {r.column: r.score for r in S.score_rf_importance(df.withColumn("y", F.col("x") * 2), "y", "regression", trees=3).collect()}
    sizes = [r["count"] for r in fitted[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and sum(sizes) == 1200 and max(sizes) < 200
    assert scores["x"] > 0.9 and sum(scores.values()) == pytest.approx(1)


def test_a_split_of_many_rows_is_dealt_out(spark):
    rows = S.dealt(spark.range(0, 1_200_000, 1, 1))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 1_200_000 and max(sizes) < 600_000


def test_class_scores(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=90), "b": rng.random(90), "y": (np.arange(90) % 3).astype(float)})
    pdf.loc[pdf.y == 2, "a"] += 1
    df = spark.createDataFrame(pdf)
    f = {r.column: r.score for r in S.score_anova_f(df, "y").collect()}
    c = {r.column: r.score for r in S.score_chi2(df, "y").collect()}
    for col in "ab":
        groups = [g[col].values for _, g in pdf.groupby("y")]
        grand = pdf[col].mean()
        between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 87
        assert f[col] == pytest.approx(between / within)
        v = pdf[col] - min(pdf[col].min(), 0)
        o = v.groupby(pdf.y).sum()
        assert c[col] == pytest.approx((((o - v.sum() / 3) ** 2) / (v.sum() / 3)).sum())


def test_information_of_a_copy_is_its_entropy(spark):
    df = spark.createDataFrame([(float(i % 4), float(i % 4)) for i in range(80)], "x double, y double")
    got = S.score_mutual_info(df, "y", "classification").first().score
    assert got == pytest.approx(np.log(4))


def test_equal_scores_normalise_to_one(spark):
    df = spark.createDataFrame([("a", "m", 2.0), ("b", "m", 2.0)], "column string, method string, raw_score double")
    assert [r.score for r in S.normalize_scores(df).collect()] == [1.0, 1.0]


def test_vif_order_and_band(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(size=200) * 0.1, "c": rng.normal(size=200), "k": 1.0})
    got = K.vif_band(K.vif(spark.createDataFrame(pdf), list(pdf))).collect()
    assert [r.feature for r in got][2] == "c" and got[0].band == "high" and got[2].band == "ok"
    x = pdf[["a", "b", "c"]].values
    rest = x[:, [1, 2]]
    fit = rest @ np.linalg.lstsq(rest, x[:, 0], rcond=None)[0]
    want = (x[:, 0] ** 2).sum() / ((x[:, 0] - fit) ** 2).sum()
    assert {r.feature: r.vif for r in got}["a"] == pytest.approx(want, rel=1e-4)


def test_singular_vif_comes_first_as_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(1, 30)], "a double, b double, c double")
    got = [(r.feature, r.vif) for r in K.vif(df, ["a", "b", "c"]).collect()]
    assert got[:2] == [("a", None), ("b", None)] and got[2][1] > 1


def test_tail_probabilities():
    # values of the usual printed tables
    assert T.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert T.chi2_tail(18.307038053, 10) == pytest.approx(0.05, abs=1e-9)
    assert T.chi2_tail(0.5, 10) == pytest.approx(0.9999934, abs=1e-6)
    assert T.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert T.t_tail(0.0, 5) == 1.0 and T.t_tail(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)


def test_line_with_missing_values_and_text(spark):
    df = spark.createDataFrame([(1.0, 3.0, "a"), (2.0, 5.0, "b"), (None, 9.0, "b"), (4.0, 9.0, None)], "x double, y double, s string")
    got = {r.feature: r for r in L.linregress(df, ["x", "s"], "y").collect()}
    assert (got["x"].slope, got["x"].intercept, got["x"].p_value) == (2.0, 1.0, 0.0)
    assert got["s"].slope == 4.0  # codes 0, 1, 1 against 3, 5, 9; the missing label is left out


def test_rank_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    pdf, df = frame(spark)
    want = pdf.corr(method="spearman")
    for r in K.corr_spearman_matrix(df).collect():
        assert r.value == pytest.approx(want.loc[r.x, r.y], abs=5.1e-5)


def test_line_codes_skip_classes_without_a_target(spark):
    rows = [(0, "a", None), (1, "b", 1.0), (2, "c", 3.0), (3, "d", 5.0)]
    df = spark.createDataFrame(rows, "k bigint, f string, y double")
    line = L.linregress(df, "f", "y").first()
    assert (line.slope, line.intercept, line.x0, line.x1) == (2.0, 1.0, 0.0, 2.0)
    grid = L.scatter_grid(df, ["f"], "y", "k")
    assert sorted((r.x, r.y) for r in grid.collect()) == [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)]


def test_feature_selection_reports_the_class_balance(spark):
    rows = [(float(i), float(i % 7), "rare" if i % 10 == 0 else "often" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, kind string")
    found = S.feature_selection(df, "kind", trees=3, methods=["anova_f"])
    assert (found.problem_type, found.n_features) == ("classification", 2) and found.weights["anova_f"] == 0.25
    got = {r["class"]: (r["count"], r.imbalance_ratio, r.is_severe, r.n_classes) for r in found.class_balance.collect()}
    assert got == {"rare": (6, 5.0, True, 2), "often": (30, 5.0, True, 2)}
    assert {r["column"] for r in found.ranking.collect()} == {"a", "b"}
    assert S.feature_selection(df.drop("kind"), "a", trees=3, methods=["pearson"]).class_balance is None
