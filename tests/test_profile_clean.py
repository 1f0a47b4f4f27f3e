"""Profiles, missing values, cleaning, transforms on hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import clean as C
from tabulens.operators import distribution as D
from tabulens.operators import engineer as E
from tabulens.operators import profile as P


def row(df):
    return df.first().asDict()


def test_nan_and_null_are_one_missing_value(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, i int")
    m = {r.column: r.missing_count for r in P.missing_counts(df).collect()}
    assert m == {"x": 2, "i": 0}
    p = row(P.profile_numeric(df, ["x"]))
    assert p["count"] == 1 and p["mean"] == 1.0 and p["median"] == 1.0 and p["std"] is None
    assert row(P.missing_totals(df))["complete_rows"] == 1


@pytest.mark.parametrize("n, skew, kurt", [(1, None, None), (2, None, None), (3, 0.0, None), (4, 0.0, 0.0)])
def test_shape_of_tiny_constant_columns(spark, n, skew, kurt):
    df = spark.createDataFrame([(5.0,)] * n, "x double")
    r = row(P.shape_statistics(df, ["x"]))
    assert (r["skewness"], r["kurtosis"]) == (skew, kurt)


def test_shape_equals_pandas(spark):
    x = np.random.default_rng(0).exponential(size=200)
    r = row(P.shape_statistics(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]))
    assert r["skewness"] == pytest.approx(pd.Series(x).skew(), abs=1e-6)
    assert r["kurtosis"] == pytest.approx(pd.Series(x).kurt(), abs=1e-6)


def test_boolean_columns(spark):
    df = spark.createDataFrame([(True, True), (False, None), (True, True)], "full boolean, gap boolean")
    kinds = {r.column: (r.dtype, r.column_type) for r in P.classify_columns(df).collect()}
    assert kinds == {"full": ("bool", "boolean"), "gap": ("object", "text / categorical")}
    p = row(P.profile_numeric(df, ["full"]))
    assert p["sum"] == 2.0 and p["min"] is None and p["q25"] is None and p["median"] == 1.0


def test_integer_with_null_follows_the_float_rule(spark):
    rows = [(i % 10, None if i == 0 else i % 10) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int")
    t = {r.column: r.problem_type for r in P.detect_problem_type(df, ["a", "b"]).collect()}
    assert t == {"a": "classification", "b": "regression"}


def test_date_like_text(spark):
    df = spark.createDataFrame([("2020-01-02", "x", None), ("2021-03-04", "2020-01-01", None)], "d string, s string, e string")
    kinds = {r.column: r.column_type for r in P.classify_columns(df).collect()}
    assert kinds == {"d": "datetime (string)", "s": "text / categorical", "e": "datetime (string)"}


def test_top_value_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert row(P.profile_categorical(df)) == {"column": "s", "top_value": "a", "top_value_count": 2}
    filled = C.fill_mode(df, ["s"]).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in filled} == {"a": 3, "b": 2}


def test_target_names(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 1), (2, 3.0, "b", 2)], "id int, Price double, customer_status string, y int")
    got = [(r.column, r.confidence) for r in P.suggest_target(df).collect()]
    # exact keyword, position, numeric and few-values bonuses by hand
    assert got == [("y", 1.0), ("Price", 0.85), ("customer_status", 0.625)]


def test_clean_order_drop_then_fill(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 100.0), (3.0, None), (5.0, 4.0)], "a double, b double")
    out = C.clean_missing(df, {"a": "drop_rows", "b": "median"})
    assert sorted(r.b for r in out.collect()) == [1.0, 2.5, 4.0]  # the dropped 100 plays no part
    with pytest.raises(ValueError):
        C.fill_constant(df, "a", "none")
    with pytest.raises(ValueError):
        C.drop_feature(df, "a")


def test_divide_reciprocal_and_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (3.0, None)], "a double, b double")
    assert [r["a_÷_b"] for r in E.eng_divide(df, "a", "b").collect()] == [None, 2.0, None]
    assert [r.b_inv for r in E.tx_reciprocal(df, "b").collect()] == [None, 0.5, None]
    with pytest.raises(ValueError):
        E.tx_sqrt(df.select((-F.col("a")).alias("a")), "a")
    with pytest.raises(ValueError):
        E.eng_add(df, "a", "b", "b")


def test_clip_keeps_missing_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    got = [r.x_clipped for r in E.tx_clip(df, "x", 10, 90).collect()]
    assert min(v for v in got if v is not None) == 10.0 and max(v for v in got if v is not None) == 90.0
    assert got.count(None) == 1


@pytest.mark.parametrize("bins", [2, 7, 20])
def test_bins_equal_pandas(spark, bins):
    x = pd.Series(np.round(np.random.default_rng(2).exponential(size=500), 1))
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "x": x}))
    q = E.tx_quantile_bin(df, "x", bins, "q").orderBy("i").toPandas()["q"]
    w = E.tx_width_bin(df, "x", bins, "w").orderBy("i").toPandas()["w"]
    assert q.tolist() == pd.qcut(x, bins, labels=False, duplicates="drop").tolist()
    assert w.tolist() == pd.cut(x, bins, labels=False).tolist()


def test_constant_column_has_no_quantile_bins(spark):
    df = spark.createDataFrame([(2.0,)] * 9, "x double")
    assert {r.x_bin5 for r in E.tx_quantile_bin(df, "x").collect()} == {None}


def test_yeo_johnson_fit_maximises_the_likelihood(spark):
    x = np.random.default_rng(4).lognormal(size=400) - 0.5
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    lam = E.fit_yeo_johnson(df, "x")

    def loglik(g):
        up = np.log1p(x.clip(0)) if abs(g) < 1e-12 else ((x.clip(0) + 1) ** g - 1) / g
        o = 2 - g
        down = -np.log1p(-x.clip(max=0)) if abs(o) < 1e-12 else -((1 - x.clip(max=0)) ** o - 1) / o
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * math.log(y.var()) + (g - 1) * (np.sign(x) * np.log1p(abs(x))).sum()

    best = max(np.linspace(lam - 1, lam + 1, 4001), key=loglik)
    assert lam == pytest.approx(best, abs=1e-3)


def test_label_codes_sort_with_the_missing_label(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "A"), (3, "b")], "i int, s string")
    got = [r.s_code for r in E.label_encode(df, "s").orderBy("i").collect()]
    assert got == [2, 1, 0, 2]  # A < __MISSING__ < b


def test_histogram_equals_numpy(spark):
    x = np.random.default_rng(5).normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = D.hist_numeric(df, "x", n_bins=20).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, 20)
    assert got["count"].tolist() == counts.tolist()
    assert np.allclose(got["end"], edges[1:])


def test_outliers_of_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 3 + [(1.0, None)] * 3, "c double, s double")
    got = {r.column: (r.z_score_count, r.iqr_count) for r in D.outliers(df).collect()}
    assert got == {"c": (0, 0)}


def test_one_word_among_dates_makes_a_column_text(spark):
    from tabulens.operators.profile import classify_columns

    dates = [(f"2024-01-{d:02d}", f"2024-01-{d:02d}", None) for d in range(1, 20)]
    df = spark.createDataFrame([*dates, ("word", "2024-02-01", None)], "a string, b string, c string")
    got = {r["column"]: r["column_type"] for r in classify_columns(df).collect()}
    assert got == {"a": "text / categorical", "b": "datetime (string)", "c": "datetime (string)"}


def test_nineteen_digit_integers_stay_integers(spark):
    from tabulens.sources.tables import inferred_types, with_types

    df = spark.createDataFrame([("1234567890123456789", "12345678901234567890"), ("1234567890123456790", "1")], "a string, b string")
    types = inferred_types(df)
    assert types == {"a": "bigint", "b": "double"}
    assert with_types(df, types).select("a").distinct().count() == 2


def test_keys_that_differ_in_upper_bits_split_evenly(spark):
    from tabulens.operators.splits import cv_assign, kfold_assign, split_flag

    for shift in (31, 32, 40):
        df = spark.range(1000).selectExpr(f"shiftleft(id, {shift}) AS k")
        assert split_flag(df, "k").where("is_test").count() == 200
        assert {150 < r["count"] < 250 for r in kfold_assign(df, "k").groupBy("fold").count().collect()} == {True}
    folds, n = cv_assign(spark.range(300), "id", "loo", "regression")
    assert n == 300 and folds.select("fold").distinct().count() == 300
