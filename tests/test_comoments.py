"""One-pass co-moments, correlations and variance inflation against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from tabulens.functions import comoments as C
from tabulens.operators import correlation as K


def wide(n=400, k=300, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, k)) + rng.normal(size=(n, 1))
    return base * 10.0 ** rng.integers(-3, 6, k) + 10.0 ** rng.integers(0, 9, k)


def frame(spark, values, parts=7):
    return spark.createDataFrame(pd.DataFrame(values, columns=[f"c{i}" for i in range(values.shape[1])])).repartition(parts)


def test_moments_of_many_columns_with_gaps(spark):
    x = wide(k=40)
    x[np.random.default_rng(1).random(x.shape) < 0.1] = np.nan
    x[:, 3] = np.nan
    fill = np.arange(40.0)
    found = C.comoments(frame(spark, x), [f"c{i}" for i in range(40)])
    assert found.gaps().tolist() == np.isnan(x).sum(0).tolist()
    whole = np.where(np.isnan(x), fill, x)
    got = found.filled(fill)
    assert got.n == len(x) and got.mean == pytest.approx(whole.mean(0), rel=1e-9)
    want = np.cov(whole.T, bias=True) * len(x)
    spread = np.sqrt(np.diag(want)) + 1e-9
    assert np.abs((got.moments - want) / np.outer(spread, spread)).max() < 1e-7


@pytest.mark.parametrize("fan,size", [(64, 1 << 28), (2, 1)])
def test_merging_in_levels_changes_nothing(spark, monkeypatch, fan, size):
    monkeypatch.setattr(C, "FAN_IN", fan)
    monkeypatch.setattr(C, "MERGE_BYTES", size)
    x = wide(k=5)
    got = C.comoments(frame(spark, x, 23), [f"c{i}" for i in range(5)]).filled(np.zeros(5)).correlations()
    assert got == pytest.approx(np.corrcoef(x.T), abs=1e-9)


def test_three_hundred_columns_take_one_scan(spark):
    x = wide()
    x[:, 7] = 0.1
    df = frame(spark, x)
    cols = df.columns
    plan = C.states(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    got = K.corr_pearson_matrix(df).toPandas().pivot(index="x", columns="y", values="value").loc[cols, cols].to_numpy(float)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    want[7, :] = want[:, 7] = np.nan
    assert got == pytest.approx(want, abs=1e-4, nan_ok=True)


def test_constant_missing_infinite_and_empty_columns(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0, 8.0], "b": [0.1] * 4, "c": [np.nan] * 4, "d": [1.0, np.inf, 2.0, 3.0], "e": [5.0, np.nan, 1.0, 2.0]})
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r.x, r.y): r.value for r in K.corr_pearson_matrix(df).collect()}
    assert len(got) == 25 and got["a", "a"] == 1.0
    assert all(got[x, y] is None for x in "bcd" for y in "abcde")
    assert got["a", "e"] == round(float(np.corrcoef(pdf["a"], [5, 2, 1, 2])[0, 1]), 4)  # the gap at the median
    assert all(r.value is None for r in K.corr_pearson_matrix(df.limit(0)).collect())


def regressed(x):
    """1 / (1 - R squared) of each column on the others, without intercept."""
    out = []
    for i in range(x.shape[1]):
        rest = np.delete(x, i, 1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        out.append((x[:, i] @ x[:, i]) / (left @ left))
    return out


def test_inflation_equals_regressions(spark):
    x = np.random.default_rng(3).normal(size=(400, 12)) * 10.0 ** np.arange(-6, 6) + 10.0 ** np.arange(-6, 6)
    got = {r.feature: r.vif for r in K.vif(frame(spark, x), [f"c{i}" for i in range(12)]).collect()}
    assert [got[f"c{i}"] for i in range(12)] == pytest.approx(regressed(x), rel=1e-4)


def test_inflation_with_a_null_space(spark):
    """Two dependent groups give NULL; the columns outside them keep their value."""
    x = np.random.default_rng(5).normal(size=(200, 7)) + 1
    x[:, 1] = 2 * x[:, 0]
    x[:, 4] = x[:, 2] - 3 * x[:, 3]
    got = {r.feature: r.vif for r in K.vif(frame(spark, x), [f"c{i}" for i in range(7)]).collect()}
    assert [got[f"c{i}"] for i in range(5)] == [None] * 5
    rest = regressed(x[:, [5, 0, 2, 3, 6]])
    assert got["c5"] == pytest.approx(rest[0], rel=1e-4) and got["c6"] == pytest.approx(rest[4], rel=1e-4)
