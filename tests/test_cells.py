"""Percentiles, box statistics and outliers from two scans, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import distribution as D
from tabulens.operators import profile as P
from tabulens.operators import ranks as R


def skewed(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) ** 3
    x[: n // 3] = 0.25
    y = rng.integers(0, 7, n).astype(float)
    y[::11] = np.nan
    return pd.DataFrame({"x": x, "y": y, "z": rng.exponential(size=n)}).sample(frac=1, random_state=1)


def box(v):
    v = v[~np.isnan(v)]
    q1, q2, q3 = np.percentile(v, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    return inside.min(), q1, q2, q3, inside.max(), int(((v < lo) | (v > hi)).sum())


class Scans:
    """Counts the times that a frame's rows are read."""

    def __init__(self, spark, df):
        self.rows = spark.sparkContext.accumulator(0)
        self.n = df.count()
        seen = self.rows

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        self.df = df.mapInArrow(count, df.schema)

    @property
    def times(self):
        return self.rows.value / self.n


@pytest.mark.parametrize("limit,accuracy", [(10**6, 10000), (5, 60), (50, 300)])
def test_box_and_outliers_take_two_scans(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(R, "SORT_LIMIT", limit)
    monkeypatch.setattr(R, "ACCURACY", accuracy)
    pdf = skewed()
    df = spark.createDataFrame(pdf).repartition(5)
    want = {c: box(pdf[c].to_numpy()) for c in pdf}
    scans = Scans(spark, df)
    for r in D.box_stats(scans.df, list(pdf)).collect():
        assert (r.min, r.q1, r.median, r.q3, r.max) == pytest.approx(want[r.column][:5], abs=1e-6)
    assert scans.times == 2
    scans = Scans(spark, df)
    got = {r.column: r for r in D.outliers(scans.df).collect()}
    assert scans.times == 2
    for c in pdf:
        v = pdf[c].dropna()
        far = int((np.abs((v - v.mean()) / v.std(ddof=0)) > 3).sum())
        r = got[c]
        assert (r.iqr_count, r.z_score_count, r.n_valid) == (want[c][5], far, len(v))
        assert r.iqr_pct == pytest.approx(100 * want[c][5] / len(pdf), abs=0.0051)


def test_profile_takes_two_scans(spark):
    scans = Scans(spark, spark.createDataFrame(skewed()).repartition(5))
    assert len(P.profile_numeric(scans.df).collect()) == 3 and scans.times == 2


def test_a_sketch_that_misses_is_asked_again(spark, monkeypatch):
    """Brackets far from the wanted ranks cost a further scan, not a wrong value."""
    monkeypatch.setattr(R, "_around", lambda p, accuracy: (0.0, 0.0))
    x = np.random.default_rng(0).permutation(1000.0 * np.arange(500))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert R.percentiles(df, ["x"], [0.0, 0.5, 0.999, 1.0])["x"] == pytest.approx(np.percentile(x, [0, 50, 99.9, 100]))
    r = D.box_stats(df, "x").first()
    assert (r.min, r.q1, r.median, r.q3, r.max) == pytest.approx(box(x)[:5])


def test_infinite_values_are_ordered(spark):
    x = [1.0, float("inf"), 2.0, float("-inf"), float("inf"), 3.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert R.percentiles(df, ["x"], [0.0, 0.2, 0.4, 0.8, 1.0])["x"] == [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r.column for r in D.box_stats(df, ["a", "b"]).collect()] == ["b"]
    assert D.box_stats(df.limit(0), ["a", "b"]).collect() == [] == D.outliers(df.limit(0)).collect()
    assert {r.column: r["count"] for r in P.profile_numeric(df).collect()} == {"a": 0, "b": 2}


def test_nothing_is_left_in_the_shared_folder(spark):
    from tabulens.session import shared_dir

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    left = lambda: {str(f.getPath()) for f in files.listStatus(folder)}
    before = left()
    assert R.percentiles(df, ["x"], [0.5])["x"] == [499.5]
    assert left() == before


def test_histogram_and_density_of_infinite_values_raise(spark):
    df = spark.createDataFrame([(float(i),) for i in range(98)] + [(float("inf"),)] * 2, "x double")
    for view in (D.hist_numeric, D.kde_gaussian):
        with pytest.raises(ValueError, match="infinite"):
            view(df, "x")
