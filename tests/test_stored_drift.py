"""Drift against the distributions stored with the preprocessing, compared with drift between the frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import drift as D
from tabulens.operators import meta as MT
from tabulens.operators import models as M
from tabulens.operators import scoring as SC
from tabulens.sources import sinks


def sides(spark, n=3000):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "smooth": rng.normal(size=n) ** 3, "few": rng.integers(0, 6, n).astype(float), "same": rng.normal(size=n),
        "kind": rng.choice(["a", "b", "c"], n), "label": rng.normal(size=n),
    })
    pdf.loc[::9, "smooth"] = np.nan
    pdf.loc[::7, "kind"] = None
    pdf["hot"] = np.where(np.arange(n) % 3 == 0, 1.5, rng.normal(size=n))
    late = pdf.copy()
    late["smooth"] += 0.08
    late["few"] = np.minimum(late["few"] + (rng.random(n) < 0.1), 5)
    late["kind"] = np.where(rng.random(n) < 0.05, "new", late["kind"])
    return spark.createDataFrame(pdf).repartition(3), spark.createDataFrame(late).repartition(4)


COLUMNS = ["smooth", "few", "same", "hot"]


@pytest.mark.parametrize("grid", [1000, 20])
def test_stored_statistics_stay_within_their_error(spark, monkeypatch, grid):
    monkeypatch.setattr(MT, "GRID", grid)
    train, late = sides(spark)
    meta = MT.fit_meta(train, "label", [*COLUMNS, "kind"])
    for s in meta.spreads.values():
        assert s.gap <= 2 / grid and sorted(s.values) == s.values and s.upto[-1] == s.n
    exact = {r.feature: r for r in D.drift_ks(train, late, COLUMNS).collect()}
    got = {r.feature: r for r in D.stored_ks(meta, late, COLUMNS).collect()}
    assert got.keys() == exact.keys()
    for c, r in got.items():
        assert exact[c].statistic - r.error - 1e-12 <= r.statistic <= exact[c].statistic + 1e-12
        assert r.drifted == exact[c].drifted
    assert got["few"].error == 0 and got["few"].statistic == pytest.approx(exact["few"].statistic)


def test_medians_and_ranges_come_with_the_distributions(spark):
    train, _ = sides(spark)
    meta, pdf = MT.fit_meta(train, "label", COLUMNS), train.toPandas()
    for c in COLUMNS:
        assert meta.numbers[c] == pytest.approx((pdf[c].median(), pdf[c].min(), pdf[c].max()))
        s = meta.spreads[c]
        assert s.n == pdf[c].count() and s.below == [(pdf[c] < v).sum() for v in s.values] and s.upto == [(pdf[c] <= v).sum() for v in s.values]
    assert meta.target_median == pytest.approx(pdf["label"].median())
    empty = MT.fit_meta(train.withColumn("few", F.lit(None).cast("double")), None, ["few"])
    assert empty.numbers == {"few": (None, None, None)} and empty.spreads["few"].n == 0


def test_fit_on_learns_from_the_chosen_rows_only(spark):
    df = spark.createDataFrame([(1.0, "a", False), (3.0, "b", False), (99.0, "leak", True), (7.0, "x", None)], "v double, c string, is_test boolean")
    meta = MT.fit_meta(df, None, ["v", "c"], fit_on=~F.col("is_test"))
    assert meta.numbers["v"] == (2.0, 1.0, 3.0) and meta.spreads["v"].n == 2
    assert {r["class"] for r in meta.classes.collect()} == {"a", "b"}
    applied = MT.apply_meta(df, meta, keep=["v"]).collect()
    assert [r["c"] for r in sorted(applied, key=lambda r: r["_keep_v"])] == [0.0, 1.0, 0.0, 0.0]


def test_a_loaded_model_reports_drift_without_its_training_frame(spark, tmp_path):
    train, late = sides(spark)
    features = [*COLUMNS, "kind"]
    meta = MT.fit_meta(train, "label", features)
    frame = M.assembled(MT.apply_meta(train, meta, with_target=True), features, ["label"])
    sinks.save_model(M.fit_model(M.LINEAR, frame, M.REGRESSION), meta, str(tmp_path), spark)
    fitted, loaded = sinks.load_model(str(tmp_path), spark)
    assert loaded.spreads == meta.spreads
    found = SC.evaluate(fitted, loaded, late.withColumn("key", F.monotonically_increasing_id()), "key").drift
    got = {r.feature: (r.test, r.drifted) for r in found.collect()}
    want = {r.feature: (r.test, r.drifted) for r in D.drift_report(train, late, features).collect()}
    assert got == want and got["kind"] == ("chi2", True) and got["same"] == ("ks", False)
    exact = {r.feature: r for r in D.drift_chi2(train, late, ["kind"]).collect()}["kind"]
    assert D.stored_chi2(loaded, late, ["kind"]).first().statistic == pytest.approx(exact.statistic)
    assert D.stored_report(loaded, late.select("label")) is None
