"""Forests grown side by side against Spark's own, and the reports built on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabulens.operators import explain as X
from tabulens.operators import forests as FO
from tabulens.operators import models as ML
from tabulens.operators import scores as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"k": np.arange(n), "a": rng.integers(0, 30, n), "b": rng.integers(0, 9, n) / 4, "c": rng.random(n)})
    pdf["label"] = 3.0 * pdf.a * (1 + pdf.b) + 0.3 * pdf.c + rng.random(n)
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def test_undrawn_tree_is_sparks_tree(rows):
    _, df = rows
    train = ML.assembled(df, ["a", "b"], ["k", "label"])
    own = RandomForestRegressor(numTrees=1, maxDepth=4, bootstrap=False, featureSubsetStrategy="all", seed=1).fit(train.where("k % 3 <> 0"))
    held = FO.blocks(df, ["a", "b"], F.col("k") % 3, 1, 42, 4000, bootstrap=False)
    fold = np.arange(3)
    forest = FO.Forest([0, 1], fold != 0, fold == 0)
    FO.grow(held, [forest], 4)
    tested = ML.Fitted(ML.FOREST, ML.REGRESSION, {"m": own}).score(train.where("k % 3 = 0"))
    assert FO.r2(held, [forest]) == [pytest.approx(ML.primary(tested, ML.REGRESSION), abs=2e-6)]
    assert np.allclose(forest.importances(), own.featureImportances.toArray(), atol=1e-9)
    assert sum(f >= 0 for f in forest.trees[0].feature) == (own.totalNumNodes - 1) / 2
    assert sorted(np.unique(FO.bin_edges(df.select(F.col("b").alias("f0")), 1)[0])) == [0.125 + i / 4 for i in range(8)]


def test_forests_together_are_those_alone(rows, monkeypatch):
    _, df = rows
    held = FO.blocks(df, ["a", "b", "c"], F.col("k") % 4, 3, 42, 4000)
    part = np.arange(4)
    made = lambda: [FO.Forest([0, 1, 2], part != 1, part == 1), FO.Forest([1, 2], part > 1, part <= 1)]
    together, alone = made(), made()
    FO.grow(held, together, 3)
    monkeypatch.setattr(FO, "SUMS", 1)  # one node per pass
    monkeypatch.setattr(FO, "FAN_IN", 2)  # merged in two steps
    for forest in alone:
        FO.grow(held, [forest], 3)
    for a, b in zip(together, alone):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.bin for t in a.trees] == [t.bin for t in b.trees]
    assert FO.r2(held, together) == pytest.approx(FO.r2(held, alone))
    assert len({tuple(map(tuple, t.sums)) for t in together[0].trees}) == 3  # every tree has draws of its own


def test_gaps_raise_and_equal_labels_have_no_score(rows, spark):
    _, df = rows
    with pytest.raises(Exception, match="lacks a feature"):
        FO.blocks(df.withColumn("a", F.when(F.col("k") != 7, F.col("a"))), ["a"], F.lit(0), 1, 42, 4000)
    held = FO.blocks(df.withColumn("label", F.lit(0.1)), ["a"], F.lit(0), 2, 42, 4000)
    forest = FO.Forest([0], np.array([True]), np.array([True]))
    FO.grow(held, [forest], 3)
    assert FO.r2(held, [forest]) == [None] and [len(t.feature) for t in forest.trees] == [1, 1]
    assert forest.importances().tolist() == [0.0]


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_learning_curve_of_many_rows_reads_them_once_per_level(rows, spark, monkeypatch):
    _, df = rows
    curve = lambda: X.learning_curve(df, list("abc"), "k", "regression", params={"trees": 5, "max_depth": 4}, folds=3).collect()
    old = curve()
    monkeypatch.setattr(X, "FIT_ROWS", 0)
    new, jobs = jobs_of(spark, "curve", curve)
    assert jobs < 40  # Spark's forests run some 10 jobs for each of 20 fits
    assert [r.train_size for r in new] == [r.train_size for r in old] == [400, 1000, 2000, 3000, 4000]
    for a, b in zip(old, new):
        assert a.train_score == pytest.approx(b.train_score, abs=0.02) and a.val_score == pytest.approx(b.val_score, abs=0.03)


def test_elimination_on_many_rows_reads_them_once_per_level(rows, spark, monkeypatch):
    _, df = rows
    eliminate = lambda: [d.collect() for d in X.rfecv(df, list("abc"), "k", "regression", folds=3, trees=5, max_depth=4)]
    _, old = eliminate()
    monkeypatch.setattr(X, "FIT_ROWS", 0)
    (ranks, new), jobs = jobs_of(spark, "rfecv", eliminate)
    assert jobs < 80  # of 9 fits on folds and up to 3 on all rows
    assert sorted(r.feature for r in ranks) == ["a", "b", "c"] and ranks[0]["rank"] == 1
    assert [r.n_features for r in new] == [r.n_features for r in old] == [1, 2, 3]
    for a, b in zip(old, new):
        assert a.cv_score == pytest.approx(b.cv_score, abs=0.03)


def test_cells_of_equal_bins_grow_the_trees_of_their_rows(rows, monkeypatch):
    _, df = rows
    made = lambda: FO.Forest([0, 1], np.array([True, False]), np.array([False, True]))
    grown = []
    for share in (4, 10**9):  # 270 bins of two parts hold 4,000 rows: cells, then rows
        monkeypatch.setattr(FO, "CELL_SHARE", share)
        held = FO.blocks(df, ["a", "b"], F.col("k") % 2, 3, 42, 4000)
        assert {r.sums is not None for r in held.rows.collect()} == {share == 4}
        forest = made()
        FO.grow(held, [forest], 5)
        grown.append((forest, FO.r2(held, [forest])))
    (a, one), (b, other) = grown
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.bin for t in a.trees] == [t.bin for t in b.trees]
    assert np.allclose([s for t in a.trees for s in t.sums], [s for t in b.trees for s in t.sums])
    assert one == pytest.approx(other, abs=2e-6)


def test_draws_are_poisson():
    drawn = FO._drawn(np.arange(200_000), 3, 42)
    assert drawn.mean() == pytest.approx(1, abs=0.01) and drawn.var() == pytest.approx(1, abs=0.02)
    assert not np.array_equal(drawn, FO._drawn(np.arange(200_000), 2, 42))


def test_importances_of_many_rows_are_near_sparks(rows, monkeypatch):
    _, df = rows
    scored = lambda: {r.column: r.score for r in S.score_rf_importance(df.drop("k"), "label", "regression", trees=10).collect()}
    old = scored()
    monkeypatch.setattr(S, "FIT_ROWS", 0)
    new = scored()
    assert set(new) == {"a", "b", "c"} and new != old
    assert all(new[c] == pytest.approx(old[c], abs=0.01) for c in old)
