"""Metrics, curves, drift, learners, preprocessing, sources, sinks and the stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions import tails
from tabulens.operators import drift as D
from tabulens.operators import explain as X
from tabulens.operators import forests as FO
from tabulens.operators import meta as MT
from tabulens.operators import metrics as M
from tabulens.operators import models as ML
from tabulens.operators import scoring as S
from tabulens.operators.splits import kfold_assign
from tabulens.sources import sinks
from tabulens.sources import tables as TB
from tabulens.streaming.score import read_stream, stream_score


def test_auc_and_curve_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first().roc_auc == pytest.approx((2 + 1.5 + 0.5) / 6, abs=1e-6)
    got = [(r.fpr, r.tpr) for r in M.roc_curve(df, "y", "s").orderBy("point").collect()]
    assert got == [(0.0, 0.0), (0.0, 0.3333), (1.0, 1.0)]  # the point between equal steps is left out


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first().roc_auc is None


def test_curve_is_thinned_at_even_places(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 900), "s": rng.random(900)})
    df = spark.createDataFrame(pdf)
    whole = M.roc_curve(df, "y", "s", 10**6).orderBy("point").toPandas()
    thin = M.roc_curve(df, "y", "s", 50).orderBy("point").toPandas()
    at = np.linspace(0, len(whole) - 1, 50).astype(int)
    assert thin.fpr.tolist() == whole.fpr.iloc[at].tolist()
    assert thin.tpr.tolist() == whole.tpr.iloc[at].tolist()


def test_confusion_keeps_labels_of_both_sides(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "t string, p string")
    got = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df, "t", "p").collect()}
    assert len(got) == 9 and sum(got.values()) == 3 and got["b", "a"] == 1
    m = M.metrics_classification(df, "t", "p").first()
    assert m.accuracy == pytest.approx(1 / 3, abs=1e-6) and m.f1 == pytest.approx(2 / 3 * 0.5, abs=1e-6)


def test_bootstrap_brackets_the_metric_and_has_the_usual_width(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=6000)
    pdf = pd.DataFrame({"k": np.arange(6000), "y": y, "p": y + rng.normal(size=6000)})
    got = {r.metric: r for r in M.bootstrap_ci(spark.createDataFrame(pdf), "y", "p", "k", "regression").collect()}
    err = abs(pdf.y - pdf.p)
    assert got["mae"].ci_lower < err.mean() < got["mae"].ci_upper
    width = 2 * 1.96 * err.std() / np.sqrt(6000)
    assert got["mae"].ci_upper - got["mae"].ci_lower == pytest.approx(width, rel=0.2)


def test_drift(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"x": rng.normal(size=800).round(2), "s": rng.choice(list("ab"), 800)})
    b = pd.DataFrame({"x": (rng.normal(size=600) + 0.3).round(2), "s": rng.choice(list("abc"), 600)})
    got = {r.feature: r for r in D.drift_report(spark.createDataFrame(a), spark.createDataFrame(b), ["x", "s"]).collect()}
    grid = np.sort(np.concatenate([a.x, b.x]))
    d = np.abs(
        np.searchsorted(np.sort(a.x), grid, "right") / 800 - np.searchsorted(np.sort(b.x), grid, "right") / 600
    ).max()
    assert D.drift_ks(spark.createDataFrame(a), spark.createDataFrame(b), ["x"]).first().statistic == pytest.approx(d)
    assert got["x"].drifted and got["s"].drifted and got["s"].n_drifted == 2
    same = D.drift_report(spark.createDataFrame(a), spark.createDataFrame(a), ["x", "s"]).collect()
    assert not any(r.drifted for r in same)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 2, 0.5]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=240)
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["label"], pdf["k"] = y, np.arange(240)
    return pdf, spark.createDataFrame(pdf).cache()


def test_penalised_regressions_match_their_closed_forms(train):
    pdf, df = train
    frame = ML.assembled(df, list("abc"), ["label"])
    x = pdf[list("abc")].values
    x = x - x.mean(0)
    y = pdf.label.values - pdf.label.mean()
    ridge = ML.fit_model(ML.RIDGE, frame, "regression", params={"alpha": 20.0}).parts["m"].coefficients
    assert np.allclose(ridge.toArray(), np.linalg.solve(x.T @ x + 20 * np.eye(3), x.T @ y), atol=1e-6)
    lasso = ML.fit_model(ML.LASSO, frame, "regression", params={"alpha": 0.3}).parts["m"].coefficients.toArray()
    slope = x.T @ (y - x @ lasso) / len(y)
    for g, w in zip(slope, lasso):  # optimality conditions
        assert (abs(g) <= 0.3 + 1e-4) if w == 0 else g == pytest.approx(0.3 * np.sign(w), abs=1e-4)


def test_logistic_is_at_the_optimum(train):
    pdf, df = train
    frame = ML.assembled(df.withColumn("label", (F.col("label") > 0).cast("double")), list("abc"), ["label"])
    m = ML.fit_model(ML.LOGISTIC, frame, "classification", 2, {"C": 0.5}).parts["m"]
    x, y = pdf[list("abc")].values, (pdf.label > 0).values.astype(float)
    w = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert np.allclose(x.T @ (p - y) + w / 0.5, 0, atol=0.05)


SMALL = {ML.FOREST: {"trees": 5, "max_depth": 4}, ML.LOGISTIC: {"max_iter": 30}}


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_train_models_and_ensembles(train, kind):
    _, df = train
    classes = 0
    if kind == "classification":
        df, classes = df.withColumn("label", (F.col("label") > 0).cast("double")), 2
    first = ML.RIDGE if kind == "regression" else ML.LOGISTIC
    names = [first, ML.VOTING, ML.STACKING]
    params = {ML.VOTING: SMALL, ML.STACKING: SMALL}
    out = ML.train_models(df, list("abc"), "k", kind, models=names, params=params, cv="k_fold", folds=3, resamples=50)
    rows = out.report.collect()
    lead = [r for r in rows if r.metric == ("r2" if kind == "regression" else "f1")]
    assert [r["rank"] for r in lead] == [1, 2, 3] and {r.model_name for r in lead} == set(names)
    assert out.n_test == 48 and out.n_train == 192
    assert all(r.value > 0.6 and r.ci_lower <= r.value <= r.ci_upper and r.cv_mean > 0.5 for r in lead)
    scored = out.models[ML.VOTING].score(ML.assembled(df, list("abc"), ["k"]))
    if classes:
        assert scored.where("abs(aggregate(probs, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0


def test_multiclass_boosting_goes_one_against_the_rest(train):
    _, df = train
    df = df.withColumn("label", F.expr("CASE WHEN label < -1 THEN 0D WHEN label < 1 THEN 1D ELSE 2D END"))
    frame = ML.assembled(df, list("abc"), ["label"])
    fitted = ML.fit_model("XGBoost", frame, "classification", 3, {"rounds": 5, "max_depth": 3})
    assert ML.primary(fitted.score(frame), "classification") > 0.7


def test_elimination_tuning_and_curves(train):
    _, df = train
    ranking, curve = X.rfecv(df, list("abc"), "k", "regression", folds=3, trees=10, max_depth=5)
    ranks = {r.feature: r["rank"] for r in ranking.collect()}
    assert ranks["a"] == 1 and ranks["b"] == 1 and curve.count() == 3
    tuned = X.tune_random_search(df, list("abc"), "k", "regression", ML.LASSO).collect()
    assert len(tuned) == 5 and tuned[0].score >= tuned[-1].score and tuned[-1].params["alpha"] == "10.0"
    lc = X.learning_curve(df, list("abc"), "k", "regression", ML.LINEAR, folds=3).collect()
    assert [r.train_size for r in lc] == [24, 60, 120, 180, 240]


def test_interval_and_dependence(train, spark):
    pdf, df = train
    frame = ML.assembled(df, list("abc"), ["k", "label"])
    forest = ML.fit_model(ML.FOREST, frame, "regression", params={"trees": 20, "max_depth": 5})
    got = X.prediction_interval(forest, frame).toPandas()
    assert (got.lower_95 <= got.prediction).all() and (got.prediction <= got.upper_95).all()
    mean = forest.score(frame).orderBy("k").toPandas().prediction
    assert np.allclose(got.sort_values("k").prediction, mean, atol=1e-5)
    linear = ML.fit_model(ML.LINEAR, frame, "regression")
    dep = X.partial_dependence(linear, df, list("abc"), "a").orderBy("value").toPandas()
    slope = linear.parts["m"].coefficients[0]
    assert len(dep) == 50 and np.allclose(np.diff(dep.average) / np.diff(dep.value), slope, atol=1e-2)


def test_pca_equals_svd(spark):
    x = np.random.default_rng(6).normal(size=(100, 4)) @ np.random.default_rng(7).normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(t=0.0))
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = X.reduce_pca(df, list("abcd"), "t").toPandas()[["x", "y"]].values
    assert np.allclose(sorted(np.abs(got[:, 0])), sorted(np.abs(z @ vt[0])), atol=1e-3)
    share = [r.explained_variance for r in X.explained_variance(df, list("abcd")).collect()]
    assert np.allclose(share, (s**2 / (s**2).sum())[:2], atol=1e-6)


def test_preprocessing_replays_on_new_data(spark):
    old = spark.createDataFrame([(1.0, "b", "yes"), (3.0, "a", "no"), (8.0, "b", "no")], "x double, s string, y string")
    new = spark.createDataFrame([("9", "z"), ("oops", "a"), (None, None)], "x string, s string")
    meta = MT.fit_meta(old, "y", ["x", "s", "s"][:2])
    got = [tuple(r) for r in MT.apply_meta(new, meta).collect()]
    assert got == [(9.0, 0.0), (3.0, 0.0), (3.0, 0.0)]
    assert meta.target_labels() == ["no", "yes"]
    assert {r.value for r in MT.unseen_categories(new, meta).collect()} == {"z", "__MISSING__"}
    assert [r.outside_range for r in MT.extrapolation_flags(new, meta).collect()] == [["x"], [], []]
    assert MT.missing_features(new.drop("s"), meta) == ["s"]
    assert [r.s for r in MT.apply_meta(new.drop("s"), meta).collect()] == [0.0, 0.0, 0.0]


def test_warnings_missing_features_and_a_feature_named_label(spark):
    rows = [(float(i), "b" if i % 2 else "a", float(i % 5), 2.0 * i) for i in range(20)]
    old = spark.createDataFrame(rows, "label double, s string, extra double, y double")
    meta = MT.fit_meta(old, "y", ["label", "s", "extra"])
    with pytest.raises(ValueError, match="named 'label'"):
        MT.apply_meta(old, meta, with_target=True)
    ready = MT.apply_meta(old, meta, with_target=True, label="target")
    fitted = ML.fit_model(ML.FOREST, ML.assembled(ready, meta.features, [], "target"), "regression", params={"trees": 5})
    new = spark.createDataFrame([(1, 3.0, "z"), (2, 50.0, "a"), (3, 4.0, None)], "k int, label double, s string")
    got = {r.k: r for r in S.predict_what_if(fitted, meta, new, ["k"]).collect()}
    assert [(w.feature, w.kind, w.value) for w in got[1].warnings] == [("s", "unseen", "z")]
    assert [tuple(w) for w in got[2].warnings] == [("label", "range", "50.0", 0.0, 19.0)]
    assert [w.value for w in got[3].warnings] == ["__MISSING__"]
    assert all(r.missing_features == ["extra"] and r.lower_95 <= r.prediction <= r.upper_95 for r in got.values())


def test_evaluation_reads_all_views_from_one_scored_frame(spark, train):
    _, df = train
    raw = df.withColumn("y", F.when(F.col("label") > 0, "up").otherwise("down"))
    meta = MT.fit_meta(raw, "y", list("abc"))
    frame = ML.assembled(MT.apply_meta(raw, meta, with_target=True), list("abc"), ["label"])
    fitted = ML.fit_model(ML.LOGISTIC, frame, "classification", 2, {"max_iter": 30})
    found = S.evaluate(fitted, meta, raw.drop("c"), "k", train=raw)
    assert found.missing_features == ["c"] and found.drift.count() == 2
    assert set(found.views) == {"predictions", "confusion", "roc", "calibration"}
    assert sum(r.n for r in found.views["confusion"].collect()) == raw.count() == found.scored.count()
    numbers = MT.fit_meta(df, "label", list("abc"))
    line = ML.fit_model(ML.LINEAR, ML.assembled(MT.apply_meta(df, numbers, with_target=True), list("abc"), ["label"]), "regression")
    holes = df.withColumn("label", F.when(F.col("k") >= 10, F.col("label") + 100))
    filled = S.evaluate(line, numbers, holes, "k").scored.where("k < 10").collect()
    median = holes.select(F.median("label")).first()[0]
    assert all(abs(r.label - median) < 1e-9 for r in filled)


def test_too_many_classes_raise(spark, monkeypatch):
    meta = MT.fit_meta(spark.range(9).selectExpr("id x", "cast(id as string) y"), "y", ["x"])
    monkeypatch.setattr(MT, "MAX_CLASSES", 8)
    with pytest.raises(ValueError, match="more than 8 classes"):
        meta.target_labels()


def test_csv_types_encoding_and_quotes(spark, tmp_path):
    p = tmp_path / "types.csv"
    p.write_text('a,b,c,d,e\n1,True,,NA,"two\nlines"\n,False,,N/A,x\n3,,,null,y\n')
    df = TB.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "boolean", "c": "double", "d": "double", "e": "string"}
    assert df.count() == 3 and {r.e for r in df.collect()} == {"two\nlines", "x", "y"}
    q = tmp_path / "latin.csv"
    q.write_bytes(b"name,n\ncaf\xe9,1.5\n")
    assert TB.csv_traits(spark, str(q))["encoding"] == "ISO-8859-1"
    assert TB.read_csv(spark, str(q)).first().asDict() == {"name": "café", "n": 1.5}
    with pytest.raises(ValueError):
        TB.read_csv(spark, str(tmp_path / "book.xlsx"))


def test_validation_messages(spark):
    df = spark.createDataFrame([], "a int")
    assert {r.check for r in TB.validate_dataset(df, ["b"]).collect()} == {"columns", "column_exists", "rows"}


def test_csv_rows_of_other_lengths(spark, tmp_path):
    short = tmp_path / "short.csv"
    short.write_text("a,b`c\n1,x\n2\n3,y,\n")
    got = [tuple(r) for r in TB.read_csv(spark, str(short)).orderBy("a").collect()]
    assert got == [(1, "x"), (2, None), (3, "y")]
    long = tmp_path / "long.csv"
    long.write_text("a,b\n1,x\n2,y,z\n")
    with pytest.raises(ValueError, match="more fields"):
        TB.read_csv(spark, str(long))


def test_tails_of_large_degrees():
    assert abs(tails.t_tail(1.96, 9.9e6) - tails.t_tail(1.96, 1.1e7)) < 1e-7
    assert abs(tails.t_tail(2.0, 1e13) - 0.04550026389635842) < 1e-12
    with pytest.raises(ArithmeticError):
        tails._fraction(iter([(0.0, 1.0), (1.0, 1.0), (1.0, 1.0)]))


def test_model_round_trip_and_stream(spark, train, tmp_path):
    pdf, df = train
    raw = df.withColumn("label", F.when(F.col("label") > 0, "up").otherwise("down"))
    meta = MT.fit_meta(raw, "label", list("abc"))
    frame = ML.assembled(MT.apply_meta(raw, meta, with_target=True), list("abc"), ["label"])
    fitted = ML.fit_model(ML.VOTING, frame, "classification", 2, SMALL)
    sinks.save_model(fitted, meta, str(tmp_path / "m"), spark)
    again, meta_again = sinks.load_model(str(tmp_path / "m"), spark)
    batch = {r.k: r.prediction for r in S.predict_batch(again, meta_again, raw, ["k"]).collect()}
    assert batch == {r.k: r.prediction for r in S.predict_batch(fitted, meta, raw, ["k"]).collect()}
    assert set(batch.values()) <= {"up", "down"}
    src = tmp_path / "in"
    raw.where("k < 100").write.parquet(str(src))
    run = lambda: stream_score(
        again, meta_again, read_stream(spark, str(src), raw.schema), str(tmp_path / "out"), str(tmp_path / "state"), ["k"], True
    ).awaitTermination()
    run()
    raw.where("k >= 100").write.mode("append").parquet(str(src))
    run()  # picks up the new files only
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 240 and {r.k: r.prediction for r in out} == batch
    table = sinks.predictions_table(S.predict_batch(fitted, meta, raw), ["down", "up"])
    assert table.columns == ["prediction", "prob_down", "prob_up"]


def test_folds_cover_every_row_once(spark):
    folds = kfold_assign(spark.range(5000), "id", 5).groupBy("fold").count().collect()
    assert {r.fold for r in folds} == set(range(5)) and all(abs(r["count"] - 1000) < 100 for r in folds)


@pytest.mark.parametrize("kind, classes", [(ML.REGRESSION, 0), (ML.CLASSIFICATION, 2)])
def test_stacking_of_many_rows_is_near_that_of_sparks_forests(spark, monkeypatch, tmp_path, kind, classes):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"k": np.arange(n), "a": rng.integers(0, 40, n), "b": rng.random(n), "c": rng.random(n), "d": rng.random(n)})
    y = pdf.a * (1 + pdf.b) + rng.random(n)
    pdf["label"] = (y > 25).astype(float) if classes else y
    frame = kfold_assign(ML.assembled(spark.createDataFrame(pdf), list("abcd"), ["k", "label"]), "k", 3).persist()
    params = {ML.FOREST: {"trees": 8, "max_depth": 5}, ML.LOGISTIC: {"max_iter": 50}}
    fit = lambda: ML.fit_model(ML.STACKING, frame, kind, classes, params, "fold")
    old = ML.primary(fit().score(frame), kind)
    monkeypatch.setattr(ML, "FIT_ROWS", 0)
    fitted = fit()
    scored = fitted.score(frame)
    assert isinstance(fitted.parts["rf"], FO.GrownForest)  # Spark's forests keep a bag of every row for every fit
    assert ML.primary(scored, kind) == pytest.approx(old, abs=0.02)
    ML.save_fitted(fitted, str(tmp_path / "m"), spark)
    again = ML.load_fitted(str(tmp_path / "m"), spark).score(frame)
    read = lambda df: [(r.prediction, r.probs) for r in df.orderBy("k").collect()]
    assert read(again) == read(scored)
    if classes:
        assert all(sum(p) == pytest.approx(1) for _, p in read(scored))
    frame.unpersist()
