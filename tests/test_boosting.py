"""Softmax boosting and flat trees against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.operators import boosting as B
from tabulens.operators import explain as X
from tabulens.operators import flat_trees as T
from tabulens.operators import models as M


def labelled(n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n) ** 3, np.full(n, 2.0)])
    score = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) / 3
    return x, np.digitize(score, np.quantile(score, [0.4, 0.75]))


def vectors(spark, x, y=None, parts=3):
    pdf = pd.DataFrame({"x": list(x), "key": np.arange(len(x))} | ({} if y is None else {"label": y.astype(float)}))
    df = spark.createDataFrame(pdf).repartition(parts)
    return df.select("key", *([] if y is None else ["label"]), array_to_vector("x").alias("features"))


def plain_tree(x, g, h, depth, l2=1.0, least=1.0):
    """A function from rows to raw leaf weights, grown depth first over every value as a threshold."""
    best = (1e-12, None, None)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if min(hl, hr) < least:
                    continue
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, f, t)
    _, f, t = best
    if f is None:
        return lambda rows: np.full(len(rows), -g.sum() / (h.sum() + l2))
    left = x[:, f] <= t
    low, high = plain_tree(x[left], g[left], h[left], depth - 1), plain_tree(x[~left], g[~left], h[~left], depth - 1)
    return lambda rows: np.where(rows[:, f] <= t, low(rows), high(rows))


def plain_boost(x, y, classes, rounds, step, depth):
    margins, losses = np.zeros((len(x), classes)), []
    for _ in range(rounds):
        p = B.softmax(margins)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        trees = [plain_tree(x, p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16), depth) for k in range(classes)]
        margins = margins + step * np.column_stack([t(x) for t in trees])
    return B.softmax(margins), losses


@pytest.mark.parametrize("cut", [20, 2])
def test_boost_equals_plain_boosting(spark, monkeypatch, cut):
    monkeypatch.setattr(B, "CUT_EVERY", cut)
    monkeypatch.setattr(B, "FAN_IN", 2)
    x, y = labelled()
    want, losses = plain_boost(x, y, 3, 5, 0.3, 3)
    model = B.SoftmaxBoost(3, rounds=5, step=0.3, max_depth=3).fit(vectors(spark, x, y))
    assert model.losses == pytest.approx(losses) and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    got = model.transform(vectors(spark, x)).orderBy("key").toPandas()
    assert np.stack(got["probability"]) == pytest.approx(want, abs=1e-9)
    assert np.stack(got["probability"]).sum(1) == pytest.approx(np.ones(len(x)))
    assert got["prediction"].tolist() == want.argmax(1).tolist()
    assert model.importances.sum() == pytest.approx(1.0) and model.importances[3] == 0.0


def test_boost_of_several_classes_votes_and_is_saved(spark, tmp_path):
    x, y = labelled(seed=3)
    params = {"rounds": 3, "max_depth": 2, "step": 0.5, "subsample": 0.8}
    fitted = M.fit_model(M.BOOST, vectors(spark, x, y), M.CLASSIFICATION, 3, params)
    frame = vectors(spark, x, y)
    before = fitted.score(frame).orderBy("key").toPandas()
    assert np.stack(before["probs"]).sum(1) == pytest.approx(np.ones(len(x)))
    assert (before["prediction"] == before["label"]).mean() > 0.8
    assert [r.feature for r in M.feature_importances(fitted, list("abcd"), spark).collect()][0] == "a"
    M.save_fitted(fitted, str(tmp_path), spark)
    after = M.load_fitted(str(tmp_path), spark).score(frame).orderBy("key").toPandas()
    assert np.stack(after["probs"]).tolist() == np.stack(before["probs"]).tolist()
    with pytest.raises(ValueError, match="no rows"):
        B.SoftmaxBoost(3).fit(frame.limit(0))


def regression(spark, n=300):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n)])
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["label"] = 3 * pdf["a"] + pdf["b"] ** 2 + rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("key", F.monotonically_increasing_id())
    return df, M.assembled(df, list("abc"), ["key", "label"]), x


@pytest.mark.parametrize("name,params", [(M.FOREST, {"trees": 7, "max_depth": 5}), (M.BOOST, {"rounds": 4, "max_depth": 3})])
def test_flat_trees_predict_and_share_a_grid(spark, monkeypatch, name, params):
    monkeypatch.setattr(T, "WALKED", 50)
    df, frame, x = regression(spark)
    fitted = M.fit_model(name, frame, M.REGRESSION, params=params)
    flat = T.of_spark(fitted.parts["m"], spark)
    got = {r.key: r.prediction for r in fitted.score(frame).collect()}
    rows = df.orderBy("key").toPandas()
    mine = flat.each(rows[list("abc")].to_numpy()) @ flat.weights
    assert mine == pytest.approx([got[k] for k in rows["key"]])
    for f in range(3):
        grid = np.linspace(-1, 4, 23)
        want = [(flat.each(np.column_stack([np.full(len(x), v) if i == f else x[:, i] for i in range(3)])) @ flat.weights).sum() for v in grid]
        assert flat.grid_sums(x, f, grid) == pytest.approx(want)
    dep = X.partial_dependence(fitted, df, list("abc"), "b").orderBy("value").toPandas()
    assert dep["value"].tolist() == [0, 1, 2, 3, 4, 5]
    for value, average in zip(dep["value"], dep["average"]):
        moved = M.assembled(df.withColumn("b", F.lit(float(value))), list("abc"), [])
        assert average == pytest.approx(fitted.score(moved).agg(F.avg("prediction")).first()[0], abs=1e-6)


def test_interval_of_a_hundred_trees_is_one_projection(spark):
    df, frame, x = regression(spark, 120)
    fitted = M.fit_model(M.FOREST, frame, M.REGRESSION, params={"trees": 100, "max_depth": 4})
    out = X.prediction_interval(fitted, frame)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = out.orderBy("key").toPandas()
    outs = [t.copy({t.predictionCol: f"t{i}"}) for i, t in enumerate(fitted.parts["m"].trees)]
    wide = frame
    for t in outs[:10]:
        wide = t.transform(wide)
    ten = wide.orderBy("key").select(*[f"t{i}" for i in range(10)]).toPandas().to_numpy()
    each = T.of_spark(fitted.parts["m"], spark).each(df.orderBy("key").toPandas()[list("abc")].to_numpy())
    assert each[:, :10] == pytest.approx(ten)
    assert got["prediction"].to_numpy() == pytest.approx(each.mean(1), abs=1e-5)
    assert got["lower_95"].to_numpy() == pytest.approx(np.quantile(each, 0.025, axis=1), abs=1e-5)
    assert got["upper_95"].to_numpy() == pytest.approx(np.quantile(each, 0.975, axis=1), abs=1e-5)


def test_rows_to_boost_are_kept_in_blocks(spark):
    x, y = labelled()
    df = vectors(spark, x, y)
    edges = B.bin_edges(df, 4)
    blocks = B._binned(df, edges, 3).collect()
    assert len(blocks) == 3  # one per partition of so few rows, not one per row
    label = np.concatenate([np.frombuffer(b["label"], np.int32) for b in blocks])
    bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(4, -1) for b in blocks], axis=1)
    want = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])
    assert sorted(zip(label, *bins)) == sorted(zip(y, *want))


def test_rows_alike_are_walked_once(spark, monkeypatch):
    df, frame, x = regression(spark, 2000)
    flat = T.of_spark(M.fit_model(M.FOREST, frame, M.REGRESSION, params={"trees": 3, "max_depth": 2}).parts["m"], spark)
    x[:3] = np.nan, np.inf, -np.inf
    grid = np.linspace(-1, 4, 23)
    for f in range(3):
        rows, counts = flat.alike(x, f)
        cells = np.prod([len(np.unique(flat.threshold[flat.feature == g])) + 1 for g in range(3) if g != f])
        assert len(rows) <= cells < 500 and counts.sum() == len(x)
        assert flat.grid_sums(rows, f, grid, counts) == pytest.approx(flat.grid_sums(x, f, grid))
    wide = np.tile(x, (1, 20))  # more cells than 64 bits tell apart
    many = T.FlatTrees(np.repeat(np.arange(60), 9), np.tile(np.linspace(-1, 4, 9), 60), *[np.zeros(540, np.int32)] * 2, np.zeros(540), np.zeros(1, np.int32), np.ones(1))
    assert many.alike(wide, 0)[1].sum() == len(x)
    assert len(many.alike(wide, 0)[0]) == len(np.unique(np.column_stack([np.searchsorted(np.linspace(-1, 4, 9), c) for c in x.T]), axis=0))


def test_rows_of_equal_bins_and_class_are_counted_once(spark, monkeypatch):
    x, y = labelled()
    x[:, 0] = np.round(x[:, 0])  # few values: rows alike
    df = vectors(spark, np.tile(x[:, [0, 1, 3]], (6, 1)), np.tile(y, 6))
    counted = B._counted(B._binned(df, B.bin_edges(df, 3), 3), 3).collect()
    sizes = [np.frombuffer(b["count"]) for b in counted]
    assert sum(map(len, sizes)) == len({(*r, c) for r, c in zip(x[:, [0, 1, 3]].tolist(), y)}) < 100
    assert sum(s.sum() for s in sizes) == 1200
    model = B.SoftmaxBoost(3, rounds=4, step=0.3, max_depth=3).fit(df)
    monkeypatch.setattr(B, "_counted", lambda rows, features: rows)
    plain = B.SoftmaxBoost(3, rounds=4, step=0.3, max_depth=3).fit(df)
    assert model.losses == pytest.approx(plain.losses) and model.importances == pytest.approx(plain.importances)
    assert model.trees.value == pytest.approx(plain.trees.value)


def test_margins_are_the_sums_of_the_trees(spark):
    x, y = labelled()
    model = B.SoftmaxBoost(3, rounds=4, step=0.3, max_depth=3).fit(vectors(spark, x, y))
    x[:3, 0] = np.nan, np.inf, -np.inf
    assert model.margins(x).T == pytest.approx(model.trees.each(x).reshape(len(x), -1, 3).sum(1))
    assert model.margins(x[:0]).shape == (3, 0)
