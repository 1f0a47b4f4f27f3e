"""Order statistics, running totals and rank joins against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions.hashing import sample_n
from tabulens.operators import ranks as R
from tabulens.operators.splits import kfold_assign, split_flag, stratified_kfold_assign


def hot_values(n=3000, seed=1):
    """A third of all rows share one value; the rest are spread and partly negative."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) ** 3
    x[: n // 3] = 0.25
    rng.shuffle(x)
    return x


@pytest.mark.parametrize("limit", [20, 100, 10**6])
def test_percentiles_narrowing_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "SORT_LIMIT", limit)
    monkeypatch.setattr(R, "ACCURACY", 50)
    x = hot_values()
    y = np.where(np.arange(3000) % 7 == 0, np.nan, np.arange(3000) % 5)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.501, 0.75, 0.99, 1.0]
    got = R.percentiles(df, ["x", "y"], probs)
    assert got["x"] == pytest.approx(np.percentile(x, [p * 100 for p in probs]), abs=1e-12)
    assert got["y"] == pytest.approx(np.nanpercentile(y, [p * 100 for p in probs]), abs=1e-12)


def test_percentiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 3.0), (None, None)], "a double, b double")
    assert R.percentiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [None, None], "b": [3.0, 3.0]}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_running_totals_do_not_depend_on_partitions(spark, parts):
    pdf = pd.DataFrame({"g": np.arange(500) % 3, "v": np.random.default_rng(3).permutation(500), "w": np.arange(500)})
    df = spark.createDataFrame(pdf).repartition(parts)
    got = R.running_totals(df, [F.col("v")], {"before": "w"}, by=["g"], number="i").toPandas()
    pdf = pdf.sort_values(["g", "v"])
    pdf["before"] = pdf.groupby("g").w.cumsum() - pdf.w
    pdf["i"] = pdf.groupby("g").cumcount()
    got = got.sort_values(["g", "v"])[["g", "v", "w", "before", "i"]]
    assert got.astype("int64").values.tolist() == pdf[["g", "v", "w", "before", "i"]].values.tolist()


@pytest.mark.parametrize("bound", [0, 10**6])
def test_avg_rank_with_hot_key_and_nulls(spark, monkeypatch, bound):
    """Both ways of joining the ranks back: broadcast, and shuffle with spread hot keys."""
    monkeypatch.setattr(R, "BROADCAST_ROWS", bound)
    x = hot_values()
    x[5:40] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x}))
    got = R.avg_rank(df, "x").orderBy("id").toPandas()["x_rank"]
    want = pd.Series(x).rank()
    assert len(got) == len(x)
    assert np.array_equal(got.isna(), want.isna())
    assert np.allclose(got.dropna(), want.dropna())


def test_hash_sample_is_the_same_on_any_partitioning(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    one = {r.id for r in sample_n(df.repartition(1), 50, "id").collect()}
    many = {r.id for r in sample_n(df.repartition(13), 50, "id").collect()}
    assert one == many and len(one) == 50


def test_split_is_exact_and_stratified_folds_are_even(spark, monkeypatch):
    monkeypatch.setattr(R, "SORT_LIMIT", 50)
    df = spark.range(1003).withColumn("c", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    assert split_flag(df, "id", 0.2).where("is_test").count() == 201
    sizes = stratified_kfold_assign(df, "c", "id", 5).groupBy("c", "fold").count().toPandas()
    for _, part in sizes.groupby("c"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1
    with pytest.raises(ValueError):
        split_flag(df, "id", 0.7)


def test_folds_do_not_line_up_with_the_split(spark):
    df = split_flag(spark.range(4000), "id", 0.2)
    got = kfold_assign(kfold_assign(df, "id", 5, 43, "a"), "id", 5, 44, "b").toPandas()
    for c in ("a", "b"):
        share = got.groupby(c).is_test.mean()
        assert len(share) == 5 and share.between(0.13, 0.27).all()
    assert (got.groupby(["a", "b"]).size() > 100).sum() == 25


def test_infinities_that_fill_more_than_a_sort(spark, monkeypatch):
    monkeypatch.setattr(R, "SORT_LIMIT", 20)
    values = [float("inf")] * 60 + [float("-inf")] * 40 + [float(i) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wanted = [0, 39, 40, 89, 90, 149]
    got = R.order_statistics(df, {"x": wanted}, {"x": len(values)})["x"]
    assert [got[k] for k in wanted] == [sorted(values)[k] for k in wanted]


def test_lookup_without_broadcast_spreads_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    keys = [0] * 600 + [None] * 300 + list(range(1, 101)) + [777]
    df = spark.createDataFrame([(k,) for k in keys], "key int").repartition(4)
    table = spark.createDataFrame([(i, f"v{i}", 600 if i == 0 else 1) for i in range(101)], "k bigint, v string, n bigint")
    got = R.lookup(df, F.col("key"), table, "k", "v", "new", "n").groupBy("key", "new").count().collect()
    want = {(0, "v0"): 600, (None, None): 300, (777, None): 1} | {(i, f"v{i}"): 1 for i in range(1, 101)}
    assert {(r.key, r.new): r["count"] for r in got} == want


def test_lookup_size_counts_the_values(spark):
    table = spark.createDataFrame([(1, "x" * 1000, 1)], "k int, v string, n bigint")
    assert R.table_facts(table, "k", "n", value="v") == {"n": 1, "b": 1001, "w": 1}
