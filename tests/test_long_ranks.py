"""Ranks in long form and salted lookups, with bounds lowered so that small tables take the large ways."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import correlation as K
from tabulens.operators import ranks as R


def mixed(n=700, k=6, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    x[: n // 2, 0] = 0.5  # a hot value, larger than a range of rows
    x[:, 1] = rng.integers(0, 4, n)
    x[:, 2] = -0.0
    x[::2, 2] = 0.0
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]).sample(frac=1, random_state=0).reset_index(drop=True)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_long_ranks_are_average_ranks(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pdf = mixed()
        pdf.iloc[5:9, 3] = np.nan
        df = spark.createDataFrame(pdf).repartition(3)
        cols = df.columns
        long = R.ranked_long(df, cols, len(pdf)).toPandas()
        for i, c in enumerate(cols):
            mine = long[long["i"] == i].sort_values("x")
            assert (mine["below"] + (mine["equal"] + 1) / 2).tolist() == sorted(pdf[c].rank().dropna())
        wide = R.by_row(R.ranked_long(df, cols, len(pdf)), cols, F.col("below") + (F.col("equal") + 1) / 2.0).toPandas()
        key = list(cols)
        assert wide.sort_values(key)[key].to_numpy() == pytest.approx(pdf.rank().sort_values(key)[key].to_numpy(), nan_ok=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fifty_columns_take_two_shuffles_of_rows(spark):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(0).normal(size=(200, 50)), columns=[f"c{i}" for i in range(50)]))
    plan = R.by_row(R.ranked_long(df, df.columns, 200), df.columns, F.col("below"))._jdf.queryExecution().executedPlan().toString()
    # the range shuffle is behind the written file; of the rest only the way back to the rows moves rows
    assert plan.count("hashpartitioning(row") == 1 and plan.count("SortMergeJoin") == 0 == plan.count("ShuffledHashJoin")


@pytest.mark.parametrize("bound", [0, 50, 10**6])
def test_rank_correlations_of_every_way(spark, monkeypatch, bound):
    monkeypatch.setattr(R, "BROADCAST_ROWS", bound)
    pdf = mixed()
    df = spark.createDataFrame(pdf).repartition(5)
    for method, matrix in (("spearman", K.corr_spearman_matrix), ("kendall", K.corr_kendall_matrix)):
        got = matrix(df).toPandas().pivot(index="x", columns="y", values="value").loc[list(pdf), list(pdf)].to_numpy(float)
        want = np.full((6, 6), np.nan)
        for i, x in enumerate(pdf):
            for j, y in enumerate(pdf):
                want[i, j] = tau(pdf[x], pdf[y]) if method == "kendall" else pdf[x].rank().corr(pdf[y].rank())
        assert got == pytest.approx(want, abs=1e-4, nan_ok=True)


def tau(x, y):
    """Kendall's tau-b over all pairs."""
    a, b = (np.sign(np.subtract.outer(v.to_numpy(), v.to_numpy())) for v in (x, y))
    spread = np.sqrt((a != 0).sum() * (b != 0).sum())
    return (a * b).sum() / spread if spread else np.nan


def test_a_hot_key_is_spread_over_its_share_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))
        df = spark.range(20_000).select(key.alias("k"), F.col("id").alias("row")).repartition(4)
        table = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
        out = R.lookup(df, F.col("k"), table, "k", "v", "found", "n")
        tasks = out.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 64 and out.where("found = k * 2").count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_are_put_together_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """Neither the table of rows before the shuffle nor the one behind it grows with the input."""
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    pdf = mixed(500)[["c0", "c3"]]
    ranked = K.with_ranks(spark.createDataFrame(pdf), list(pdf))
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    shuffle = next(at for at, line in enumerate(plan.splitlines()) if "partitioning(row" in line or "REPARTITION_BY_NUM" in line)
    assert "row#" in plan.splitlines()[shuffle] and ", 10)" in plan.splitlines()[shuffle]  # 500 rows of 2 values, 100 a task
    assert not any("HashAggregate(keys=[row" in line for line in plan.splitlines()[shuffle:])
    got = ranked.toPandas().sort_values(list(pdf)).to_numpy()
    assert got == pytest.approx(pdf.rank().sort_values(list(pdf)).to_numpy())


def test_a_row_goes_through_the_kendall_shuffle_twice_a_pair(spark, monkeypatch):
    """Hot values and infinities included; rows tied by a hot value go nowhere."""
    monkeypatch.setattr(K, "RANK_BUCKET_BITS", 3)
    pdf = mixed(400, 4)
    pdf.loc[:9, "c3"] = np.inf
    pdf.loc[10:19, "c3"] = -np.inf
    blocks, single, varies = K._blocks(spark.createDataFrame(pdf), list(pdf))
    assert varies == [True, True, False, True]
    pairs = [(0, 1), (0, 3), (1, 2)]
    sent = []
    apply = type(blocks.groupBy()).applyInArrow
    monkeypatch.setattr(type(blocks.groupBy()), "applyInArrow", lambda g, f, s: sent.append(g._df) or apply(g, f, s))
    for (a, b), (n, discordant, *ties) in zip(pairs, K._pair_counts(blocks, single, pairs)):
        x, y = (np.sign(np.subtract.outer(v, v)) for v in (pdf.iloc[:, i].rank().to_numpy() for i in (a, b)))
        want = [(x * y < 0).sum(), (x == 0).sum() - 400, (y == 0).sum() - 400, ((x == 0) & (y == 0)).sum() - 400]
        assert (n, discordant, *ties) == (400, *[w // 2 for w in want])
    rows = sent[-1].groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks")).collect()
    assert all(r["n"] <= 400 for r in rows) and len(rows) <= 2 * len(pairs)
    assert next(r["n"] for r in rows if r["side"] == 0) <= 200  # half of c0 is one value
    assert sent[-1].groupBy("side", "block").count().agg(F.max("count")).first()[0] <= 16


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        x = rng.integers(0, max(n // 2, 1), n).astype(float)
        assert K.inversions(x) == sum(int((x[:i] > x[i]).sum()) for i in range(n))
