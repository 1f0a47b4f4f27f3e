"""Splits and folds lose no row: missing keys, missing classes, empty tables."""

import pytest
from pyspark.sql import functions as F

from tabulens.operators import splits as S
from tabulens.operators.metrics import bootstrap_ci


def keyed(spark, missing, n=100, kind="bigint"):
    key = F.when(F.col("id") >= missing, F.col("id")).cast(kind)
    return spark.range(n).select(key.alias("k"), (F.col("id") % 3).alias("label"), F.col("id").alias("row"))


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("missing", [0, 1, 40, 80])
def test_train_and_test_are_all_rows(spark, missing, kind):
    train, test = S.train_test_split(keyed(spark, missing, kind=kind), "k")
    a, b = {r.row for r in train.collect()}, {r.row for r in test.collect()}
    assert len(b) == 20 and not a & b and a | b == set(range(100))
    assert all(row >= missing for row in b)


def test_too_few_keys_raise(spark):
    with pytest.raises(ValueError, match="no key"):
        S.split_flag(keyed(spark, 81), "k")


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_every_row_has_a_fold(spark, kind):
    got = S.kfold_assign(keyed(spark, 40, kind=kind), "k", 4).collect()
    assert len(got) == 100 and {r.fold for r in got if r.k is None} == {3}
    assert {r.fold for r in got} == {0, 1, 2, 3}


def test_stratified_and_single_folds_of_missing_keys_and_classes(spark):
    df = keyed(spark, 40).withColumn("label", F.when(F.col("label") > 0, F.col("label")))
    got = S.stratified_kfold_assign(df, "label", "k", 5).collect()
    assert sorted(r.row for r in got) == list(range(100))
    for label in (None, 1, 2):
        sizes = [sum(r.fold == f for r in got if r.label == label) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    one, n = S.cv_assign(df, "k", "loo", "regression")
    assert n == 100 and sorted(r.fold for r in one.collect()) == list(range(100))


def test_empty_tables_stay_empty(spark):
    df = keyed(spark, 0).limit(0)
    assert S.split_flag(df, "k").collect() == [] and S.split_flag(df, "k").columns[-1] == "is_test"
    assert S.kfold_assign(df, "k").collect() == [] == S.stratified_kfold_assign(df, "label", "k").collect()


def test_rows_without_a_key_count_in_the_bootstrap(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").cast("double").alias("y"), (F.col("id") + F.col("id") % 7).cast("double").alias("p")
    )
    got = {r.metric: (r.ci_lower, r.ci_upper) for r in bootstrap_ci(df, "y", "p", "k", "regression").collect()}
    low, high = got["mae"] if "mae" in got else got["MAE"]
    assert low <= sum(i % 7 for i in range(300)) / 300 <= high


def test_the_cut_reads_the_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = keyed(spark, 10)
    flagged = S.split_flag(df.mapInArrow(counted, df.schema), "k")
    assert read.value == 100
    assert {r.row for r in flagged.where("is_test").collect()} == {r.row for r in S.split_flag(df, "k").where("is_test").collect()}
