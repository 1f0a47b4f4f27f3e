"""Repeatable train/test splits and cross-validation folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import ref
from tabulens.functions.hashing import row_order, slot
from tabulens.operators.ranks import order_statistics, running_totals

# Defaults and limits of the splits.
TEST_SIZE = 0.2
TEST_SIZE_ALLOWED = (0.05, 0.5)
SEED = 42
FOLDS = 5


def split_flag(
    df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """Mark ceil(n * test_size) rows as test rows, by hash order of a unique key.

    The cut is the exact order statistic of the hash, found without sorting the rows. Rows that
    share the hash of the cut, few of any key, are told apart by the key. Rows without a key count
    among the n rows and are training rows; should the test rows not fill up without them, it raises.
    An empty table stays empty.
    """
    if not TEST_SIZE_ALLOWED[0] <= test_size <= TEST_SIZE_ALLOWED[1]:
        raise ValueError("test_size must be between 0.05 and 0.5")
    order, keyed = row_order(df, key, seed), ref(key).isNotNull()
    hashed = df.select(order.cast("double").alias("h"), keyed.alias("named")).persist()  # read four times
    try:
        n = hashed.count()
        if not n:
            return df.withColumn(name, F.lit(False))
        rank = math.ceil(n * test_size) - 1
        cut = order_statistics(hashed.select("h"), {"h": [rank]}, {"h": n})["h"][rank]
        below, at, named = hashed.agg(
            F.count_if(F.col("h") < cut), F.count_if((F.col("h") == cut) & F.col("named")), F.count_if("named")
        ).first()
    finally:
        hashed.unpersist()
    if named < rank + 1:
        raise ValueError(f"{n - named} of {n} rows have no key, too many to tell test from training rows")
    flag = keyed & (order.cast("double") <= F.lit(cut))
    if below + at > rank + 1:
        tied = df.where(keyed & (order.cast("double") == F.lit(cut))).select(ref(key).alias("k")).orderBy("k")
        last = tied.limit(rank + 1 - below).agg(F.max("k")).first()[0]
        tie = (order.cast("double") == F.lit(cut)) & F.coalesce(ref(key) <= F.lit(last), F.lit(False))
        flag = keyed & ((order.cast("double") < F.lit(cut)) | tie)
    return df.withColumn(name, flag)


def train_test_split(
    df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    marked = split_flag(df, key, test_size, seed, "_test")
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def kfold_assign(df: DataFrame, key: str, k: int = FOLDS, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 from the leading bits of the row hash; no shuffle. Rows without a key are in the last fold."""
    return df.withColumn(name, slot(df, key, k, seed))


def stratified_kfold_assign(
    df: DataFrame, label: str, key: str, k: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Folds that split every class evenly: the position within the class in hash order, mod k.

    Positions come from running totals over range partitions, so a class that holds
    most rows is still numbered by many tasks. Rows without a class are a class of their own, and rows
    without a key come last in theirs.
    """
    marked = df.withColumn("_class", ref(label)).withColumn("_h", row_order(df, key, seed))
    numbered = running_totals(
        marked, [F.col("_h"), ref(key)], {}, by=["_class"], number="_at"
    )
    return numbered.withColumn(name, F.pmod("_at", F.lit(k)).cast("int")).drop("_class", "_h", "_at")


def cv_assign(
    df: DataFrame,
    key: str,
    strategy: str,
    problem_type: str,
    k: int = FOLDS,
    label: str = "label",
    seed: int = SEED,
) -> tuple[DataFrame, int]:
    """Folds by strategy name and their number; leave-one-out gives every row a fold of its own."""
    if strategy == "stratified_k_fold" and problem_type == "classification":
        return stratified_kfold_assign(df, label, key, k, seed), k
    if strategy == "loo":
        one = running_totals(df.withColumn("_h", row_order(df, key, seed)), [F.col("_h"), ref(key)], {}, number="fold")
        return one.drop("_h"), df.count()
    return kfold_assign(df, key, k, seed), k
