"""Means and co-moments of many columns in one pass.

Every task folds its batches into one state: the rows, the mean of every column, and the matrix of
centred products. Two states merge exactly (the pairwise update of Chan, Golub and LeVeque), so
nothing is lost to large means. States of a task are merged in groups, level by level, and only the
last few reach the driver: k x k numbers each, whatever the number of rows.

A missing value enters as 0 next to a column that flags it. Filling the gaps with any value later is
a linear map of value and flag, so it needs no further pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import ref

FAN_IN = 64  # states that one task merges at most,
MERGE_BYTES = 256 * 1024 * 1024  # and their size together
LAST = 4096  # tasks that a state on the driver stands for at least
CONSTANT = 1e-14  # a spread below this share of the values is rounding
STATE = "part bigint, n bigint, mean binary, moments binary"


class Moments:
    """Rows, means and centred products of columns, their gaps as flags behind them."""

    def __init__(self, size: int, n: int = 0, mean: np.ndarray | None = None, moments: np.ndarray | None = None):
        self.size, self.n = size, n
        self.mean = np.zeros(size) if mean is None else mean
        self.moments = np.zeros((size, size)) if moments is None else moments

    def add(self, n: int, mean: np.ndarray, moments: np.ndarray) -> None:
        if n:
            both, apart = self.n + n, mean - self.mean
            self.moments += moments
            self.moments += np.outer(apart, apart) * (self.n * (n / both))
            self.mean += apart * (n / both)
            self.n = both

    def add_rows(self, values: np.ndarray) -> None:
        """Rows of the k columns; NaN is a gap."""
        gaps = np.isnan(values)
        values = np.where(gaps, 0.0, values)
        if gaps.any():
            values = np.hstack((values, gaps))
        used = values.shape[1]
        mean = values.mean(0)
        centred = values - mean
        whole = np.zeros(self.size)
        whole[:used] = mean
        moments = np.zeros((self.size, self.size))
        with np.errstate(invalid="ignore"):
            moments[:used, :used] = centred.T @ centred
        self.add(len(values), whole, moments)

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "mean": [self.mean.tobytes()], "moments": [self.moments.tobytes()]})

    def filled(self, values: np.ndarray) -> Moments:
        """The moments after every gap of column i got ``values[i]``; NaN where a column has nothing but gaps."""
        k = self.size // 2
        values = np.where(self.mean[k:] > 0, values, 0.0)
        both = self.moments[:k, k:] * values
        moments = self.moments[:k, :k] + both + both.T + self.moments[k:, k:] * np.outer(values, values)
        return Moments(k, self.n, self.mean[:k] + self.mean[k:] * values, moments)

    def gaps(self) -> np.ndarray:
        """Missing values of each column."""
        return np.rint(self.mean[self.size // 2 :] * self.n).astype(np.int64)

    def constant(self) -> np.ndarray:
        """Columns without spread, whose centred products are rounding errors at most."""
        spread = np.diag(self.moments)
        return ~(spread > self.n * (CONSTANT * np.abs(self.mean)) ** 2) & ~np.isnan(spread)

    def correlations(self) -> np.ndarray:
        """The correlation matrix; NaN where a column is constant, missing or infinite."""
        spread = np.sqrt(np.where(self.constant(), np.nan, np.diag(self.moments)))
        out = np.clip(self.moments / np.outer(spread, spread), -1.0, 1.0)
        known = ~np.isnan(np.diag(out))
        out[known, known] = 1.0
        return out

    def products(self) -> np.ndarray:
        """X'X, not centred."""
        return self.moments + self.n * np.outer(self.mean, self.mean)


def _merged(size: int, states: pd.DataFrame) -> Moments:
    total = Moments(size)
    for n, mean, moments in zip(states["n"], states["mean"], states["moments"]):
        total.add(n, np.frombuffer(mean), np.frombuffer(moments).reshape(size, size))
    return total


def states(df: DataFrame, cols: list[str]) -> DataFrame:
    """One state for LAST or more tasks each over the double columns ``cols``: one scan of ``df``."""
    size = 2 * len(cols)
    fan = max(2, min(FAN_IN, MERGE_BYTES // (8 * size * size + 1)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = Moments(size), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                total.add_rows(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]))
        if total.n:
            yield pa.RecordBatch.from_pandas(total.row(part), preserve_index=False)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return _merged(size, group).row(int(group["part"].min()))

    rows = df.select(F.spark_partition_id().cast("bigint").alias("part"), *[ref(c).alias(f"c{i}") for i, c in enumerate(cols)])
    level, span = rows.mapInArrow(fold, STATE), 1
    while span < LAST:
        span *= fan
        level = level.groupBy(F.expr(f"part div {span}")).applyInPandas(merge, STATE)
    return level


def comoments(df: DataFrame, cols: list[str]) -> Moments:
    """The moments of the double columns ``cols``. An empty frame has 0 rows and moments of 0."""
    return _merged(2 * len(cols), states(df, cols).toPandas())
