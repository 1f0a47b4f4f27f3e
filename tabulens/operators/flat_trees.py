"""Decision trees as node arrays, walked for all trees and many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from tabulens.session import new_folder, remove

WALKED = 2_000_000  # (row, tree) places that are walked together


@dataclass
class FlatTrees:
    """Nodes of all trees: a row goes left where its feature is at most the threshold; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray  # of each tree in the prediction

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        at = np.tile(self.roots, (len(x), 1))
        rows, trees = np.nonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows, trees]
            lower = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(lower, self.left[node], self.right[node])
            at[rows, trees] = node
            more = self.feature[node] >= 0
            rows, trees = rows[more], trees[more]
        return at

    def each(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: what every tree predicts."""
        step = max(1, WALKED // max(len(self.roots), 1))
        parts = [self.value[self.leaves(x[i : i + step])] for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.roots)))

    def alike(self, x: np.ndarray, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that no split on another feature tells apart the first, and how many they are."""
        code, size = np.zeros(len(x), np.int64), 1
        for f in range(x.shape[1]):
            limits = np.unique(self.threshold[self.feature == f])
            if f == feature or not len(limits):
                continue
            if size > 2**31:  # codes stay within 64 bits
                code, size = np.unique(code, return_inverse=True)[1], len(x)
            code = code * (len(limits) + 1) + np.searchsorted(limits, x[:, f])
            size *= len(limits) + 1
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return x[first], counts

    def grid_sums(self, x: np.ndarray, feature: int, grid: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Sums over the rows of the prediction with ``feature`` set to each value of an ascending grid.

        With ``counts`` a row stands for as many.

        A tree is walked once for all grid values: a split on the feature shares the run of grid
        values out between both sides, any other split sends the run one way. A leaf then adds its
        value where its run begins and takes it off where it ends.
        """
        steps = np.zeros(len(grid) + 1)
        least = np.searchsorted(grid, self.threshold, side="right")  # grid values that go left
        size = max(1, WALKED // max(len(self.roots), 1))
        for i in range(0, len(x), size):
            part = x[i : i + size]
            row = np.repeat(np.arange(len(part)), len(self.roots))
            node, weight = np.tile(self.roots, len(part)), np.tile(self.weights, len(part))
            if counts is not None:
                weight = weight * counts[i + row]
            a, b = np.zeros(len(row), np.int64), np.full(len(row), len(grid), np.int64)
            while len(row):
                split = self.feature[node]
                leaf = split < 0
                value = self.value[node[leaf]] * weight[leaf]
                steps += np.bincount(a[leaf], value, len(steps)) - np.bincount(b[leaf], value, len(steps))
                row, node, weight, a, b, split = (v[~leaf] for v in (row, node, weight, a, b, split))
                own, cut = split == feature, least[node]
                lower = part[row, split] <= self.threshold[node]
                to_left = np.where(own, np.minimum(b, cut) > a, lower)
                to_right = np.where(own, np.maximum(a, cut) < b, ~lower)
                ends = np.where(own, np.minimum(b, cut), b)[to_left]
                starts = np.where(own, np.maximum(a, cut), a)[to_right]
                a, b = np.concatenate((a[to_left], starts)), np.concatenate((ends, b[to_right]))
                node = np.concatenate((self.left[node[to_left]], self.right[node[to_right]]))
                row, weight = (np.concatenate((v[to_left], v[to_right])) for v in (row, weight))
        return np.cumsum(steps[:-1])


def of_spark(model, spark) -> FlatTrees:
    """The trees of a fitted regression forest or boosted regression, read from its saved form.

    Spark itself holds a model on the driver and sends it to every task; the arrays are smaller.
    """
    folder = new_folder(spark, "trees")
    model.write().save(folder)
    node = F.col("nodeData")
    try:
        found = spark.read.parquet(f"{folder}/data").select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), node["split"]["numCategories"].alias("categories"),
        ).toPandas()
    finally:
        remove(spark, folder)
    if (found["categories"] >= 0).any():
        raise ValueError("a split by categories has no threshold")
    found = found.sort_values(["tree", "id"], ignore_index=True)  # ids count up from 0 in every tree
    roots = np.flatnonzero(found["id"] == 0).astype(np.int32)
    start = roots[found["tree"]]
    child = lambda name: np.where(found[name] < 0, -1, start + found[name]).astype(np.int32)
    forest = type(model).__name__.startswith("RandomForest")
    weights = np.full(len(roots), 1.0 / len(roots)) if forest else np.array(model.treeWeights)
    return FlatTrees(
        found["feature"].to_numpy(np.int32), found["threshold"].to_numpy(float), child("left"), child("right"),
        found["value"].to_numpy(float), roots, weights,
    )
