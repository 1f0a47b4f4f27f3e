"""Boosted trees for several classes: softmax loss, histograms of binned features, one tree per class and round.

Rows are kept in blocks, a block being one row of a frame: bin numbers of one byte (features x rows), classes
and margins (classes x rows), each as the bytes of one array. Rows of equal bins and class have equal margins in every round, so
unless rounds see a part of the rows they are counted once and a block's rows stand for as many. Each level of a round is one pass:
tasks add up first and second derivatives of the loss by (class, node, feature, bin),
the sums are merged, and the driver picks every node's split from them. What reaches the driver depends
on classes, nodes and bins alone. Leaf weights are -G / (H + l2), scaled by the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators.flat_trees import FlatTrees
from tabulens.session import settle

BINS = 256
L2 = 1.0
MIN_WEIGHT = 1.0  # second derivatives a child holds at least
FAN_IN = 64  # partial sums that one task, or the driver, merges
CUT_EVERY = 20  # rounds after which margins are written
BLOCK_ROWS = 65_536
BLOCKS = "row bigint, bins binary, label binary, margins binary, count binary"  # the number of the first row; no margins yet: zeros


@dataclass
class Tree:
    """A tree of the round at hand: nodes by number; splits are (feature, last bin on the left)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, last: int, left: tuple, right: tuple) -> list[int]:
        self.feature[node], self.bin[node] = feature, last
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for sums in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.sums.append(sums)
        return [self.left[node], self.right[node]]

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of features x rows ends in; in a leaf a row stays where it is."""
        feature, last, left = (np.array(v, np.int64) for v in (self.feature, self.bin, self.left))
        leaf = feature < 0
        # the right child follows the left one; no bin is above that of a leaf
        left, last = np.where(leaf, np.arange(len(left)), left), np.where(leaf, 255, last).astype(np.uint8)
        start, flat = np.where(leaf, 0, feature) * bins.shape[1], bins.ravel()
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        level = np.flatnonzero(~leaf[:1])
        while len(level):
            right = flat.take(start.take(at) + rows) > last.take(at)
            at = left.take(at) + right
            level = np.concatenate([left[level], left[level] + 1])
            level = level[~leaf[level]]
        return at

    def values(self, step: float, l2: float) -> np.ndarray:
        return np.array([-step * g / (h + l2) for g, h in self.sums])


def _unpacked(batch: pa.RecordBatch, features: int, classes: int) -> Iterator[tuple]:
    """Number of the first row, bins, labels, margins and counts of every block."""
    for row, bins, label, margins, count in zip(*(batch[c] for c in ("row", "bins", "label", "margins", "count"))):
        label = np.frombuffer(label.as_buffer(), np.int32)
        held = np.frombuffer(margins.as_buffer()) if margins.is_valid else np.zeros(len(label) * classes)
        count = np.frombuffer(count.as_buffer()) if count.is_valid else np.ones(len(label))
        yield row.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(features, -1), label, held.reshape(classes, -1), count


def softmax(margins: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(margins - margins.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def _drawn(rows: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a round sees: a hash of row and round."""
    x = (rows.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)) * 2.0**-53 < share


def bin_edges(train: DataFrame, features: int) -> list[np.ndarray]:
    """Ascending values per feature that bins end at: all values where there are few, else quantiles; one scan."""
    x = vector_to_array("features")
    probs = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    row = train.agg(*[F.percentile_approx(x[i], probs, 100 * BINS).alias(f"e{i}") for i in range(features)]).first()
    return [np.unique(np.array(v or [], float)) for v in row]


def _binned(train: DataFrame, edges: list[np.ndarray], classes: int) -> DataFrame:
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch["label"].null_count:
                raise ValueError("a row to train on has no class")
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, i]).astype(np.uint8) for i, e in enumerate(edges)])
            label = batch["label"].to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["row"][:1], *(pa.array([v.tobytes()], pa.binary()) for v in (bins, label)), *[pa.nulls(1, pa.binary())] * 2],
                ["row", "bins", "label", "margins", "count"],
            )

    # numbers count up by one within a partition, so the first one of a batch stands for all
    rows = train.select(
        F.monotonically_increasing_id().alias("row"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")
    )
    return rows.mapInArrow(put, BLOCKS)


def _counted(blocks: DataFrame, features: int) -> DataFrame:
    """Blocks in which rows of equal bins and class are one row with their number."""
    words = [f"w{i}" for i in range(-(-features // 8))]  # eight bins each

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bins, label, *_ in (block for batch in batches for block in _unpacked(batch, features, 1)):
            wide = np.zeros((len(label), 8 * len(words)), np.uint8)
            wide[:, :features] = bins.T
            packed = np.ascontiguousarray(wide.view(np.int64).T)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*packed, label)], [*words, "label"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if not held or (batch is not None and size < BLOCK_ROWS):
                continue
            *packed, label, count = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(words) + 2))
            bins = np.stack(packed, 1).view(np.uint8).T[:features]
            arrays = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (bins, label, count.astype(float))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0]), *arrays[:2], pa.nulls(1, pa.binary()), arrays[2]], ["row", "bins", "label", "margins", "count"]
            )
            held, size = [], 0

    rows = blocks.mapInArrow(spread, "".join(f"{w} bigint, " for w in words) + "label int")
    return rows.groupBy(*words, "label").agg(F.count("*").alias("count")).mapInArrow(put, BLOCKS)


def _sums(rows: DataFrame, trees: list[Tree], features: int, classes: int, seed: int, share: float, parts: int) -> tuple[np.ndarray, float, int]:
    """Derivatives by (class, open node, feature, bin), at the roots the log loss summed, and the rows: one pass."""
    root = all(len(t.feature) == 1 for t in trees)
    opens = max(len(t.open) for t in trees)
    shape = (2, classes, opens, features, BINS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(shape), 0.0, 0
        for row, bins, label, margins, count in (block for batch in batches for block in _unpacked(batch, features, classes)):
            p = softmax(margins, 0)
            if root:
                loss -= float(np.log(np.maximum(p[label, np.arange(len(label))], 1e-300)) @ count)
            n += int(count.sum())
            seen = _drawn(row + np.arange(len(label)), seed, share) if share < 1 else None
            for k, tree in enumerate(trees):
                if not tree.open:
                    continue
                g = (p[k] - (label == k)) * count
                h, part, at = np.maximum(2 * p[k] * (1 - p[k]), 1e-16) * count, bins, None
                if len(tree.feature) > 1 or seen is not None:
                    slot = np.full(len(tree.feature), -1)
                    slot[tree.open] = np.arange(len(tree.open))
                    at = slot[tree.walk(bins)]
                    used = np.flatnonzero((at >= 0) & seen) if seen is not None else np.flatnonzero(at >= 0)
                    if len(used) < len(at):
                        g, h, part, at = g[used], h[used], bins[:, used], at[used]
                    at = at * BINS
                for f in range(features):
                    cell = part[f] if at is None else at + part[f]
                    for d, w in enumerate((g, h)):
                        total[d, k, :, f] += np.bincount(cell, w, opens * BINS).reshape(opens, BINS)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "loss": [loss], "n": [n], "total": [total.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in group["total"])
        return pd.DataFrame({"part": group["part"].min(), "loss": group["loss"].sum(), "n": group["n"].sum(), "total": [total.tobytes()]})

    schema = "part bigint, loss double, n bigint, total binary"
    found, span = rows.mapInArrow(add, schema), 1
    while parts > FAN_IN * span:
        span *= FAN_IN
        found = found.groupBy(F.expr(f"part div {span}")).applyInPandas(merge, schema)
    got = found.collect()
    total = sum((np.frombuffer(r["total"]) for r in got), np.zeros(int(np.prod(shape))))
    return total.reshape(shape), sum(r["loss"] for r in got), sum(r["n"] for r in got)


def best_split(g: np.ndarray, h: np.ndarray, l2: float, min_weight: float):
    """(gain, feature, last bin on the left, left sums, right sums) of a node's features x bins; the first of equal gains."""
    all_g, all_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain[(left_h < min_weight) | (right_h < min_weight)] = -1.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return gain[f, b], int(f), int(b), (left_g[f, b], left_h[f, b]), (right_g[f, b], right_h[f, b])


def _updated(rows: DataFrame, trees: list[Tree], features: int, classes: int, step: float, l2: float) -> DataFrame:
    values = [t.values(step, l2) for t in trees]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for _, bins, _, margins, _ in _unpacked(batch, features, classes):
                moved.append((margins + np.stack([v[t.walk(bins)] for t, v in zip(trees, values)])).tobytes())
            yield batch.set_column(3, "margins", pa.array(moved, pa.binary()))

    return rows.mapInArrow(move, BLOCKS)


@dataclass
class SoftmaxBoost:
    """A learner with Spark's ``fit``: columns ``features`` and ``label`` (0 to classes - 1)."""

    classes: int
    rounds: int = 300
    step: float = 0.05
    max_depth: int = 6
    subsample: float = 1.0
    seed: int = 42
    l2: float = L2
    min_weight: float = MIN_WEIGHT

    def fit(self, train: DataFrame) -> SoftmaxModel:
        """Margins start at 0. A table without rows raises; a feature with one value is never split on."""
        first = train.select(F.size(vector_to_array("features")).alias("n")).first()
        if first is None:
            raise ValueError("no rows to train on")
        features, classes = first["n"], self.classes
        edges = bin_edges(train, features)
        rows = _binned(train, edges, classes)
        rows = settle(rows if self.subsample < 1 else _counted(rows, features))  # partitions stay even
        parts = rows.rdd.getNumPartitions()
        rounds, losses, held, before = [], [], None, None
        gains = np.zeros(features)
        for r in range(self.rounds):
            trees = [Tree() for _ in range(classes)]
            for depth in range(self.max_depth):
                sums, loss, n = _sums(rows, trees, features, classes, self.seed + r, self.subsample, parts)
                if depth == 0:
                    losses.append(loss / n)
                    if before is not None:
                        before.unpersist()  # this pass has made the margins after
                for k, tree in enumerate(trees):
                    grown: list[int] = []
                    for slot, node in enumerate(tree.open):
                        g, h = sums[0, k, slot], sums[1, k, slot]
                        if depth == 0:
                            tree.sums[0] = (g[0].sum(), h[0].sum())
                        gain, f, last, left, right = best_split(g, h, self.l2, self.min_weight)
                        if gain > 1e-12:
                            gains[f] += gain
                            grown += tree.split(node, f, last, left, right)
                    tree.open = grown
                if not any(t.open for t in trees):
                    break
            rounds += trees
            moved = _updated(rows, trees, features, classes, self.step, self.l2)
            cut = r % CUT_EVERY == CUT_EVERY - 1
            moved = settle(moved) if cut else moved.persist()
            if cut and held is not None:
                held.unpersist()
            before = None if cut else held
            rows, held = moved, None if cut else moved
            parts = rows.rdd.getNumPartitions() if cut else parts
        for kept in (before, held):
            if kept is not None:
                kept.unpersist()
        return SoftmaxModel(_flat(rounds, edges, self.step, self.l2), classes, gains / (gains.sum() or 1.0), losses)


def _flat(trees: list[Tree], edges: list[np.ndarray], step: float, l2: float) -> FlatTrees:
    """Bin splits as thresholds on the values themselves."""
    columns, roots, n = [], [], 0
    for t in trees:
        roots.append(n)
        limit = [float(edges[f][b]) if f >= 0 and b < len(edges[f]) else np.inf for f, b in zip(t.feature, t.bin)]
        shift = lambda v: [c + n if c >= 0 else -1 for c in v]  # noqa: B023, E731
        columns.append((t.feature, limit, shift(t.left), shift(t.right), t.values(step, l2).tolist()))
        n += len(t.feature)
    feature, threshold, left, right, value = (sum((c[i] for c in columns), []) for i in range(5))
    ints = lambda v: np.array(v, np.int32)
    return FlatTrees(ints(feature), np.array(threshold, float), ints(left), ints(right), np.array(value, float), ints(roots), np.ones(len(roots)))


@dataclass
class SoftmaxModel:
    """Adds ``prediction`` and ``probability``, an array that sums to 1."""

    trees: FlatTrees  # one per class and round, classes in turn
    classes: int
    importances: np.ndarray
    losses: list[float]  # mean log loss before each round

    @property
    def featureImportances(self):
        return Vectors.dense(self.importances)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x), 0).T

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Classes x rows: one tree at a time; a right child follows the left one, and rows stay in a leaf."""
        t, leaf = self.trees, self.trees.feature < 0
        left, limit = np.where(leaf, np.arange(len(leaf)), t.left).astype(np.int64), np.where(leaf, np.inf, t.threshold)
        columns = np.where(leaf, 0, t.feature).astype(np.int64) * len(x)
        flat, rows = np.where(np.isnan(x), np.inf, x).T.ravel(), np.arange(len(x))  # no threshold is at least NaN: right
        total = np.zeros((self.classes, len(x)))
        for i, root in enumerate(t.roots):
            at, level = np.full(len(x), root, np.int64), np.flatnonzero(~leaf[root : root + 1]) + root
            while len(level):
                at = left.take(at) + (flat.take(columns.take(at) + rows) > limit.take(at))
                level = np.concatenate([left[level], left[level] + 1])
                level = level[~leaf[level]]
            total[i % self.classes] += t.value.take(at)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.arrow_udf("array<double>")
        def probs(x: pa.Array) -> pa.Array:
            found = model.probabilities(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else np.zeros((0, 1))
            ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        out = df.select("*", probs(vector_to_array("features")).alias("probability"))
        best = F.array_position("probability", F.array_max("probability")) - 1  # the first of equal ones
        return out.withColumn("prediction", best.cast("double"))

    def save(self, path: str, spark: SparkSession) -> None:
        t = self.trees
        nodes = pd.DataFrame({"node": np.arange(len(t.feature)), "feature": t.feature, "threshold": t.threshold, "left": t.left, "right": t.right, "value": t.value})
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        whole = [(self.classes, t.roots.tolist(), self.importances.tolist(), self.losses)]
        schema = "classes int, roots array<int>, importances array<double>, losses array<double>"
        spark.createDataFrame(whole, schema).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(path: str, spark: SparkSession) -> SoftmaxModel:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
        m = spark.read.parquet(f"{path}/model").first()
        ints = lambda c: nodes[c].to_numpy(np.int32)
        roots = np.array(m["roots"], np.int32)
        trees = FlatTrees(ints("feature"), nodes["threshold"].to_numpy(float), ints("left"), ints("right"), nodes["value"].to_numpy(float), roots, np.ones(len(roots)))
        return SoftmaxModel(trees, m["classes"], np.array(m["importances"]), list(m["losses"]))
