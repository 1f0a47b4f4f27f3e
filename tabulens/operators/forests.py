"""Regression forests on many rows, any number of them grown side by side: one pass per level for all.

Rows are kept in blocks, as in ``boosting``, a block being one row of a frame: bin numbers of one byte (features x rows), the
part of the input a row belongs to, labels and how often each tree draws each row (trees x rows). No tree tells rows of
equal bins apart, so where they are many those of a part become one cell: its rows, sums and squares of labels, and by tree
draws and drawn labels. A forest names the parts it is trained and scored on and the features it may split on. Tasks add up
drawn labels and draws by (node, feature, bin), the sums are merged, and the driver picks every node's split from them; what
reaches it depends on nodes and bins alone.

As in Spark's forests a tree draws every row by a Poisson of mean 1, splits lie between values where a feature has at most
BINS of them and else at quantiles, and a split must take variance away. All forests share bins and draws. Labels of 0 and 1
make forests of two classes: the variance is half their Gini impurity, a leaf's mean the share of class 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import ref
from tabulens.operators.boosting import Tree
from tabulens.operators.profile import few_distinct
from tabulens.session import settle

BINS = 32
FIT_ROWS = 2_000_000  # rows up to which every forest is fitted by Spark; those of more rows grow side by side
BLOCK_ROWS = 65_536
BLOCK_BYTES = 2**24  # of a block's draws
CELL_ROWS = 1_000_000  # rows that a task groups by cell at a time
CELL_SHARE = 4  # rows per cell from which cells are kept instead of rows
SUMS = 2_000_000  # sums that one pass adds up: 16 MB per task
NODES = 500_000  # of the trees that one pass scores
FAN_IN = 16  # partial sums that one task, or the driver, merges
NOISE = 1e-11  # of a node's squares: no split gains less
COLUMNS = ["bins", "part", "label", "draws", "sums"]  # without sums the block is one of rows
BLOCKS = "bins binary, part binary, label binary, draws binary, sums binary"
TOTALS = "task bigint, total binary"
# Draws of a tree by 32 random bits: as many as cuts are reached.
CUTS = np.array([int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint32)


@dataclass
class Forest:
    """Features to split on, flags by part of the rows to train and to score on, and the trees with their gains by feature.

    ``tried``: how many of the features, drawn anew, a node may be split on; 0 for all.
    """

    features: list[int]
    trained: np.ndarray
    scored: np.ndarray
    tried: int = 0
    trees: list[Tree] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)

    def importances(self) -> np.ndarray:
        """By place in ``features``: shares of the gain per tree, averaged over the trees that split."""
        shares = sum((g / g.sum() for g in self.gains if g.sum() > 0), np.zeros(len(self.features)))
        return shares / (shares.sum() or 1.0)


@dataclass
class Blocks:
    rows: DataFrame
    tasks: int
    features: int
    trees: int
    mean: float  # of all labels; sums are of distances from it
    edges: list[np.ndarray]
    seed: int


def bin_edges(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Ascending thresholds of f0, f1, ...: the middles between all values where there are few, else quantiles."""
    names = [f"f{i}" for i in range(features)]
    few = few_distinct(rows.select(*names), names, BINS)
    probs = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    found = rows.agg(*[F.collect_set(c) if few[c] <= BINS else F.percentile_approx(c, probs, 100 * BINS) for c in names]).first()
    values = [np.unique(np.array(v or [], float)) for v in found]
    return [(v[1:] + v[:-1]) / 2 if few[c] <= BINS else v for c, v in zip(names, values)]


def _drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, by a hash of the row's number: Poisson of mean 1; two trees share a hash."""
    x = rows.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree // 2 + 1) * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = (x >> np.uint64(32 * (tree % 2))).astype(np.uint32)
    drawn = np.zeros(len(rows), np.uint8)
    for c in CUTS:
        drawn += bits >= c
    return drawn


def blocks(
    prepared: DataFrame, features: list[str], part: Column, trees: int, seed: int, n: int, bootstrap: bool = True, label: str = "label"
) -> Blocks:
    """The ``n`` binned rows of ``prepared`` (its features, label and the column ``part``) or their cells, written once and dealt out evenly.

    Rows meet by bins and part, which AQE cuts where a task would get too many.
    """
    names = [f"f{i}" for i in range(len(features))]
    rows = prepared.select(
        *[ref(c).cast("double").alias(f) for f, c in zip(names, features)], ref(label).cast("double").alias("label"), part.cast("int").alias("part")
    )
    edges = bin_edges(rows, len(features))
    mean = rows.agg(F.avg("label")).first()[0]
    words = [f"w{i}" for i in range(-(-len(features) // 8))]  # eight bins each

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *x, label, at, row = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not all(np.isfinite(v.astype(float)).all() for v in x) or np.isnan(label.astype(float)).any():
                raise ValueError("a row to train on lacks a feature or its label")
            bins = np.zeros((len(row), 8 * len(words)), np.uint8)
            for f, (e, v) in enumerate(zip(edges, x)):
                bins[:, f] = np.searchsorted(e, v)
            packed = np.ascontiguousarray(bins.view(np.int64).T)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*packed, at.astype(np.int32), label - mean, row)], [*words, "part", "label", "row"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if not held or (batch is not None and size < CELL_ROWS):
                continue
            *packed, at, label, row = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(words) + 3))
            held, size = [], 0
            order = np.lexsort((at, *packed))
            at, label, row, packed = at[order], label[order], row[order], np.stack(packed)[:, order]
            bins = np.ascontiguousarray(packed.T).view(np.uint8).T[: len(edges)]
            new = np.flatnonzero(np.r_[True, (packed[:, 1:] != packed[:, :-1]).any(0) | (at[1:] != at[:-1])])
            cells = len(new) * CELL_SHARE <= len(at)
            starts = new if cells else np.arange(len(at))
            step = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (12 * trees if cells else trees)))
            for first in range(0, len(starts), step):
                own = starts[first : first + step]
                end = starts[first + step] if first + step < len(starts) else len(at)
                y, numbers, inner = label[own[0] : end], row[own[0] : end], own - own[0]
                draws, sums = np.empty((trees, len(own)), np.uint32 if cells else np.uint8), np.empty((trees if cells else 0, len(own)))
                for t in range(trees):
                    w = _drawn(numbers, t, seed) if bootstrap else np.ones(len(y), np.uint8)
                    if cells:
                        draws[t] = np.add.reduceat(w, inner, dtype=np.int64)
                        sums[t] = np.add.reduceat(w * y, inner)
                    else:
                        draws[t] = w
                if cells:
                    y = np.stack([np.diff(np.r_[inner, len(y)]).astype(float), np.add.reduceat(y, inner), np.add.reduceat(y * y, inner)])
                arrays = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (bins[:, own], at[own], y, draws)]
                arrays.append(pa.array([sums.tobytes() if cells else None], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, COLUMNS)

    schema = "".join(f"{w} bigint, " for w in words) + "part int, label double, row bigint"
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(binned, schema)
    tasks = max(int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // CELL_ROWS))
    held = dealt.hint("rebalance", tasks, *map(F.col, words), F.col("part")).mapInArrow(put, BLOCKS)
    held = settle(held.hint("rebalance"))
    return Blocks(held, held.rdd.getNumPartitions(), len(features), trees, mean, edges, seed)


def _unpacked(batch: pa.RecordBatch, features: int, trees: int) -> Iterator[tuple]:
    """Bins, parts, labels, draws and, of cells, drawn labels of every block; labels of cells are rows, sums and squares."""
    of = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
    for bins, part, label, draws, sums in zip(*(batch[c] for c in COLUMNS)):
        part, cells = of(part, np.int32), sums.is_valid
        yield (
            of(bins, np.uint8).reshape(features, -1), part, of(label, float).reshape(-1, len(part)),
            of(draws, np.uint32 if cells else np.uint8).reshape(trees, -1), of(sums, float).reshape(trees, -1) if cells else None,
        )


def _total(held: Blocks, add, size: int) -> np.ndarray:
    """The sum over all tasks of the arrays that ``add`` makes of a task's blocks: one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for block in (b for batch in batches for b in _unpacked(batch, held_features, held_trees)):
            add(total, *block)
            any_row = True
        if any_row:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in group["total"])
        return pd.DataFrame({"task": group["task"].min(), "total": [total.tobytes()]})

    held_features, held_trees = held.features, held.trees  # tasks take no frame along
    found, span = held.rows.mapInArrow(run, TOTALS), 1
    while held.tasks > FAN_IN * span:
        span *= FAN_IN
        found = found.groupBy(F.expr(f"task div {span}")).applyInPandas(merge, TOTALS)
    return sum((np.frombuffer(r["total"]) for r in found.collect()), np.zeros(size))


def _passes(forests: list[Forest]) -> Iterator[list[tuple[int, int, list[int]]]]:
    """Open nodes as (forest, tree, nodes), as many at a time as one pass may add up."""
    some, size = [], 0
    for i, forest in enumerate(forests):
        each = 2 * BINS * len(forest.features)
        for t, tree in enumerate(forest.trees):
            step = max(1, SUMS // each)
            for nodes in (tree.open[j : j + step] for j in range(0, len(tree.open), step)):
                if some and size + each * len(nodes) > SUMS:
                    yield some
                    some, size = [], 0
                some.append((i, t, nodes))
                size += each * len(nodes)
    if some:
        yield some


def _node_sums(held: Blocks, forests: list[Forest], units: list[tuple[int, int, list[int]]]) -> list[np.ndarray]:
    """Per unit drawn labels and draws by (node, feature, bin)."""
    shapes = [(2, len(nodes), len(forests[i].features), BINS) for i, _, nodes in units]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    # tasks take along the trees of this pass only
    by_forest = [
        (forests[i].trained, forests[i].features, [(u, units[u][1], units[u][2], _short(forests[i].trees[units[u][1]])) for u in us])
        for i, us in groupby(range(len(units)), lambda u: units[u][0])
    ]
    cut = lambda total: [total[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, shapes)]

    def add(total: np.ndarray, bins: np.ndarray, part: np.ndarray, label: np.ndarray, draws: np.ndarray, sums: np.ndarray | None) -> None:
        found = cut(total)
        for trained, features, own in by_forest:
            rows = np.flatnonzero(trained[part])
            x = bins[:, rows]
            for u, t, nodes, tree in own:
                w, cells = draws[t, rows].astype(float), len(nodes) * BINS
                wy, seen, at = w * label[0, rows] if sums is None else sums[t, rows], x, np.zeros(1, np.int64)
                if len(tree.feature) > 1:
                    slot = np.full(len(tree.feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[tree.walk(x)]
                    used = np.flatnonzero(at >= 0)
                    if 2 * len(used) < len(at):
                        w, wy, seen, at = w[used], wy[used], x[:, used], at[used]
                    at = np.where(at < 0, len(nodes), at) * BINS  # one slot more, for rows of no open node
                for c, f in enumerate(features):
                    cell = at + seen[f]
                    for d, v in enumerate((wy, w)):
                        found[u][d, :, c] += np.bincount(cell, v, cells)[:cells].reshape(-1, BINS)

    return cut(_total(held, add, int(ends[-1])))


def _short(tree: Tree) -> Tree:
    """What ``walk`` needs of a tree."""
    return Tree(*(np.array(v, np.int32) for v in (tree.feature, tree.bin, tree.left, tree.right)), [], [])


def _best_splits(g: np.ndarray, h: np.ndarray, min_leaf: int) -> tuple:
    """Gain, feature, last bin on the left, left and right sums of nodes x features x bins; the first of equal gains."""
    all_g, all_h = g[:, :1].sum(2, keepdims=True), h[:, :1].sum(2, keepdims=True)
    left_g, left_h = g.cumsum(2)[..., :-1], h.cumsum(2)[..., :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):  # a side without rows is no split
        gain = left_g**2 / left_h + right_g**2 / right_h - all_g**2 / all_h
    gain[(left_h < min_leaf) | (right_h < min_leaf)] = -1.0
    at = (np.arange(len(g)), *np.unravel_index(gain.reshape(len(g), -1).argmax(1), gain.shape[1:]))
    return gain[at], at[1], at[2], np.stack([left_g[at], left_h[at]], 1), np.stack([right_g[at], right_h[at]], 1)


def grow(held: Blocks, forests: list[Forest], max_depth: int, min_leaf: int = 1) -> None:
    """Grow the trees of all forests, level by level."""
    for forest in forests:
        forest.trees = [Tree() for _ in range(held.trees)]
        forest.gains = [np.zeros(len(forest.features)) for _ in range(held.trees)]
    for depth in range(max(max_depth, 1)):  # the roots' sums are needed in any case
        grown: dict[tuple[int, int], list[int]] = {(i, t): [] for i in range(len(forests)) for t in range(held.trees)}
        for units in _passes(forests):
            for (i, t, nodes), (g, h) in zip(units, _node_sums(held, forests, units)):
                forest, tree = forests[i], forests[i].trees[t]
                if depth == 0:
                    tree.sums[0] = (g[0, 0].sum(), h[0, 0].sum())
                    if not tree.sums[0][1]:
                        raise ValueError("a tree has no rows to train on")
                if not max_depth:
                    continue
                among = np.tile(np.arange(len(forest.features)), (len(nodes), 1))
                if 0 < forest.tried < len(forest.features):
                    rng = np.random.default_rng([held.seed, i, t, depth, nodes[0]])
                    among = np.sort(rng.permuted(among, axis=1)[:, : forest.tried], axis=1)
                at = np.arange(len(nodes))[:, None]
                gains, fs, lasts, lefts, rights = _best_splits(g[at, among], h[at, among], max(min_leaf, 1))
                least = NOISE * (lefts[:, 0] ** 2 / np.maximum(lefts[:, 1], 1) + rights[:, 0] ** 2 / np.maximum(rights[:, 1], 1))
                for k in np.flatnonzero((gains > 0) & (gains > least)):
                    f = among[k, fs[k]]
                    forest.gains[t][f] += gains[k]
                    grown[i, t] += tree.split(nodes[k], forest.features[f], int(lasts[k]), tuple(lefts[k]), tuple(rights[k]))
        for (i, t), nodes in grown.items():
            forests[i].trees[t].open = nodes


def r2(held: Blocks, forests: list[Forest]) -> list[float | None]:
    """Of every forest on the parts it is scored on, 6 digits; None where the labels are all equal: one pass per NODES nodes."""
    groups, size = [[]], 0
    for forest in forests:
        more = sum(len(t.feature) for t in forest.trees)
        if groups[-1] and size + more > NODES:
            groups.append([])
            size = 0
        groups[-1].append(forest)
        size += more
    return [v for group in groups for v in _r2(held, group)]


def _r2(held: Blocks, forests: list[Forest]) -> list[float | None]:
    given = [(f.scored, [(_short(t), np.array([g / h for g, h in t.sums])) for t in f.trees]) for f in forests]

    def add(total: np.ndarray, bins: np.ndarray, part: np.ndarray, label: np.ndarray, draws: np.ndarray, sums: np.ndarray | None) -> None:
        found = total.reshape(-1, 4)
        for i, (scored, trees) in enumerate(given):
            rows = np.flatnonzero(scored[part])
            x, y = bins[:, rows], label[:, rows]
            p = sum(v[t.walk(x)] for t, v in trees) / len(trees)
            if sums is None:
                found[i] += len(rows), y[0].sum(), (y[0] ** 2).sum(), ((y[0] - p) ** 2).sum()
            else:
                n, s, q = y
                found[i] += n.sum(), s.sum(), q.sum(), (q - 2 * p * s + n * p * p).sum()

    found = _total(held, add, 4 * len(forests)).reshape(-1, 4)
    squares = [(s - t * t / n if n else 0.0, s, e) for n, t, s, e in found]
    return [round(float(1 - e / v), 6) if v > NOISE * s else None for v, s, e in squares]


@dataclass
class GrownForest:
    """A grown forest as a model: adds ``prediction`` and ``probability``, an array of two for classes 0 and 1, else NULL."""

    edges: list[np.ndarray]
    trees: list[Tree]  # as ``walk`` needs them
    values: list[np.ndarray]  # of every node: the mean label
    binary: bool
    importances: np.ndarray

    @staticmethod
    def of(held: Blocks, forest: Forest, binary: bool) -> GrownForest:
        values = [np.array([g / h + held.mean for g, h in t.sums]) for t in forest.trees]
        return GrownForest(held.edges, [_short(t) for t in forest.trees], values, binary, forest.importances())

    @property
    def featureImportances(self):
        return Vectors.dense(self.importances)

    def means(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean by row."""
        bins = np.stack([np.searchsorted(e, v).astype(np.uint8) for e, v in zip(self.edges, x.T)])
        return sum(v[t.walk(bins)] for t, v in zip(self.trees, self.values)) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.arrow_udf("double")
        def mean(x: pa.Array) -> pa.Array:
            return pa.array(model.means(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else np.zeros(0))

        out = df.select("*", mean(vector_to_array("features")).alias("prediction"))
        if not self.binary:
            return out.withColumn("probability", F.lit(None).cast("array<double>"))
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return out.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (F.col("prediction") > 0.5).cast("double"))

    def save(self, path: str, spark: SparkSession) -> None:
        nodes = pd.concat(
            pd.DataFrame({"tree": i, "node": np.arange(len(v)), "feature": t.feature, "bin": t.bin, "left": t.left, "right": t.right, "value": v})
            for i, (t, v) in enumerate(zip(self.trees, self.values))
        )
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        whole = [([e.tolist() for e in self.edges], self.binary, self.importances.tolist())]
        schema = "edges array<array<double>>, binary boolean, importances array<double>"
        spark.createDataFrame(whole, schema).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def saved(path: str, spark: SparkSession) -> bool:
        return "edges" in spark.read.parquet(f"{path}/model").columns

    @staticmethod
    def load(path: str, spark: SparkSession) -> GrownForest:
        m = spark.read.parquet(f"{path}/model").first()
        of = [g for _, g in spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"]).groupby("tree")]
        trees = [Tree(*(g[c].to_numpy(np.int32) for c in ("feature", "bin", "left", "right")), [], []) for g in of]
        values = [g["value"].to_numpy(float) for g in of]
        return GrownForest([np.array(e) for e in m["edges"]], trees, values, m["binary"], np.array(m["importances"]))
