"""Partial dependence, prediction intervals, learning curves, elimination, tuning, reduction."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import chain, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import dtype_of, ref
from tabulens.functions.hashing import row_order, slot
from tabulens.operators import flat_trees, forests
from tabulens.operators.models import (
    BOOST,
    BOOST_NAMES,
    CLASSIFICATION,
    DEFAULTS,
    FOREST,
    LASSO,
    LOGISTIC,
    REGRESSION,
    RIDGE,
    Fitted,
    assembled,
    cross_validate,
    fit_model,
    mean_std,
    primary,
    spread_rows,
)
from tabulens.operators.profile import few_distinct
from tabulens.operators.ranks import order_statistics
from tabulens.operators.splits import FOLDS, SEED, kfold_assign, stratified_kfold_assign

# Grids and limits of the model reports.
GRID_POINTS = 50
GRID_RANGE = (0.05, 0.95)
GRID_VALUES = 4_000_000  # values whose rows are compared before trees are walked for a grid: 32 MB
FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)
MIN_ROWS = 10
ELIMINATION_TREES = 50
FIT_ROWS = forests.FIT_ROWS
SEARCH_DRAWS = 20
SEARCH_FOLDS = 3
SEARCH_SHOWN = 10
UNLIMITED_DEPTH = 30  # "no depth limit": the deepest that Spark grows a tree
GRIDS = {
    FOREST: {"trees": [50, 100, 200], "max_depth": [None, 5, 10, 20], "min_leaf": [1, 2, 4]},
    RIDGE: {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    LASSO: {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
    LOGISTIC: {"C": [0.01, 0.1, 1.0, 10.0, 100.0]},
    BOOST: {
        "rounds": [100, 300],
        "step": [0.01, 0.05, 0.1],
        "max_depth": [3, 6, 9],
        "subsample": [0.7, 0.9, 1.0],
    },
}


def _grid(prepared: DataFrame, feature: str, points: int) -> list[float]:
    """All values when there are few, else an even grid between the 5 and 95 percent points.

    The end points use plotting positions with both shape parameters at 0.4.
    """
    x = prepared.select(ref(feature).cast("double").alias("x")).persist()  # read four times
    try:
        if few_distinct(x, ["x"], points)["x"] < points:
            return [r["x"] for r in x.distinct().orderBy("x").collect()]  # fewer than ``points`` values
        n = x.count()
        spots = []
        for p in GRID_RANGE:
            at = n * p + 0.4 + 0.2 * p
            k = int(min(max(math.floor(at), 1), n - 1))
            spots.append((k, min(max(at - k, 0.0), 1.0)))
        ranks = sorted({i for k, _ in spots for i in (k - 1, k)})
        found = order_statistics(x, {"x": ranks}, {"x": n})["x"]
    finally:
        x.unpersist()
    lo, hi = (found[k - 1] * (1 - g) + found[k] * g for k, g in spots)
    return [float(v) for v in np.linspace(lo, hi, points)]


def partial_dependence(
    fitted: Fitted, prepared: DataFrame, features: list[str], feature: str, points: int = GRID_POINTS
) -> DataFrame:
    """(feature, value, average): mean prediction with the feature set to each grid value.

    Binary classifiers average the probability of the second class. Regression trees are walked
    once for the whole grid; for other models the grid is a literal array, so every row is
    scored once per grid point and only sums are shuffled.
    """
    if feature not in features:
        raise ValueError(f"feature '{feature}' was not used in training")
    grid = _grid(prepared, feature, points)
    model = fitted.parts.get("m")
    if fitted.problem_type != CLASSIFICATION and hasattr(model, "trees") and grid:
        return _tree_dependence(model, prepared, features, feature, grid)
    wide = prepared.select(
        *[ref(c) for c in features if c != feature],
        F.posexplode(F.array(*map(F.lit, grid))).alias("_at", feature),
    )
    scored = fitted.score(assembled(wide, features, ["_at", feature]))
    if fitted.problem_type == CLASSIFICATION and fitted.classes == 2:
        out = F.coalesce(F.element_at("probs", 2), F.col("prediction"))
    else:
        out = F.col("prediction")
    return scored.groupBy("_at", ref(feature).alias("value")).agg(F.avg(out).alias("average")).select(
        F.lit(feature).alias("feature"),
        F.round("value", 6).alias("value"),
        F.round("average", 6).alias("average"),
    )


def _tree_dependence(model, prepared: DataFrame, features: list[str], feature: str, grid: list[float]) -> DataFrame:
    """``partial_dependence`` of a forest or boosted regression, exact for all grid values in one walk.

    Rows that no split on the other features tells apart are walked once.
    """
    trees, at, points = flat_trees.of_spark(model, prepared.sparkSession), features.index(feature), np.array(grid, float)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, held, size = np.zeros(len(points)), 0, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                size += held[-1].size
            if held and (batch is None or size >= GRID_VALUES):
                x, counts = trees.alike(np.concatenate(held), at)
                sums += trees.grid_sums(x, at, points, counts)
                n += int(counts.sum())
                held, size = [], 0
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(points)), "sum": sums, "n": np.full(len(points), n)})

    rows = prepared.select(*[ref(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    sums = rows.mapInArrow(walk, "at bigint, sum double, n bigint").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    value = F.get(F.array(*map(F.lit, grid)), F.col("at"))
    return sums.select(
        F.lit(feature).alias("feature"),
        F.round(value, 6).alias("value"),
        F.round(F.try_divide("sum", "n"), 6).alias("average"),
    )


def prediction_interval(
    fitted: Fitted, frame: DataFrame, lo: float = 0.025, hi: float = 0.975
) -> DataFrame:
    """Percentiles over the trees' predictions of a regression forest, per row: all trees in one step."""
    forest = fitted.parts.get("m")
    if forest is None or not hasattr(forest, "trees") or fitted.problem_type == CLASSIFICATION:
        raise ValueError("prediction intervals need a regression forest")
    trees = flat_trees.of_spark(forest, frame.sparkSession)

    @F.pandas_udf("struct<prediction: double, lower_95: double, upper_95: double>")
    def interval(x: pd.Series) -> pd.DataFrame:
        names = ["prediction", "lower_95", "upper_95"]
        if not len(x):
            return pd.DataFrame(columns=names, dtype=float)
        each = trees.each(np.stack(x.to_list()).astype(float))
        return pd.DataFrame(np.column_stack([each.mean(1), *np.quantile(each, [lo, hi], axis=1)]), columns=names)

    kept = [c for c in frame.columns if c not in ("prediction", "lower_95", "upper_95")]
    out = frame.select(*[ref(c) for c in kept], interval(vector_to_array("features")).alias("_interval"))
    return out.select(
        *[ref(c) for c in kept],
        *[F.round(F.col("_interval")[c], 6).alias(c) for c in ("prediction", "lower_95", "upper_95")],
    )


def learning_curve(
    prepared: DataFrame,
    features: list[str],
    key: str,
    problem_type: str,
    name: str = FOREST,
    params: dict | None = None,
    fractions=FRACTIONS,
    folds: int = FOLDS,
) -> DataFrame:
    """(train_size, train_score, val_score, val_std) on growing, nested, hash-ordered parts.

    Regression forests of more than FIT_ROWS rows grow side by side.
    """
    schema = "train_size bigint, train_score double, val_score double, val_std double"
    if name == FOREST and problem_type == REGRESSION and (n := prepared.count()) > FIT_ROWS:
        rows = _forest_curve(prepared, features, key, {**DEFAULTS[FOREST], **(params or {})}, fractions, folds, n)
        return prepared.sparkSession.createDataFrame(rows, schema)
    frame = spread_rows(assembled(prepared, features, [key, "label"]), key)
    order = row_order(frame, key, SEED)
    frame = kfold_assign(frame.withColumn("_h", order.cast("double")), key, folds, SEED + 2)
    frame = kfold_assign(frame, key, folds, SEED + 3, "inner").persist()
    n = frame.count()
    classes = _classes(frame, problem_type)
    sizes = _sizes(n, fractions)
    cuts = order_statistics(frame.select("_h"), {"_h": [s - 1 for s in sizes]}, {"_h": n})["_h"]
    rows = []
    for size in sizes:
        part = frame.where(F.col("_h") <= F.lit(cuts[size - 1]))
        mean, std = mean_std(cross_validate(part, name, problem_type, classes, folds, params, key))
        whole = primary(fit_model(name, part, problem_type, classes, params, "inner").score(part), problem_type)
        rows.append((size, whole, mean, std))
    frame.unpersist()
    return prepared.sparkSession.createDataFrame(rows, schema)


def _sizes(n: int, fractions) -> list[int]:
    return sorted({min(n, max(MIN_ROWS, int(n * f))) for f in fractions})


def _forest_curve(prepared: DataFrame, features: list[str], key: str, params: dict, fractions, folds: int, n: int) -> list[tuple]:
    """``learning_curve`` of regression forests: those of all sizes and folds grow side by side.

    A row's part is its fold and the smallest size that holds it.
    """
    order, sizes = row_order(prepared, key, SEED).cast("double"), _sizes(n, fractions)
    cuts = order_statistics(prepared.select(order.alias("_h")), {"_h": [s - 1 for s in sizes]}, {"_h": n})["_h"]
    at = sum((order > F.lit(cuts[s - 1])).cast("int") for s in sizes[:-1]) if len(sizes) > 1 else F.lit(0)
    held = forests.blocks(
        prepared, features, at * folds + slot(prepared, key, folds, SEED + 2), params["trees"], params["seed"], n
    )
    size, fold = np.divmod(np.arange(len(sizes) * folds), folds)
    every = list(range(len(features)))
    grown = []
    for i in range(len(sizes)):
        grown += [forests.Forest(every, (size <= i) & (fold != f), (size <= i) & (fold == f)) for f in range(folds)]
        grown.append(forests.Forest(every, size <= i, size <= i))
    forests.grow(held, grown, params["max_depth"], params["min_leaf"])
    scores = forests.r2(held, grown)
    rows = []
    for i, s in enumerate(sizes):
        *of_folds, whole = scores[i * (folds + 1) : (i + 1) * (folds + 1)]
        rows.append((s, whole, *mean_std([v for v in of_folds if v is not None])))
    return rows


def _classes(frame: DataFrame, problem_type: str) -> int:
    if problem_type != CLASSIFICATION:
        return 0
    return int(frame.agg(F.max("label").alias("m")).first()["m"]) + 1


def _slice(frame: DataFrame, kept: list[int]) -> DataFrame:
    sliced = VectorSlicer(inputCol="features", outputCol="_kept", indices=sorted(kept)).transform(frame)
    return sliced.drop("features").withColumnRenamed("_kept", "features")


def _eliminate(k: int, stop: int, step: int, fit, runs: int = 1) -> list[tuple[dict[int, float | None], list[int]]]:
    """Drop the least important features down to ``stop``: scores per size and rank per feature, of every run.

    ``fit`` takes the features kept in every run, as many in each, and gives each run's importances and score.
    """
    kept = [list(range(k)) for _ in range(runs)]
    dropped: list[list[list[int]]] = []
    scores: list[dict[int, float | None]] = [{} for _ in range(runs)]
    while True:
        size, groups = len(kept[0]), []
        for r, (weights, score) in enumerate(fit(kept)):
            scores[r][size] = score
            order = sorted(range(size), key=lambda i: (weights[i], i))
            groups.append([kept[r][i] for i in order[: max(min(step, size - stop), 0)]])
        if size <= stop:
            break
        dropped.append(groups)
        kept = [[i for i in own if i not in out] for own, out in zip(kept, groups)]
    found = []
    for r in range(runs):
        ranks = [1] * k
        for back, groups in enumerate(reversed(dropped)):
            for i in groups[r]:
                ranks[i] = back + 2
        found.append((scores[r], ranks))
    return found


@contextmanager
def _spark_fits(prepared: DataFrame, features: list[str], key: str, problem_type: str, folds: int, params: dict, n: int):
    """Importances and score of Spark's forests without each of some folds, on the features kept for it; None: all rows, no score."""
    spark = prepared.sparkSession
    frame = spread_rows(assembled(prepared, features, [key, "label"]), key)
    if problem_type == CLASSIFICATION:
        frame = stratified_kfold_assign(frame, "label", key, folds)
    else:
        frame = kfold_assign(frame, key, folds)
    frame = frame.persist()
    classes = _classes(frame, problem_type)

    def one(f: int | None, kept: list[int]):
        train = frame if f is None else frame.where(F.col("fold") != f)
        fitted = fit_model(FOREST, _slice(train, kept), problem_type, classes, params)
        weights = fitted.parts["m"].featureImportances.toArray()
        if f is None:
            return weights, None
        return weights, primary(fitted.score(_slice(frame.where(F.col("fold") == f), kept)), problem_type)

    with ThreadPoolExecutor(max_workers=4) as pool:

        def fit(of, kept):
            jobs = [pool.submit(inheritable_thread_target(spark)(one), f, own) for f, own in zip(of, kept)]
            return [j.result() for j in jobs]

        yield fit
    frame.unpersist()


@contextmanager
def _forest_fits(prepared: DataFrame, features: list[str], key: str, problem_type: str, folds: int, params: dict, n: int):
    """Like ``_spark_fits`` for regression; the forests of all asked folds grow side by side."""
    params = {**DEFAULTS[FOREST], **params}
    held = forests.blocks(prepared, features, slot(prepared, key, folds, SEED), params["trees"], params["seed"], n)
    fold = np.arange(folds)

    def fit(of, kept):
        grown = [forests.Forest(own, fold >= 0 if f is None else fold != f, fold == (-1 if f is None else f)) for f, own in zip(of, kept)]
        forests.grow(held, grown, params["max_depth"], params["min_leaf"])
        scores = forests.r2(held, grown) if any(g.scored.any() for g in grown) else [None] * len(grown)
        return [(g.importances(), score) for g, score in zip(grown, scores)]

    yield fit


def rfecv(
    prepared: DataFrame,
    features: list[str],
    key: str,
    problem_type: str,
    folds: int = FOLDS,
    step: int = 1,
    trees: int = ELIMINATION_TREES,
    max_depth: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Recursive elimination scored on folds: (feature, rank, selected) and (n_features, cv_score).

    Regression forests of more than FIT_ROWS rows grow side by side, those of all folds at a time.
    """
    spark, k = prepared.sparkSession, len(features)
    params = {"trees": trees, "max_depth": max_depth}
    n = prepared.count() if problem_type == REGRESSION else 0
    fits = _forest_fits if n > FIT_ROWS else _spark_fits
    with fits(prepared, features, key, problem_type, folds, params, n) as fit:
        per_fold = [scores for scores, _ in _eliminate(k, 1, step, lambda kept: fit(range(folds), kept), folds)]
        sizes = sorted(per_fold[0])
        curve = [(s, round(sum((p[s] or 0.0) for p in per_fold) / folds, 6)) for s in sizes]
        best = max(curve, key=lambda c: (c[1], -c[0]))[0]
        [(_, ranks)] = _eliminate(k, best, step, lambda kept: fit([None], kept))
    ranking = spark.createDataFrame(
        [(f, r, r == 1) for f, r in zip(features, ranks)], "feature string, rank int, selected boolean"
    )
    return ranking.orderBy("rank", "feature"), spark.createDataFrame(curve, "n_features int, cv_score double")


def tune_random_search(
    prepared: DataFrame,
    features: list[str],
    key: str,
    problem_type: str,
    name: str,
    grid: dict[str, list] | None = None,
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    seed: int = 42,
) -> DataFrame:
    """(rank, params, score, std): seeded draws from the model's grid, the best ten by fold mean."""
    name = BOOST if name in BOOST_NAMES else name
    grid = grid or GRIDS.get(name)
    if not grid:
        raise ValueError(f"no parameter grid for '{name}'")
    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    spark = prepared.sparkSession
    drawn = every if len(every) <= draws else random.Random(seed).sample(every, draws)
    drawn = [{k: UNLIMITED_DEPTH if k == "max_depth" and v is None else v for k, v in p.items()} for p in drawn]
    frame = spread_rows(assembled(prepared, features, [key, "label"]), key)
    frame = kfold_assign(frame, key, folds).persist()
    classes = _classes(frame, problem_type)

    def one(params: dict):
        return mean_std(cross_validate(frame, name, problem_type, classes, folds, params, key))

    with ThreadPoolExecutor(max_workers=4) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), p) for p in drawn]
        results = [j.result() for j in jobs]
    frame.unpersist()
    ordered = sorted(zip(drawn, results), key=lambda r: -(r[1][0] if r[1][0] is not None else -math.inf))
    rows = [
        (i + 1, {k: str(v) for k, v in params.items()}, score, std)
        for i, (params, (score, std)) in enumerate(ordered[:SEARCH_SHOWN])
    ]
    return prepared.sparkSession.createDataFrame(
        rows, "rank int, params map<string,string>, score double, std double"
    )


# --- reduction --------------------------------------------------------------------------------------


def _pca(df: DataFrame, cols: list[str], keep: list[str], k: int):
    """Standardised principal components; ``cols`` may be one column holding a numeric array."""
    if len(cols) == 1 and isinstance(dtype_of(df, cols[0]), T.ArrayType):
        rows = df.select(*[ref(c) for c in keep], array_to_vector(ref(cols[0]).cast("array<double>")).alias("features"))
    else:
        names = [f"_f{i}" for i in range(len(cols))]
        rows = VectorAssembler(inputCols=names, outputCol="features").transform(
            df.select(*[ref(c) for c in keep], *[ref(c).cast("double").alias(n) for c, n in zip(cols, names)])
        )
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
    scaled = scaler.transform(rows)
    model = PCA(k=k, inputCol="scaled", outputCol="components").fit(scaled)
    return scaled, model


def reduce_pca(df: DataFrame, cols: list[str], target: str, k: int = 2) -> DataFrame:
    """(x, y, target): the first two components of the standardised columns.

    Columns are scaled by their population deviation. Each component is turned so that its
    largest loading (the first of equals) is positive.
    """
    if k != 2:
        raise ValueError("only 2 components are supported")
    scaled, model = _pca(df, cols, [target], k)
    loadings = model.pc.toArray()
    signs = []
    for j in range(k):
        size = np.abs(loadings[:, j])
        first = int(np.argmax(size >= size.max() - 1e-9))
        signs.append(1.0 if loadings[first, j] >= 0 else -1.0)
    n = df.count()
    widen = math.sqrt(n / (n - 1.0)) if n > 1 else 1.0
    c = vector_to_array("components")
    return model.transform(scaled).select(
        F.round(c[0] * F.lit(signs[0] * widen), 4).alias("x"),
        F.round(c[1] * F.lit(signs[1] * widen), 4).alias("y"),
        ref(target).cast("double").alias("target"),
    )


def explained_variance(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """(component, explained_variance) as shares of the total variance."""
    _, model = _pca(df, cols, [], k)
    shares = [(i + 1, round(float(v), 6)) for i, v in enumerate(model.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(shares, "component int, explained_variance double")
