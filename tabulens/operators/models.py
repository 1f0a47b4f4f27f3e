"""The model registry: Spark ML learners, voting and stacking over assembled features."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import ref, union_all
from tabulens.operators import forests
from tabulens.operators.boosting import SoftmaxBoost, SoftmaxModel
from tabulens.operators.metrics import (
    bootstrap_ci,
    metrics_classification,
    metrics_regression,
    roc_auc,
    views,
)
from tabulens.operators.splits import FOLDS, SEED, TEST_SIZE, cv_assign, kfold_assign, split_flag
from tabulens.session import settle

REGRESSION = "regression"
CLASSIFICATION = "classification"
# Model names and their default parameters.
LINEAR, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "LASSO"
LOGISTIC, FOREST, BOOST = "Logistic Regression", "Random Forest", "Gradient Boosting"
VOTING, STACKING = "Voting Ensemble", "Stacking"
REGISTRY = {
    REGRESSION: [LINEAR, RIDGE, LASSO, FOREST, BOOST, VOTING, STACKING],
    CLASSIFICATION: [LOGISTIC, FOREST, BOOST, VOTING, STACKING],
}
BOOST_NAMES = ("XGBoost", "LightGBM", "CatBoost")  # all served by the one boosted-tree learner
DEFAULTS = {
    RIDGE: {"alpha": 1.0},
    LASSO: {"alpha": 1.0, "max_iter": 10000},
    LOGISTIC: {"C": 1.0, "max_iter": 1000},
    FOREST: {"trees": 100, "max_depth": 10, "min_leaf": 1, "seed": 42},
    BOOST: {"rounds": 300, "step": 0.05, "max_depth": 6, "subsample": 1.0, "seed": 42},
}
THREADS = 4
FIT_ROWS = forests.FIT_ROWS
WHOLE = "whole"  # no fold is left out
OWN = (SoftmaxModel, forests.GrownForest)  # models that are not Spark's


def available_models(problem_type: str) -> list[str]:
    return list(REGISTRY[problem_type])


def assembled(prepared: DataFrame, features: list[str], keep: list[str], label: str | None = None) -> DataFrame:
    """``features`` as one vector column (inputs renamed, since names may hold any character).

    ``label`` names the target column, which becomes ``label``.
    """
    inputs = [f"_f{i}" for i in range(len(features))]
    named = prepared.select(
        *[ref(k) for k in keep], *([ref(label).alias("label")] if label else []), *[ref(c).cast("double").alias(i) for c, i in zip(features, inputs)]
    )
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(named).drop(*inputs)


def spread_rows(df: DataFrame, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """Iterative learners need every core: deal rows to ``partitions``, by default the session's shuffle partitions.

    By the unique ``key``, which keeps samples drawn per partition apart from the input's layout
    and the number of cores; without a key evenly.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, ref(key)) if key else df.repartition(n)


@dataclass
class Fitted:
    """A fitted model and how to read its output: ``score`` adds ``prediction`` and ``probs``."""

    name: str
    problem_type: str
    parts: dict = field(default_factory=dict)  # tag -> Spark model
    classes: int = 0

    def score(self, df: DataFrame) -> DataFrame:
        """Keep every column of ``df`` and add prediction (double) and probs (array, classifiers)."""
        kept = df.columns
        out = df
        for tag in [t for t in self.parts if t != "final"]:
            out = _outputs(self.parts[tag], out, tag)
        if self.name == STACKING:
            inputs = _stack_inputs([t for t in self.parts if t != "final"], self.problem_type, self.classes)
            out = _outputs(self.parts["final"], _stacked(out, inputs), "final")
            pred, probs = F.col("p_final"), F.col("q_final")
        elif self.name == VOTING:
            tags = list(self.parts)
            pred, probs = self._vote(tags)
        else:
            pred, probs = F.col("p_m"), F.col("q_m")
        return out.select(*[ref(c) for c in kept], pred.alias("prediction"), probs.alias("probs"))

    def _vote(self, tags: list[str]) -> tuple[Column, Column]:
        if self.problem_type == REGRESSION:
            total = F.lit(0.0)
            for t in tags:
                total = total + F.col(f"p_{t}")
            return total / len(tags), F.lit(None).cast("array<double>")
        means = [
            sum((F.element_at(f"q_{t}", i + 1) for t in tags), F.lit(0.0)) / len(tags)
            for i in range(self.classes)
        ]
        probs = F.array(*means)
        best = F.array_position(probs, F.array_max(probs)) - 1
        return best.cast("double"), probs


def _outputs(model, df: DataFrame, tag: str) -> DataFrame:
    """Apply one Spark model under its own output columns p_<tag> and q_<tag>."""
    kept = df.columns
    out = model.transform(df)
    probs = F.lit(None).cast("array<double>")
    if isinstance(model, OWN):
        probs = F.col("probability")
    elif "probability" in out.columns:
        probs = vector_to_array("probability")
    return out.select(*[ref(c) for c in kept], F.col("prediction").alias(f"p_{tag}"), probs.alias(f"q_{tag}"))


def _stack_inputs(tags: list[str], problem_type: str, classes: int) -> list[Column]:
    if problem_type == REGRESSION:
        return [F.col(f"p_{t}") for t in tags]
    first = 1 if classes == 2 else 0  # two classes: the positive one says it all
    return [F.element_at(f"q_{t}", i + 1) for t in tags for i in range(first, classes)]


def _stacked(df: DataFrame, inputs: list[Column]) -> DataFrame:
    names = [f"_s{i}" for i in range(len(inputs))]
    out = df.drop("features").select("*", *[c.alias(n) for c, n in zip(inputs, names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(out).drop(*names)


def _learner(name: str, problem_type: str, train: DataFrame, classes: int, params: dict):
    p = {**DEFAULTS.get(name, {}), **params}
    if name == LINEAR:
        return LinearRegression(solver="normal")
    if name == RIDGE:
        # the solver scales the label, hence the penalty by its spread over the row count
        f = train.agg(F.stddev_pop("label").alias("s"), F.count("*").alias("n")).first()
        reg = p["alpha"] * (f["s"] or 0.0) / f["n"]
        return LinearRegression(solver="normal", regParam=reg, elasticNetParam=0.0, standardization=False)
    if name == LASSO:
        return LinearRegression(
            regParam=p["alpha"], elasticNetParam=1.0, standardization=False, maxIter=p["max_iter"], tol=1e-10
        )
    if name == LOGISTIC:
        n = train.count()
        return LogisticRegression(
            regParam=1.0 / (p["C"] * n), standardization=False, maxIter=p["max_iter"], tol=1e-6
        )
    if name == FOREST:
        kind = RandomForestRegressor if problem_type == REGRESSION else RandomForestClassifier
        return kind(
            numTrees=p["trees"],
            maxDepth=p["max_depth"],
            minInstancesPerNode=p["min_leaf"],
            seed=p["seed"],
            featureSubsetStrategy="all" if problem_type == REGRESSION else "sqrt",
        )
    if name == BOOST:
        common = dict(
            maxIter=p["rounds"],
            stepSize=p["step"],
            maxDepth=p["max_depth"],
            subsamplingRate=p["subsample"],
            seed=p["seed"],
        )
        if problem_type == REGRESSION:
            return GBTRegressor(**common)
        if classes > 2:
            return SoftmaxBoost(classes, **{k: p[k] for k in ("rounds", "step", "max_depth", "subsample", "seed")})
        return GBTClassifier(**common)
    raise ValueError(f"unknown model '{name}'")


def _base_names(name: str, problem_type: str) -> dict[str, str]:
    if problem_type == CLASSIFICATION:
        return {"lr": LOGISTIC, "rf": FOREST}
    if name == VOTING:
        return {"lr": LINEAR, "ridge": RIDGE, "rf": FOREST}
    return {"ridge": RIDGE, "rf": FOREST}


def fit_model(
    name: str,
    train: DataFrame,
    problem_type: str,
    classes: int = 0,
    params: dict | None = None,
    fold: str | None = None,
) -> Fitted:
    """Fit one registered model on columns ``features`` and ``label``.

    ``params`` hold the model's own parameters; for the ensembles, a dict per member name.
    Stacking needs a ``fold`` column for its out-of-fold inputs.
    """
    name = BOOST if name in BOOST_NAMES else name
    if name not in REGISTRY[problem_type]:
        raise ValueError(f"model '{name}' is not available for {problem_type}")
    params = params or {}
    own = lambda kind: params if kind == name else params.get(kind, {})
    fit = lambda kind, rows: _learner(kind, problem_type, rows, classes, own(kind)).fit(rows)
    if name not in (VOTING, STACKING):
        return Fitted(name, problem_type, {"m": fit(name, train)}, classes)
    bases = _base_names(name, problem_type)
    if name == VOTING:
        return Fitted(name, problem_type, {tag: fit(kind, train) for tag, kind in bases.items()}, classes)
    if fold is None:
        raise ValueError("stacking needs a fold column")
    folds = [r[fold] for r in train.select(fold).distinct().collect()]
    grown: dict = {}  # forests by the fold they do not see
    if (problem_type == REGRESSION or classes == 2) and (n := train.count()) > FIT_ROWS:
        grown = _grown_forests(train, fold, folds, problem_type, {**DEFAULTS[FOREST], **own(FOREST)}, n)
    made = lambda kind, f, rows: grown[f] if kind == FOREST and grown else fit(kind, rows)
    parts = {tag: made(kind, WHOLE, train) for tag, kind in bases.items()}
    oof = []
    for f in folds:
        rest = train.where(ref(fold) != f)
        out = train.where(ref(fold) == f)
        for tag, kind in bases.items():
            out = _outputs(made(kind, f, rest), out, tag)
        oof.append(_stacked(out, _stack_inputs(list(bases), problem_type, classes)).select("features", "label"))
    final_name = LINEAR if problem_type == REGRESSION else LOGISTIC
    stacked = union_all(oof).persist()
    parts["final"] = _learner(final_name, problem_type, stacked, classes, own(final_name)).fit(stacked)
    stacked.unpersist()
    return Fitted(name, problem_type, parts, classes)


def _grown_forests(train: DataFrame, fold: str, folds: list, problem_type: str, p: dict, n: int) -> dict:
    """Forests on all rows (WHOLE) and without each fold, grown side by side, see ``forests``."""
    k = train.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    x = vector_to_array("features")
    at = F.array_position(F.array(*map(F.lit, folds)), ref(fold)) - 1
    prepared = train.select(*[x[i].alias(f"x{i}") for i in range(k)], "label", F.coalesce(at, F.lit(len(folds))).alias("part"))
    tried = math.ceil(math.sqrt(k)) if problem_type == CLASSIFICATION else 0
    held = forests.blocks(prepared, [f"x{i}" for i in range(k)], F.col("part"), p["trees"], p["seed"], n)
    part, none = np.arange(len(folds) + 1), np.zeros(len(folds) + 1, bool)
    of = {WHOLE: part >= 0} | {f: (part != i) & (part < len(folds)) for i, f in enumerate(folds)}
    grown = {f: forests.Forest([*range(k)], trained, none, tried) for f, trained in of.items()}
    forests.grow(held, [*grown.values()], p["max_depth"], p["min_leaf"])
    return {f: forests.GrownForest.of(held, g, problem_type == CLASSIFICATION) for f, g in grown.items()}


def feature_importances(fitted: Fitted, features: list[str], spark) -> DataFrame | None:
    """(feature, importance): tree importances or mean absolute coefficients; None for ensembles."""
    model = fitted.parts.get("m")
    if model is None:
        return None
    if hasattr(model, "featureImportances"):
        w = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficientMatrix"):
        w = [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    elif hasattr(model, "coefficients"):
        w = [abs(float(v)) for v in model.coefficients.toArray()]
    else:
        return None
    rows = spark.createDataFrame([(f, round(v, 6)) for f, v in zip(features, w)], "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def primary(scored: DataFrame, problem_type: str) -> float | None:
    """r2, or the weighted F1."""
    if problem_type == REGRESSION:
        return metrics_regression(scored, "label", "prediction").first()["r2"]
    return metrics_classification(scored, "label", "prediction").first()["f1"]


def cross_validate(
    frame: DataFrame,
    name: str,
    problem_type: str,
    classes: int,
    folds: int,
    params: dict | None = None,
    key: str | None = None,
) -> list[float]:
    """The primary metric per fold of a frame with ``features``, ``label`` and ``fold``."""
    scores = []
    for f in range(folds):
        train, test = frame.where(F.col("fold") != f), frame.where(F.col("fold") == f)
        if name == STACKING:
            train = kfold_assign(train, key, FOLDS, SEED + 1, "inner")
        fitted = fit_model(name, train, problem_type, classes, params, "inner" if name == STACKING else None)
        score = primary(fitted.score(test), problem_type)
        if score is not None:
            scores.append(score)
    return scores


def mean_std(values: list[float]) -> tuple[float | None, float | None]:
    """Mean and population deviation, 6 digits."""
    if not values:
        return None, None
    m = sum(values) / len(values)
    return round(m, 6), round((sum((v - m) ** 2 for v in values) / len(values)) ** 0.5, 6)


@dataclass
class Trained:
    """Outcome of ``train_models``: per model the report, the scored test side and its views."""

    report: DataFrame
    best: Fitted
    models: dict[str, Fitted]
    n_train: int
    n_test: int
    scored: dict[str, DataFrame]  # key, label, prediction, probs of the test rows, written once
    views: dict[str, dict[str, DataFrame]]  # see ``metrics.views``
    importances: dict[str, DataFrame | None]


def train_models(
    prepared: DataFrame,
    features: list[str],
    key: str,
    problem_type: str,
    test_size: float = TEST_SIZE,
    models: list[str] | None = None,
    params: dict[str, dict] | None = None,
    cv: str = "train_test_split",
    folds: int = FOLDS,
    resamples: int = 500,
) -> Trained:
    """Train the chosen models on one split and compare them, the best by r2 or weighted F1 first.

    ``prepared`` holds the encoded features, ``label`` and a unique ``key``. The report has
    one row per model and metric with its bootstrap interval and cross-validation result.
    """
    spark = prepared.sparkSession
    names = [BOOST if m in BOOST_NAMES else m for m in (models or REGISTRY[problem_type])]
    names = [m for m in dict.fromkeys(names) if m in REGISTRY[problem_type]]
    if not names:
        raise ValueError(f"no valid models in {models}")
    params = params or {}
    marked = split_flag(assembled(prepared, features, [key, "label"]), key, test_size)
    marked = kfold_assign(spread_rows(marked, key), key, FOLDS, SEED + 1, "inner").persist()
    train, test = marked.where("not is_test"), marked.where("is_test")
    n_train, n_test = train.count(), test.count()
    classes = 0
    if problem_type == CLASSIFICATION:
        classes = int(marked.agg(F.max("label").alias("m")).first()["m"]) + 1
    full, n_folds = (None, 0)
    if cv != "train_test_split":
        full, n_folds = cv_assign(marked, key, cv, problem_type, folds)
        full = full.persist()

    def one(name: str):
        fitted = fit_model(name, train, problem_type, classes, params.get(name), "inner")
        scored = settle(fitted.score(test).select(key, "label", "prediction", "probs"))
        values = (
            metrics_regression(scored, "label", "prediction")
            if problem_type == REGRESSION
            else metrics_classification(scored, "label", "prediction")
        ).first().asDict()
        values.pop("n_samples")
        if problem_type == CLASSIFICATION:
            values["roc_auc"] = None
            if classes == 2 and not scored.where("probs is null").limit(1).count():
                auc = roc_auc(scored.withColumn("s", F.element_at("probs", 2)), "label", "s")
                values["roc_auc"] = auc.first()["roc_auc"]
        ci = {
            r["metric"]: (r["ci_lower"], r["ci_upper"])
            for r in bootstrap_ci(scored, "label", "prediction", key, problem_type, resamples).collect()
        }
        cv_mean = cv_std = None
        if full is not None:
            cv_mean, cv_std = mean_std(
                cross_validate(full, name, problem_type, classes, n_folds, params.get(name), key)
            )
        return name, fitted, values, ci, cv_mean, cv_std, scored

    with ThreadPoolExecutor(max_workers=min(THREADS, len(names))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), n) for n in names]
        done = [j.result() for j in jobs]
    marked.unpersist()
    if full is not None:
        full.unpersist()
    lead = "r2" if problem_type == REGRESSION else "f1"
    done.sort(key=lambda d: -(d[2][lead] or -1.0))
    rows = [
        (i + 1, name, metric, value, *ci.get(metric, (None, None)), cv_mean, cv_std)
        for i, (name, _, values, ci, cv_mean, cv_std, _) in enumerate(done)
        for metric, value in values.items()
    ]
    report = spark.createDataFrame(
        rows,
        "rank int, model_name string, metric string, value double, ci_lower double, ci_upper double,"
        " cv_mean double, cv_std double",
    )
    models_of = {d[0]: d[1] for d in done}
    scored_of = {d[0]: d[-1] for d in done}
    return Trained(
        report, done[0][1], models_of, n_train, n_test, scored_of,
        {n: views(s, problem_type == CLASSIFICATION, classes, key) for n, s in scored_of.items()},
        {n: feature_importances(f, features, spark) for n, f in models_of.items()},
    )


def save_fitted(fitted: Fitted, path: str, spark) -> None:
    """Write a model: one pipeline folder per part and a small description."""
    for tag, part in fitted.parts.items():
        if isinstance(part, OWN):
            part.save(f"{path}/parts/{tag}", spark)
        else:
            PipelineModel([part]).write().overwrite().save(f"{path}/parts/{tag}")
    own = [tag for tag, part in fitted.parts.items() if isinstance(part, OWN)]
    spark.createDataFrame(
        [(fitted.name, fitted.problem_type, fitted.classes, list(fitted.parts), own)],
        "name string, problem_type string, classes int, tags array<string>, own array<string>",
    ).write.mode("overwrite").parquet(f"{path}/model")


def load_fitted(path: str, spark) -> Fitted:
    d = spark.read.parquet(f"{path}/model").first()
    load = lambda t: (forests.GrownForest if forests.GrownForest.saved(t, spark) else SoftmaxModel).load(t, spark)
    parts = {
        t: load(f"{path}/parts/{t}") if t in d["own"] else PipelineModel.load(f"{path}/parts/{t}").stages[0]
        for t in d["tags"]
    }
    return Fitted(d["name"], d["problem_type"], parts, d["classes"])
