"""Scoring new data with a fitted model and its preprocessing, in batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import ref
from tabulens.operators.drift import drift_report, stored_report
from tabulens.operators.explain import prediction_interval
from tabulens.operators.meta import Meta, apply_meta, missing_features, target_fill
from tabulens.operators.metrics import (
    ROC_TRAIN_POINTS,
    metrics_classification,
    metrics_regression,
    roc_auc,
    views,
)
from tabulens.operators.models import CLASSIFICATION, FOREST, REGRESSION, Fitted, assembled
from tabulens.session import settle

TARGET = "_target"  # the encoded target while a feature may be named label


def score_frame(
    fitted: Fitted, meta: Meta, df: DataFrame, keep: list[str], with_target: bool = False, warn: bool = False,
    interval: bool = False,
) -> DataFrame:
    """``keep`` columns, prediction and probs of raw rows, and as asked label, warnings, lower_95 and upper_95."""
    fill = target_fill(df, meta) if with_target else None
    ready = apply_meta(df, meta, with_target, keep, TARGET, warn, fill)
    kept = [f"_keep_{k}" for k in keep] + (["_warnings"] if warn else [])
    vectors = assembled(ready, meta.features, kept, TARGET if with_target else None)
    scored = fitted.score(vectors)
    if interval:
        bounds = prediction_interval(fitted, scored.withColumnRenamed("prediction", "_mean"))
        scored = bounds.drop("prediction").withColumnRenamed("_mean", "prediction")
    return scored.select(
        *[ref(f"_keep_{k}").alias(k) for k in keep],
        *(["label"] if with_target else []),
        "prediction",
        "probs",
        *([F.col("_warnings").alias("warnings")] if warn else []),
        *(["lower_95", "upper_95"] if interval else []),
    )


def _class_names(fitted: Fitted, meta: Meta) -> list[str]:
    if meta.target_is_text:
        return meta.target_labels()
    return [str(i) for i in range(fitted.classes)]


def predict_batch(
    fitted: Fitted, meta: Meta, df: DataFrame, keep: list[str] | None = None, warn: bool = False,
    digits: int = 6, interval: bool = False,
) -> DataFrame:
    """Predictions of raw rows: the class name or the number, with class probabilities.

    ``warn`` adds, row by row, the numbers outside the training range and the categories it did
    not have (``warnings``), and the features that ``df`` lacks (``missing_features``);
    ``interval`` adds a regression forest's interval over its trees.
    """
    keep = list(keep or [])
    scored = score_frame(fitted, meta, df, keep, warn=warn, interval=interval)
    if fitted.problem_type == REGRESSION:
        out = [F.round("prediction", digits).alias("prediction")]
    else:
        names = _class_names(fitted, meta)
        labels = F.array(*map(F.lit, names))
        pred = F.element_at(labels, F.col("prediction").cast("int") + 1)
        probs = F.map_from_arrays(labels, F.transform("probs", lambda p: F.round(p, digits)))
        out = [pred.alias("prediction"), F.when(F.col("probs").isNotNull(), probs).alias("probabilities")]
    if warn:
        absent = F.array(*map(F.lit, missing_features(df, meta))).cast("array<string>")
        out += [F.col("warnings"), absent.alias("missing_features")]
    return scored.select(*[ref(k) for k in keep], *out, *(["lower_95", "upper_95"] if interval else []))


def predict_only(fitted: Fitted, meta: Meta, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Decoded predictions when there is no target to compare with."""
    return predict_batch(fitted, meta, df, keep).select(*[ref(k) for k in (keep or [])], "prediction")


def predict_what_if(fitted: Fitted, meta: Meta, scenarios: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scenario rows with prediction, probabilities and warnings, and an interval where a regression forest predicts."""
    forest = fitted.name == FOREST and fitted.problem_type == REGRESSION
    return predict_batch(fitted, meta, scenarios, keep, warn=True, interval=forest)


def _metrics(fitted: Fitted, scored: DataFrame) -> DataFrame:
    if fitted.problem_type == REGRESSION:
        m = metrics_regression(scored, "label", "prediction")
        names = ["r2", "mae", "rmse"]
    else:
        m = metrics_classification(scored, "label", "prediction")
        names = ["accuracy", "f1"]
        if fitted.classes == 2:
            auc = roc_auc(scored.withColumn("s", F.element_at("probs", 2)), "label", "s")
            m = m.crossJoin(auc)  # one row each
            names.append("roc_auc")
    long = m.select(F.col("n_samples").cast("double").alias("n_samples"), *names)
    return long.unpivot([], ["n_samples", *names], "metric", "value")


def evaluate_holdout(fitted: Fitted, meta: Meta, df: DataFrame) -> DataFrame:
    """(metric, value) of labelled new data under the stored preprocessing."""
    return _metrics(fitted, score_frame(fitted, meta, df, [], with_target=True))


@dataclass
class Evaluation:
    """Outcome of ``evaluate``: the scored frame, written once, and what is read from it."""

    scored: DataFrame  # key, label, prediction, probs
    metrics: DataFrame
    views: dict[str, DataFrame]  # see ``metrics.views``
    drift: DataFrame | None
    missing_features: list[str]


def evaluate(
    fitted: Fitted, meta: Meta, df: DataFrame, key: str, train: DataFrame | None = None, points: int = ROC_TRAIN_POINTS
) -> Evaluation:
    """Score labelled new data once and read every view from it.

    Drift is judged against ``train`` where given, else against the distributions stored in ``meta``.
    """
    scored = settle(score_frame(fitted, meta, df, [key], with_target=True))
    classifier = fitted.problem_type == CLASSIFICATION
    return Evaluation(
        scored,
        _metrics(fitted, scored),
        views(scored, classifier, fitted.classes, key, points=points),
        evaluate_drift(meta, train, df) if train is not None else stored_report(meta, df),
        missing_features(df, meta),
    )


def evaluate_drift(meta: Meta, train: DataFrame, df: DataFrame) -> DataFrame:
    return drift_report(train, df, [c for c in meta.features if c in df.columns])
