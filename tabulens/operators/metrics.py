"""Metrics, curves and bootstrap intervals of scored frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import ref, union_all
from tabulens.functions.hashing import sample_n, slot, uniform
from tabulens.functions.moments import ratio
from tabulens.operators.ranks import running_totals

# Sizes of the reported curves, samples and resamples.
ROC_TRAIN_POINTS = 200
ROC_EVAL_POINTS = 100
CALIBRATION_BINS = 10
SAMPLE_TRAIN = 500
SAMPLE_EVAL = 1000
RESAMPLES = 500
INTERVAL = (0.025, 0.975)
ALIGN_WITHIN = 0.02

BLOCKS = 1024  # resampling units of the bootstrap


def metrics_regression(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n_samples, r2, mae, rmse) in one aggregation."""
    y, e = ref(actual).cast("double"), ref(actual).cast("double") - ref(predicted).cast("double")
    total = F.var_pop(y) * F.count(y)
    return scored.agg(
        F.count("*").alias("n_samples"),
        F.round(1.0 - ratio(F.sum(e * e), total), 6).alias("r2"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
    )


def confusion_cells(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    return scored.groupBy(ref(actual).alias("actual"), ref(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def f1_from_cells(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n_samples, accuracy, f1) from confusion counts, f1 weighted by class size."""
    by = by or []
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = [
        cells.select(*by, F.col("actual").alias("c"), F.col("n").alias("s"), F.lit(0).alias("p"), hit.alias("tp")),
        cells.select(
            *by, F.col("predicted").alias("c"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("tp")
        ),
    ]
    per_class = (
        union_all(sides)
        .groupBy(*by, "c")
        .agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("s") + F.col("p")), F.lit(0.0))
    return per_class.groupBy(*by).agg(
        F.sum("s").cast("bigint").alias("n_samples"),
        ratio(F.sum("tp"), F.sum("s")).alias("accuracy"),
        ratio(F.sum(F.col("s") * f1), F.sum("s")).alias("f1"),
    )


def metrics_classification(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    out = f1_from_cells(confusion_cells(scored, actual, predicted))
    return out.select(
        "n_samples", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1")
    )


# --- ROC -----------------------------------------------------------------------------------------


def _score_counts(scored: DataFrame, label: Column, score: Column, by: dict[str, Column]) -> DataFrame:
    y = F.when(label, 1).otherwise(0)
    return (
        scored.select(*[e.alias(k) for k, e in by.items()], score.cast("double").alias("score"), y.alias("y"))
        .groupBy(*by, "score")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )


def _auc(counts: DataFrame, by: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    ranked = running_totals(counts, [F.col("score")], {"neg_before": "neg"}, by=by)
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)
    return ranked.groupBy(*by).agg(
        ratio(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve of a 0/1 label; NULL when only one class is present."""
    counts = _score_counts(scored, ref(label) == 1, ref(score), {})
    return _auc(counts, []).select(F.round("auc", 6).alias("roc_auc"))


def _curve(counts: DataFrame, by: list[str], max_points: int) -> DataFrame:
    """ROC points per ``by``: inner points between equal steps dropped, a (0, 0) start, thinned."""
    ordered = running_totals(
        counts, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, by=by, number="i"
    )
    nxt = ordered.select(
        *by, (F.col("i") - 1).alias("i"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2")
    )
    paired = ordered.join(nxt, [*by, "i"], "left")
    turn = (F.col("i") == 0) | F.col("pos2").isNull() | (F.col("pos") != F.col("pos2")) | (
        F.col("neg") != F.col("neg2")
    )
    kept = paired.where(turn).select(
        *by, "i", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("fp") + F.col("neg")).alias("fp")
    )
    kept = running_totals(kept, [F.col("i")], {}, by=by, number="point")
    kept = kept.select(*by, (F.col("point") + 1).alias("point"), "tp", "fp")
    sizes = kept.groupBy(*by).agg(  # one row per curve
        F.max("point").alias("last"), F.max("tp").alias("p"), F.max("fp").alias("n")
    )
    step = F.col("last") / F.lit(float(max_points - 1))
    spots = F.when(F.col("last") < max_points, F.sequence(F.lit(0), F.col("last"))).otherwise(
        F.array_append(
            F.transform(
                F.sequence(F.lit(0), F.lit(max_points - 2)), lambda j: F.floor(j * step).cast("bigint")
            ),
            F.col("last"),
        )
    )
    wanted = sizes.select(*by, "p", "n", F.explode(F.array_distinct(spots.cast("array<bigint>"))).alias("point"))
    joined = F.broadcast(wanted).join(kept, [*by, "point"], "left")  # at most max_points rows per curve
    joined = joined.where("point = 0 or tp is not null")
    return joined.select(
        *by,
        "point",
        F.round(ratio(F.coalesce("fp", F.lit(0)), F.col("n")), 4).alias("fpr"),
        F.round(ratio(F.coalesce("tp", F.lit(0)), F.col("p")), 4).alias("tpr"),
    )


def roc_curve(scored: DataFrame, label: str, score: str, max_points: int = ROC_TRAIN_POINTS) -> DataFrame:
    """(point, fpr, tpr) of a 0/1 label, at most max_points points."""
    return _curve(_score_counts(scored, ref(label) == 1, ref(score), {}), [], max_points)


def _one_vs_rest(scored: DataFrame, label: str, probs: str, classes: list) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(str(c)).alias("label"), (ref(label) == F.lit(c)).alias("y"), F.element_at(ref(probs), i + 1).alias("s"))
            for i, c in enumerate(classes)
        ]
    )
    rows = scored.select(F.explode(pairs).alias("r")).select("r.*")
    return _score_counts(rows, F.col("y"), F.col("s"), {"label": F.col("label")})


def roc_ovr(
    scored: DataFrame, label: str, probs: str, classes: list, max_points: int = ROC_TRAIN_POINTS
) -> DataFrame:
    """One curve per class against the rest, with its area."""
    counts = _one_vs_rest(scored, label, probs, classes)
    areas = _auc(counts, ["label"]).select("label", F.round("auc", 4).alias("auc"))
    return _curve(counts, ["label"], max_points).join(F.broadcast(areas), "label")


def roc_align(curves: DataFrame, within: float = ALIGN_WITHIN) -> DataFrame:
    """Every curve read at every fpr of any curve: the nearest point closer than ``within``.

    A nearest join on bands as wide as the tolerance, so a point meets only its
    neighbouring bands. Curves hold a few hundred points each.
    """
    ends = curves.sparkSession.createDataFrame([(0.0,), (1.0,)], "point double")
    at = curves.select(F.col("fpr").alias("point")).unionByName(ends).distinct()
    band = lambda c: F.floor(F.col(c) / F.lit(within)).cast("bigint")
    left = at.select("point", F.explode(F.sequence(band("point") - 1, band("point") + 1)).alias("band"))
    right = curves.select("label", "fpr", "tpr", band("fpr").alias("band"))
    gap = F.abs(F.col("fpr") - F.col("point"))
    return (
        left.join(right, "band")
        .where(gap < within)
        .groupBy("point", "label")
        .agg(F.min(F.struct(gap.alias("gap"), F.col("fpr"), F.col("tpr"))).alias("m"))
        .select(F.col("point").alias("fpr"), "label", F.col("m.tpr").alias("tpr"))
    )


# --- tables ---------------------------------------------------------------------------------------


def confusion_matrix(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over every pair of the labels seen on either side."""
    cells = confusion_cells(scored, actual, predicted)
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct()
    every = labels.agg(F.collect_set("actual").alias("all"))  # one entry per class
    grid = labels.crossJoin(F.broadcast(every)).select("actual", F.explode("all").alias("predicted"))
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_row_pct(confusion: DataFrame) -> DataFrame:
    """Share of the true class in percent."""
    whole = F.sum("n").over(Window.partitionBy("actual"))
    return confusion.select(
        "actual", "predicted", "n", F.round(F.coalesce(ratio(F.col("n") * 100.0, whole), F.lit(0.0)), 2).alias("pct")
    )


def calibration_curve(scored: DataFrame, label: str, score: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """(bin, mean_predicted, fraction_of_positives); right-closed bins, empty ones left out."""
    code = F.lit(0)
    for i in range(1, bins):
        code = code + (ref(score) > F.lit(i / bins)).cast("int")
    return (
        scored.select(code.alias("bin"), ref(score).alias("s"), (ref(label) == 1).cast("double").alias("y"))
        .groupBy("bin")
        .agg(F.round(F.avg("s"), 6).alias("mean_predicted"), F.round(F.avg("y"), 6).alias("fraction_of_positives"))
    )


def predictions_sample(
    scored: DataFrame, actual: str, predicted: str, key: str, n: int = SAMPLE_TRAIN
) -> DataFrame:
    return sample_n(scored, n, key).select(
        ref(actual).alias("actual"), F.round(ref(predicted).cast("double"), 6).alias("predicted")
    )


def residuals(
    scored: DataFrame, actual: str, predicted: str, key: str | None = None, n: int | None = None
) -> DataFrame:
    """(fitted, residual) of all rows, or of n sampled ones."""
    if n is not None:
        scored = sample_n(scored, n, key)
    gap = ref(actual).cast("double") - ref(predicted).cast("double")
    return scored.select(
        F.round(ref(predicted).cast("double"), 6).alias("fitted"), F.round(gap, 6).alias("residual")
    )


# --- bootstrap ------------------------------------------------------------------------------------


def _poisson(u: Column) -> Column:
    """Poisson(1) count from a uniform number, by its distribution function."""
    marks, p, total = [], math.exp(-1.0), 0.0
    for k in range(1, 13):
        total += p
        marks.append(total)
        p /= k

    def count(v: Column) -> Column:
        n = F.lit(0)
        for m in marks:
            n = n + (v >= F.lit(m)).cast("int")
        return n

    # through an array, so that the hash behind ``u`` is computed once and not per mark
    return F.element_at(F.transform(F.array(u), count), 1)


def _weights(spark, n: int, seed: int) -> DataFrame:
    """(block, b, w): how often each block is drawn in each of the n resamples."""
    drawn = spark.range(BLOCKS).select(
        F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")
    )
    w = _poisson(uniform(F.col("block"), F.col("b"), F.lit(seed)))
    return drawn.select("block", "b", w.alias("w"))


def _interval(values: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, ci_lower, ci_upper) over one row per resample."""
    long = values.select("b", *metrics).unpivot(["b"], [ref(m) for m in metrics], "metric", "value")
    return long.groupBy("metric").agg(
        F.round(F.percentile("value", F.lit(INTERVAL[0])), 6).alias("ci_lower"),
        F.round(F.percentile("value", F.lit(INTERVAL[1])), 6).alias("ci_upper"),
    )


def bootstrap_ci(
    scored: DataFrame,
    actual: str,
    predicted: str,
    key: str,
    problem_type: str,
    n: int = RESAMPLES,
    seed: int = 42,
) -> DataFrame:
    """Percentile intervals of the metrics over n Poisson resamples.

    Rows fall into BLOCKS hash blocks and one scan reduces each block to the sums the
    metrics need; the resamples then reweight blocks, so their cost does not grow with
    the rows. Blocks are random groups of rows of like size, which keeps the spread of
    the metrics that of row resampling.
    """
    block = slot(scored, key, BLOCKS, seed).alias("block")
    if problem_type == "regression":
        y, p = ref(actual).cast("double"), ref(predicted).cast("double")
        centre = scored.agg(F.avg(y).alias("c")).first()["c"] or 0.0
        d = F.col("y") - F.lit(centre)  # centred, so the squares lose no digits
        e = F.col("y") - F.col("p")
        sums = (
            scored.select(block, y.alias("y"), p.alias("p"))
            .groupBy("block")
            .agg(
                F.count("*").alias("n"),
                F.sum(d).alias("d"),
                F.sum(d * d).alias("dd"),
                F.sum(F.abs(e)).alias("ae"),
                F.sum(e * e).alias("ee"),
            )
        )
        w = F.col("w")
        per = _weights(scored.sparkSession, n, seed).join(sums, "block").groupBy("b").agg(
            *[F.sum(w * F.col(c)).alias(c) for c in ("n", "d", "dd", "ae", "ee")]
        )
        spread = F.col("dd") - F.col("d") * F.col("d") / F.col("n")
        values = per.select(
            "b",
            (1.0 - ratio(F.col("ee"), spread)).alias("r2"),
            ratio(F.col("ae"), F.col("n")).alias("mae"),
            F.sqrt(ratio(F.col("ee"), F.col("n"))).alias("rmse"),
        )
        return _interval(values, ["r2", "mae", "rmse"])
    cells = (
        scored.select(block, ref(actual).alias("actual"), ref(predicted).alias("predicted"))
        .groupBy("block", "actual", "predicted")
        .agg(F.count("*").alias("n"))
    )
    drawn = _weights(scored.sparkSession, n, seed).join(cells, "block")
    per = drawn.groupBy("b", "actual", "predicted").agg(
        F.sum(F.col("w") * F.col("n")).alias("n")
    )
    return _interval(f1_from_cells(per, ["b"]), ["accuracy", "f1"])


def views(
    scored: DataFrame, classifier: bool, classes: int, key: str, n: int = SAMPLE_TRAIN, points: int = ROC_TRAIN_POINTS
) -> dict[str, DataFrame]:
    """All views of one scored frame (``key``, label, prediction, probs), each a DataFrame of its own.

    Numbers: predictions, residuals (all rows). Classes: predictions, confusion (with row
    percentages), and where there are probabilities roc (two classes: and calibration).
    Every view reads ``scored``, so give a frame that was written once.
    """
    out = {"predictions": predictions_sample(scored, "label", "prediction", key, n)}
    if not classifier:
        return out | {"residuals": residuals(scored, "label", "prediction")}
    out["confusion"] = confusion_row_pct(confusion_matrix(scored, "label", "prediction"))
    known = scored.where("probs is not null")
    if known.isEmpty():
        return out
    if classes == 2:
        positive = known.withColumn("score", F.element_at("probs", 2))
        out["roc"] = roc_curve(positive, "label", "score", points)
        out["calibration"] = calibration_curve(positive, "label", "score")
    else:
        out["roc"] = roc_ovr(known, "label", "probs", list(range(classes)), points)
    return out
