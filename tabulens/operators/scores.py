"""Feature scores against a target and the weighted ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import dtype_of, is_numeric, ref, require_columns, rows_of, union_all
from tabulens.functions.moments import pearson, ratio
from tabulens.operators import forests
from tabulens.operators.correlation import prepare_features, signed, with_ranks
from tabulens.operators.engineer import quantile_edges, with_codes
from tabulens.operators.profile import (
    CLASSIFICATION,
    REGRESSION,
    class_balance,
    detect_problem_type,
    distinct_counts,
    effective_dtype,
)
from tabulens.session import settle

# Method weights per problem type, number of information bins.
WEIGHTS = {
    REGRESSION: {"pearson": 0.30, "spearman": 0.25, "mutual_info": 0.25, "rf_importance": 0.20},
    CLASSIFICATION: {"anova_f": 0.25, "chi2": 0.20, "mutual_info": 0.30, "rf_importance": 0.25},
}
INFO_BINS = 32
FOREST_TREES = 100
FOREST_DEPTH = 5
FIT_ROWS = forests.FIT_ROWS
FOREST_ROWS = 500_000  # rows that one task of a forest keeps and reads at every level: 137 MB with 20 trees and classes


def features_of(prepared: DataFrame, target: str) -> list[str]:
    return [c for c in prepared.columns if c != target]


def signed_pearson(prepared: DataFrame, target: str) -> DataFrame:
    return rows_of(
        prepared,
        [
            {"column": F.lit(c), "r": pearson(ref(c), ref(target))}
            for c in features_of(prepared, target)
        ],
    )


def score_pearson(prepared: DataFrame, target: str) -> DataFrame:
    """|r| per feature, 0 where it is undefined."""
    return signed_pearson(prepared, target).select(
        "column", F.coalesce(F.abs("r"), F.lit(0.0)).alias("score")
    )


def score_spearman(prepared: DataFrame, target: str) -> DataFrame:
    return score_pearson(with_ranks(prepared, prepared.columns), target)


def score_mutual_info(
    prepared: DataFrame,
    target: str,
    problem_type: str,
    bins: int = INFO_BINS,
    categories: list[str] | None = None,
) -> DataFrame:
    """Plug-in mutual information on equal-frequency bins; ``categories`` are taken as they are.

    All features are counted in one long aggregation of (feature, bin, target bin).
    """
    feats = features_of(prepared, target)
    exact = set(categories or [])
    if problem_type == CLASSIFICATION:
        exact.add(target)
    binned = [c for c in [*feats, target] if c not in exact]
    edges = quantile_edges(prepared, binned, bins) if binned else {}
    inner = {c: edges[c][1:-1] for c in binned}
    names = {c: f"_bin{i}" for i, c in enumerate(binned)}
    code = lambda c: ref(names[c]) if c in names else ref(c)
    coded = with_codes(prepared, inner, names).select(
        *[code(c).cast("bigint").alias(c) for c in feats], code(target).cast("bigint").alias("_by")
    )
    cells = (
        coded.unpivot(["_by"], [ref(c) for c in feats], "column", "_bx")
        .groupBy("column", "_bx", "_by")
        .agg(F.count("*").alias("n"))
    )
    # T * MI = sum n ln n - sum nx ln nx - sum ny ln ny + T ln T, so no join back is needed
    size = lambda c: F.col(c).cast("double") * F.log(F.col(c).cast("double"))
    both = cells.groupBy("column").agg(F.sum(size("n")).alias("part"), F.sum("n").alias("t"))
    sides = [
        cells.groupBy("column", side)
        .agg(F.sum("n").alias("m"))
        .groupBy("column")
        .agg((-F.sum(size("m"))).alias("part"), F.lit(0).cast("bigint").alias("t"))
        for side in ("_bx", "_by")
    ]
    total = union_all([both, *sides]).groupBy("column").agg(
        F.sum("part").alias("part"), F.sum("t").cast("double").alias("t")
    )
    info = ratio(F.col("part"), F.col("t")) + F.log("t")
    return total.select("column", F.greatest(info, F.lit(0.0)).alias("score"))


def class_moments(prepared: DataFrame, target: str) -> DataFrame:
    """(column, class, n, total, mean, var, low): one group-by feeds both class scores."""
    feats = features_of(prepared, target)
    wide = prepared.groupBy(ref(target).alias("class")).agg(
        F.count("*").alias("n"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.sum(ref(c)).alias("total"),
                    F.avg(ref(c)).alias("mean"),
                    F.var_pop(ref(c)).alias("var"),
                    F.min(ref(c)).alias("low"),
                )
                for c in feats
            ]
        ).alias("m"),
    )
    return wide.select("class", "n", F.inline("m"))


def score_anova_f(prepared: DataFrame, target: str) -> DataFrame:
    """Between-class over within-class variance, 0 where it is undefined."""
    m = class_moments(prepared, target).withColumn("n", F.col("n").cast("double"))
    whole = m.groupBy("column").agg(  # one row per feature
        F.sum("n").alias("all"),
        F.count("*").cast("double").alias("k"),
        ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"),
    )
    gap = F.col("mean") - F.col("grand")
    sums = (
        m.join(F.broadcast(whole), "column")
        .groupBy("column", "all", "k")
        .agg(F.sum(F.col("n") * gap * gap).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    )
    f = ratio(
        ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("all") - F.col("k"))
    )
    return sums.select("column", F.coalesce(f, F.lit(0.0)).alias("score"))


def score_chi2(prepared: DataFrame, target: str) -> DataFrame:
    """Per class, the sum of the feature (shifted to be non-negative) against its share of rows."""
    m = class_moments(prepared, target).withColumn("n", F.col("n").cast("double"))
    whole = m.groupBy("column").agg(  # one row per feature
        F.sum("n").alias("all"),
        F.sum("total").alias("sum"),
        F.least(F.min("low"), F.lit(0.0)).alias("shift"),
    )
    m = m.join(F.broadcast(whole), "column")
    observed = F.col("total") - F.col("n") * F.col("shift")
    expected = ratio(F.col("n"), F.col("all")) * (F.col("sum") - F.col("all") * F.col("shift"))
    gap = observed - expected
    return m.groupBy("column").agg(
        F.coalesce(F.sum(ratio(gap * gap, expected)), F.lit(0.0)).alias("score")
    )


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in tasks of about FOREST_ROWS where a task of the input has more; others stay as they are."""
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    largest, n = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= FOREST_ROWS:
        return rows
    # by a number per row, so equal rows are spread as well and nothing is sorted
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.repartition(-(-n // FOREST_ROWS), "_at").drop("_at")


def score_rf_importance(
    prepared: DataFrame, target: str, problem_type: str, trees: int = FOREST_TREES, seed: int = 42
) -> DataFrame:
    """Shares of the trees' gains. Regression forests of more than FIT_ROWS rows grow on binned rows, see ``forests``."""
    feats = features_of(prepared, target)
    if problem_type == REGRESSION and (n := prepared.count()) > FIT_ROWS:
        forest = forests.Forest([*range(len(feats))], np.array([True]), np.array([False]))
        forests.grow(forests.blocks(prepared, feats, F.lit(0), trees, seed, n, label=target), [forest], FOREST_DEPTH)
        return prepared.sparkSession.createDataFrame(
            [(c, float(w)) for c, w in zip(feats, forest.importances())], "column string, score double"
        )
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(feats))], outputCol="features").transform(
        dealt(
            prepared.select(
                *[ref(c).alias(f"f{i}") for i, c in enumerate(feats)], ref(target).alias("label")
            )
        )
    )
    common = dict(numTrees=trees, maxDepth=FOREST_DEPTH, seed=seed, labelCol="label", featuresCol="features")
    if problem_type == REGRESSION:
        forest = RandomForestRegressor(featureSubsetStrategy="all", **common)
    else:
        forest = RandomForestClassifier(featureSubsetStrategy="sqrt", **common)
    weights = forest.fit(rows).featureImportances.toArray()
    return prepared.sparkSession.createDataFrame(
        [(c, float(w)) for c, w in zip(feats, weights)], "column string, score double"
    )


def normalize_scores(raw: DataFrame) -> DataFrame:
    """Min-max per method over the features: (column, method, raw_score, score); all equal gives 1."""
    w = Window.partitionBy("method")
    bad = F.isnan("raw_score") | (F.abs("raw_score") == float("inf"))
    safe = F.when(bad | F.col("raw_score").isNull(), 0.0).otherwise(F.col("raw_score"))
    raw = raw.withColumn("_v", safe)
    lo, hi = F.min("_v").over(w), F.max("_v").over(w)
    score = F.when(lo == hi, F.lit(1.0)).otherwise(F.try_divide(F.col("_v") - lo, hi - lo))
    return raw.select("column", "method", "raw_score", score.alias("score"))


def weighted_rank(scores: DataFrame, problem_type: str, top_n: int | None = None) -> DataFrame:
    """(rank, column, final_score): the weighted sum of the normalised scores."""
    weights = scores.sparkSession.createDataFrame(
        list(WEIGHTS[problem_type].items()), "method string, weight double"
    )
    summed = (
        scores.join(F.broadcast(weights), "method")
        .groupBy("column")
        .agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("final_score"))
    )
    # one row per feature
    ranked = summed.select(
        F.row_number().over(Window.orderBy(F.desc("final_score"), "column")).alias("rank"),
        "column",
        "final_score",
    )
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked


def corr_direction(prepared: DataFrame, target: str, problem_type: str) -> DataFrame:
    r = signed_pearson(prepared, target)
    side = signed(F.col("r")) if problem_type == REGRESSION else F.lit("n/a")
    return r.select("column", side.alias("correlation_direction"))


def raw_scores(
    prepared: DataFrame,
    target: str,
    problem_type: str,
    categories: list[str] | None = None,
    trees: int = FOREST_TREES,
    methods: list[str] | None = None,
) -> DataFrame:
    """(column, method, raw_score) of all methods of the problem type."""
    makers = {
        "pearson": lambda: score_pearson(prepared, target),
        "spearman": lambda: score_spearman(prepared, target),
        "anova_f": lambda: score_anova_f(prepared, target),
        "chi2": lambda: score_chi2(prepared, target),
        "mutual_info": lambda: score_mutual_info(
            prepared, target, problem_type, categories=categories
        ),
        "rf_importance": lambda: score_rf_importance(prepared, target, problem_type, trees),
    }
    wanted = methods or list(WEIGHTS[problem_type])
    return union_all(
        [
            makers[m]().select("column", F.lit(m).alias("method"), F.col("score").alias("raw_score"))
            for m in wanted
        ]
    )


def select_features(
    df: DataFrame,
    target: str,
    problem_type: str | None = None,
    top_n: int | None = None,
    trees: int = FOREST_TREES,
    methods: list[str] | None = None,
) -> DataFrame:
    """The full ranking, one row per feature and method.

    The prepared frame is written once, since every scorer reads it.
    """
    require_columns(df, [target])
    if len(df.columns) < 2:
        raise ValueError("no feature column remains besides the target")
    if problem_type is None:
        problem_type = detect_problem_type(df, target).first()["problem_type"]
    prepared = settle(prepare_features(df, target))
    feats = features_of(prepared, target)
    texts = [c for c in feats if not is_numeric(dtype_of(df, c))]
    scores = settle(
        normalize_scores(raw_scores(prepared, target, problem_type, texts, trees, methods))
    )
    ranking = weighted_rank(scores, problem_type, top_n)
    return (
        ranking.join(scores, "column")
        .join(effective_dtype(df, feats), "column")
        .join(distinct_counts(df, feats), "column")
        .join(corr_direction(prepared, target, problem_type), "column")
        .select(
            "rank",
            "column",
            "final_score",
            "method",
            F.round("score", 6).alias("score"),
            F.round("raw_score", 6).alias("raw_score"),
            "dtype",
            "n_unique",
            "correlation_direction",
        )
    )


@dataclass
class Selection:
    """A ranking with what belongs to it; ``class_balance`` is None for a regression."""

    problem_type: str
    ranking: DataFrame
    class_balance: DataFrame | None
    weights: dict[str, float]
    n_features: int


def feature_selection(
    df: DataFrame,
    target: str,
    problem_type: str | None = None,
    top_n: int | None = None,
    trees: int = FOREST_TREES,
    methods: list[str] | None = None,
) -> Selection:
    """``select_features`` together with the classes of the target and the weights used."""
    require_columns(df, [target])
    if problem_type is None:
        problem_type = detect_problem_type(df, target).first()["problem_type"]
    ranking = select_features(df, target, problem_type, top_n, trees, methods)
    balance = class_balance(df, target) if problem_type == CLASSIFICATION else None
    return Selection(problem_type, ranking, balance, dict(WEIGHTS[problem_type]), len(df.columns) - 1)


def rank_top(ranking: DataFrame, n: int = 10) -> DataFrame:
    return ranking.where(F.col("rank") <= n)


def rank_methods(ranking: DataFrame, n: int = 5) -> DataFrame:
    """Methods by the top n features: one row per (method, column)."""
    return ranking.where(F.col("rank") <= n).select("method", "column", "score")


def score_band(ranking: DataFrame) -> DataFrame:
    s = F.col("final_score")
    return ranking.withColumn("band", F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low"))
