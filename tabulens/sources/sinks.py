"""Writing results and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators.meta import Meta, Spread
from tabulens.operators.models import Fitted, load_fitted, save_fitted


def predictions_table(predictions: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """prediction and one prob_<class> column per class, 6 digits."""
    probs = [
        F.format_string("%.6f", F.element_at("probabilities", F.lit(c))).alias(f"prob_{c}")
        for c in (classes or [])
    ]
    return predictions.select("prediction", *probs)


def write_predictions(predictions: DataFrame, path: str, classes: list[str] | None = None) -> None:
    predictions_table(predictions, classes).write.mode("overwrite").option("header", True).csv(path)


def rankings_table(ranking: DataFrame) -> DataFrame:
    """rank, column, final_score, one column per method, dtype, correlation_direction."""
    methods = [r["method"] for r in ranking.select("method").distinct().orderBy("method").collect()]
    return (
        ranking.groupBy("rank", "column", "final_score", "dtype", "correlation_direction")
        .pivot("method", methods)
        .agg(F.first("score"))
        .select("rank", "column", "final_score", *methods, "dtype", "correlation_direction")
        .orderBy("rank")
    )


def write_rankings(ranking: DataFrame, path: str) -> None:
    # one row per feature
    rankings_table(ranking).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(fitted: Fitted, meta: Meta, path: str, spark: SparkSession) -> None:
    """Model, category table and column facts under one folder."""
    save_fitted(fitted, path, spark)
    meta.frame(spark).withColumn("position", F.monotonically_increasing_id()).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/columns")
    spark.createDataFrame(
        [(meta.features, meta.texts, meta.target, meta.target_is_text, meta.target_median, meta.classes is not None)],
        "features array<string>, texts array<string>, target string, target_is_text boolean,"
        " target_median double, has_classes boolean",
    ).write.mode("overwrite").parquet(f"{path}/meta")
    spreads = [(c, s.n, s.values, s.below, s.upto) for c, s in meta.spreads.items()]
    schema = "column string, n bigint, values array<double>, below array<bigint>, upto array<bigint>"
    spark.createDataFrame(spreads, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/spreads")
    if meta.classes is not None:
        meta.classes.write.mode("overwrite").parquet(f"{path}/classes")


def load_model(path: str, spark: SparkSession) -> tuple[Fitted, Meta]:
    m = spark.read.parquet(f"{path}/meta").first()
    columns = spark.read.parquet(f"{path}/columns").where("kind = 'numeric'").collect()
    meta = Meta(
        features=list(m["features"]),
        target=m["target"],
        numbers={r["column"]: (r["median"], r["lo"], r["hi"]) for r in columns},
        classes=spark.read.parquet(f"{path}/classes") if m["has_classes"] else None,
        texts=list(m["texts"]),
        target_is_text=m["target_is_text"],
        target_median=m["target_median"],
        spreads={
            r["column"]: Spread(r["n"], list(r["values"]), list(r["below"]), list(r["upto"]))
            for r in spark.read.parquet(f"{path}/spreads").collect()
        },
    )
    return load_fitted(path, spark), meta
