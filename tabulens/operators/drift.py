"""Has a column's distribution moved between two frames?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import as_double, dtype_of, is_numeric, present, ref
from tabulens.functions.moments import ratio
from tabulens.functions.tails import chi2_p, ks_p
from tabulens.operators.engineer import MISSING_LABEL
from tabulens.operators.meta import Meta
from tabulens.operators.ranks import Cells, running_totals

ALPHA = 0.05
EXPECTED_FLOOR = 1e-9


def _value_counts(train: DataFrame, other: DataFrame, cols: list[str], pick) -> DataFrame:
    """(feature, value, a, b): rows per value on either side, all features in one aggregation."""
    sides = []
    for df, a in ((train, 1), (other, 0)):
        long = df.select(*[pick(df, c).alias(c) for c in cols]).unpivot(
            [], [ref(c) for c in cols], "feature", "value"
        )
        sides.append(
            long.where("value is not null").select(
                "feature", "value", F.lit(a).alias("a"), F.lit(1 - a).alias("b")
            )
        )
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy("feature", "value")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )


def _sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(  # one row per feature
        F.sum("a").alias("n"), F.sum("b").alias("m"), F.count("*").alias("k")
    )


def drift_ks(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, statistic, p_value, drifted): two-sample Kolmogorov-Smirnov per numeric column."""
    counts = _value_counts(train, other, cols, as_double)
    ranked = running_totals(counts, [F.col("value")], {"a0": "a", "b0": "b"}, by=["feature"])
    sizes = _sizes(ranked)
    gap = F.abs(
        ratio(F.col("a0") + F.col("a"), F.col("n")) - ratio(F.col("b0") + F.col("b"), F.col("m"))
    )
    d = (
        ranked.join(F.broadcast(sizes), "feature")
        .where("n > 0 and m > 0")
        .groupBy("feature", "n", "m")
        .agg(F.max(gap).alias("statistic"))
    )
    p = ks_p(F.col("statistic"), F.col("n"), F.col("m"))
    return d.select("feature", "statistic", p.alias("p_value"), (p < ALPHA).alias("drifted"))


def chi2_statistic(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, statistic, dof): observed counts against the first frame's shares."""
    return _chi2(_value_counts(train, other, cols, lambda df, c: present(df, c).cast("string")))


def _chi2(counts: DataFrame) -> DataFrame:
    sizes = _sizes(counts)
    share = F.greatest(ratio(F.col("a"), F.col("n")) * F.col("m"), F.lit(EXPECTED_FLOOR))
    gap = F.col("b") - share
    return (
        counts.join(F.broadcast(sizes), "feature")
        .where("n > 0 and m > 0 and k >= 2")
        .groupBy("feature", "k")
        .agg(F.sum(gap * gap / share).alias("statistic"))
        .select("feature", "statistic", (F.col("k") - 1).alias("dof"))
    )


def drift_chi2(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    return _judged(chi2_statistic(train, other, cols))


def _judged(statistic: DataFrame) -> DataFrame:
    s = statistic.withColumn("p_value", chi2_p(F.col("statistic"), F.col("dof").cast("double")))
    return s.select("feature", "statistic", "p_value", (F.col("p_value") < ALPHA).alias("drifted"))


def drift_report(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, test, p_value, drifted, n_drifted) over numeric and text columns."""
    numeric = [c for c in cols if is_numeric(dtype_of(train, c))]
    texts = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        parts.append(drift_ks(train, other, numeric).withColumn("test", F.lit("ks")))
    if texts:
        parts.append(drift_chi2(train, other, texts).withColumn("test", F.lit("chi2")))
    return _whole(parts)


def _whole(parts: list[DataFrame]) -> DataFrame:
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    total = both.agg(F.count_if("drifted").alias("n_drifted"))
    return both.crossJoin(F.broadcast(total)).select(  # a single row
        "feature", "test", F.round("p_value", 6).alias("p_value"), "drifted", "n_drifted"
    )


# --- against a stored distribution ---------------------------------------------------------------


def stored_ks(meta: Meta, other: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, statistic, p_value, drifted, error) against the distributions that ``meta`` holds: one scan of ``other``.

    The statistic is the largest gap at, or just below, a stored value. It is at most ``error``, the
    largest share of training rows between two of them, below the one over all values, and equal to it
    where the training column had few values.
    """
    spark = other.sparkSession
    known = [c for c in cols if c in meta.spreads and meta.spreads[c].n and c in other.columns]
    rows = []
    if known:
        doubles = other.select(*[as_double(other, c).alias(c) for c in known])
        with Cells(doubles, {c: [(v, v) for v in meta.spreads[c].values] for c in known}) as cells:
            totals = cells.totals()
        for i, c in enumerate(known):
            m = sum(n for (j, _), (n, _) in totals.items() if j == i)
            if not m:
                continue
            s, (_, below, upto) = meta.spreads[c], cells.steps(c, totals)
            gaps = [abs(a / s.n - b / m) for a, b in zip([*s.below, *s.upto], [*below, *upto])]
            rows.append((c, max(gaps), s.n, m, s.gap))
    found = spark.createDataFrame(rows, "feature string, statistic double, n bigint, m bigint, error double")
    p = ks_p(F.col("statistic"), F.col("n"), F.col("m"))
    return found.select("feature", "statistic", p.alias("p_value"), (p < ALPHA).alias("drifted"), "error")


def stored_chi2(meta: Meta, other: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, statistic, p_value, drifted) against the category counts that ``meta`` holds, missing values aside."""
    known = [c for c in cols if c in meta.texts and c in other.columns]
    train = meta.classes.where(F.col("column").isin(known) & (F.col("class") != MISSING_LABEL)).select(
        F.col("column").alias("feature"), F.col("class").alias("value"), F.col("n").alias("a"), F.lit(0).alias("b")
    )
    long = other.select(*[present(other, c).cast("string").alias(c) for c in known]).unpivot([], [ref(c) for c in known], "feature", "value")
    new = long.where(F.col("value").isNotNull() & (F.col("value") != MISSING_LABEL)).select("feature", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = train.unionByName(new).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return _judged(_chi2(counts))


def stored_report(meta: Meta, other: DataFrame, cols: list[str] | None = None) -> DataFrame | None:
    """``drift_report`` without the training frame; None where no feature of ``meta`` is in ``other``."""
    cols = [c for c in (cols or meta.features) if c in other.columns]
    numeric, texts = [c for c in cols if c in meta.spreads], [c for c in cols if c in meta.texts]
    parts = []
    if numeric:
        parts.append(stored_ks(meta, other, numeric).drop("error").withColumn("test", F.lit("ks")))
    if texts:
        parts.append(stored_chi2(meta, other, texts).withColumn("test", F.lit("chi2")))
    return _whole(parts) if parts else None
