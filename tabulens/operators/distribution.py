"""Histograms, densities, box statistics, running shares and outliers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import (
    as_double,
    dtype_of,
    is_numeric,
    number_columns,
    present,
    ref,
    require_columns,
    rows_of,
)
from tabulens.functions.moments import percent, ratio
from tabulens.operators.profile import QUARTILES, distinct_counts, few_distinct
from tabulens.operators.ranks import (
    Cells,
    brackets_of,
    column_facts,
    interpolated,
    order_statistics,
    percentiles,
    ranks_around,
)

# Limits of the distribution report.
PER_VALUE_LIMIT = 15
TOP_VALUES = 20
KDE_POINTS = 100
OUTLIERS_SHOWN = 100
Z_LIMIT = 3.0
FENCE = 1.5
MIN_VALUES = 4


def per_value_mode(df: DataFrame, c: str) -> bool:
    """Text and columns of at most 15 distinct values are shown per value."""
    if not is_numeric(dtype_of(df, c)):
        return True
    return few_distinct(df, [c], PER_VALUE_LIMIT)[c] <= PER_VALUE_LIMIT


def distribution_meta(df: DataFrame, c: str) -> DataFrame:
    """(column, col_type, chart_type, total, unique, n_nan)."""
    numeric = is_numeric(dtype_of(df, c))
    facts = df.agg(
        F.count(present(df, c)).alias("total"), F.count_if(present(df, c).isNull()).alias("n_nan")
    )
    return facts.crossJoin(distinct_counts(df, [c])).select(  # one row each
        "column",
        F.lit("numeric" if numeric else "categorical").alias("col_type"),
        F.when(F.lit(not numeric) | (F.col("n_unique") <= PER_VALUE_LIMIT), "per_value")
        .otherwise("histogram")
        .alias("chart_type"),
        "total",
        F.col("n_unique").alias("unique"),
        "n_nan",
    )


def _range(df: DataFrame, x: Column):
    return df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()


def _finite(c: str, r) -> tuple[float, float]:
    if math.isinf(r["lo"]) or math.isinf(r["hi"]):
        raise ValueError(f"column '{c}' holds infinite values")
    return r["lo"], r["hi"]


def hist_numeric(df: DataFrame, c: str, target: str | None = None, n_bins: int = 20) -> DataFrame:
    """Equal-width bins, the last one closed, empty bins kept: (bin, start, end, midpoint, count).

    With a target, ``mean_y`` is its mean per bin. One scan for the range and one
    aggregation with at most ``n_bins`` groups. A column without values, or with an infinite one, raises.
    """
    x = as_double(df, c)
    n_bins = min(n_bins, few_distinct(df, [c], n_bins)[c])
    r = _range(df, x)
    if not r["n"]:
        raise ValueError(f"column '{c}' has no values")
    lo, hi = _finite(c, r)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    bin_of = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(n_bins)), F.lit(n_bins))
    aggs = [F.count("*").alias("count")]
    cols = [bin_of.alias("bin")]
    if target:
        cols.append(as_double(df, target).alias("y"))
        aggs.append(F.avg("y").alias("mean_y"))
    counted = df.where(x.isNotNull()).select(*cols).groupBy("bin").agg(*aggs)
    width = (hi - lo) / n_bins
    start = lambda b: F.lit(lo) + (b - 1) * F.lit(width)
    bins = df.sparkSession.range(1, n_bins + 1).select(F.col("id").alias("bin"))
    out = bins.join(counted, "bin", "left").select(
        "bin",
        start(F.col("bin")).alias("start"),
        start(F.col("bin") + 1).alias("end"),
        ((start(F.col("bin")) + start(F.col("bin") + 1)) / 2).alias("midpoint"),
        F.coalesce("count", F.lit(0)).alias("count"),
        *(["mean_y"] if target else []),
    )
    return out


def hist_mean_target(df: DataFrame, c: str, target: str, n_bins: int = 20) -> DataFrame:
    return hist_numeric(df, c, target, n_bins).select("bin", "count", "mean_y")


def value_counts_top20(df: DataFrame, c: str, target: str | None = None) -> DataFrame:
    """The 20 most frequent values in value order: (label, count, midpoint, mean_y)."""
    numeric = is_numeric(dtype_of(df, c))
    v = present(df, c)
    y = as_double(df, target) if target else F.lit(None).cast("double")
    counted = (
        df.where(v.isNotNull())
        .select(v.alias("value"), y.alias("y"))
        .groupBy("value")
        .agg(F.count("*").alias("count"), F.avg("y").alias("mean_y"))
    )
    top = counted.orderBy(F.desc("count"), "value").limit(TOP_VALUES)
    mid = F.col("value").cast("double") if numeric else F.lit(0.0)
    return top.orderBy("value").select(
        F.col("value").cast("string").alias("label"), "count", mid.alias("midpoint"), "mean_y"
    )


def distribution_bins(df: DataFrame, c: str, target: str | None = None, n_bins: int = 20) -> DataFrame:
    """The bins of whichever chart the column calls for."""
    if per_value_mode(df, c):
        return value_counts_top20(df, c, target)
    return hist_numeric(df, c, target, n_bins)


def kde_gaussian(df: DataFrame, c: str, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian density on an even grid over the range, bandwidth s * n**(-1/5).

    Every value meets each grid point inside its task and is summed there, so only one
    row per point is shuffled. A column with few distinct values is counted first.
    """
    x = as_double(df, c)
    r = df.agg(
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.count(x).alias("n"),
        F.stddev_samp(x).alias("s"),
        F.approx_count_distinct(x).alias("d"),
    ).first()
    if not r["n"] or r["lo"] == r["hi"]:
        raise ValueError("a density needs at least two distinct values")
    _finite(c, r)
    h = r["s"] * r["n"] ** (-0.2)
    lo, step = r["lo"], (r["hi"] - r["lo"]) / (points - 1)
    values = df.where(x.isNotNull()).select(x.alias("x"), F.lit(1).alias("w"))
    if r["d"] * 10 < r["n"]:
        values = values.groupBy("x").agg(F.count("*").alias("w"))
    norm = 1.0 / (r["n"] * h * (2.0 * 3.141592653589793) ** 0.5)
    spots = [lo + step * i for i in range(points - 1)] + [r["hi"]]
    z = (F.col("at") - F.col("x")) / F.lit(h)
    return (
        values.select("x", "w", F.posexplode(F.array(*map(F.lit, spots))).alias("point", "at"))
        .groupBy("point", "at")
        .agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
        .select(
            "point", F.round("at", 6).alias("x"), F.round(F.col("s") * F.lit(norm), 8).alias("density")
        )
    )


def kde_on_bins(bins: DataFrame, kde: DataFrame) -> DataFrame:
    """Density of the grid point nearest to each bin midpoint (the lower one on a tie).

    The grid has at most a few hundred points by construction and travels as one array.
    """
    grid = kde.agg(F.sort_array(F.collect_list(F.struct("point", "x", "density"))).alias("grid"))
    nearest = F.array_min(
        F.transform(
            "grid",
            lambda g: F.struct(
                F.abs(g["x"] - F.col("midpoint")).alias("gap"), g["point"].alias("p"), g["density"].alias("d")
            ),
        )
    )
    return bins.crossJoin(F.broadcast(grid)).select(  # one row holding the grid
        *[ref(c) for c in bins.columns], nearest["d"].alias("density")
    )


def fences(df: DataFrame, cols: list[str], facts: dict[str, dict] | None = None) -> dict[str, dict[str, float]]:
    """Quartiles and 1.5 IQR fences per column with values."""
    found = percentiles(df, cols, QUARTILES, facts)
    return {c: _fence(q) for c, q in found.items() if q[0] is not None}


def _fence(quartiles: list[float]) -> dict[str, float]:
    q1, q2, q3 = quartiles
    return {"q1": q1, "median": q2, "q3": q3, "lo": q1 - FENCE * (q3 - q1), "hi": q3 + FENCE * (q3 - q1)}


def _fence_brackets(pairs: list) -> list[tuple[float, float]]:
    """Where the fences can lie, given that the quartiles lie within ``pairs``."""
    (a, b), _, (c, d) = pairs
    low = (a - FENCE * (d - a), b - FENCE * (c - b))
    high = (c + FENCE * (c - b), d + FENCE * (d - a))
    return [p for p in (low, high) if p[0] <= p[1]]


def _beyond_fences(df: DataFrame, facts: dict[str, dict], flags: dict[str, Callable] | None = None) -> dict[str, dict]:
    """Per column of ``facts``, given at QUARTILES: quartiles, fences, values beyond them, the last values inside and
    the rows flagged, all from one scan: the values near quartiles and fences, and counts of those between.
    """
    cols = [c for c in facts if facts[c]["n"]]
    if not cols:
        return {}
    doubles = df.select(*[as_double(df, c).alias(c) for c in cols])
    near = {c: brackets_of(facts[c]["sketch"]) for c in cols}
    brackets = {c: near[c] + _fence_brackets(facts[c]["sketch"]) for c in cols}
    with Cells(doubles, brackets, flags) as cells:
        wanted = {c: ranks_around(facts[c]["n"], QUARTILES) for c in cols}
        at, outside = cells.at(wanted)
        if outside:  # the sketch missed a rank
            sizes = {c: facts[c]["n"] for c in outside}
            at |= order_statistics(doubles, {c: wanted[c] for c in outside}, sizes, {c: outside[c] for c in outside})
        out = {c: _fence(interpolated(at[c], facts[c]["n"], QUARTILES)) for c in cols}
        limits = df.sparkSession.createDataFrame([(i, out[c]["lo"], out[c]["hi"]) for i, c in enumerate(cols)], "i int, lo double, hi double")
        rows = cells.table.join(F.broadcast(limits), "i").groupBy("i").agg(  # a row per column
            F.coalesce(F.sum(F.when((F.col("high") < F.col("lo")) | (F.col("low") > F.col("hi")), F.col("n"))), F.lit(0)).alias("beyond"),
            F.min(F.when(F.col("low") >= F.col("lo"), F.col("low"))).alias("least"),
            F.max(F.when(F.col("high") <= F.col("hi"), F.col("high"))).alias("most"),
            F.max(((F.col("low") < F.col("lo")) & (F.col("high") >= F.col("lo"))) | ((F.col("low") <= F.col("hi")) & (F.col("high") > F.col("hi")))).alias("cut"),
            F.sum("flagged").alias("flagged"),
        )
        for r in rows.collect():
            out[cols[r["i"]]] |= {k: r[k] for k in ("beyond", "least", "most", "flagged", "cut")}
    _recount(doubles, {c: f for c, f in out.items() if f.pop("cut")})
    return out


def _recount(doubles: DataFrame, of: dict[str, dict]) -> None:
    """Count directly where a fence fell between the values listed."""
    if not of:
        return
    row = doubles.agg(*[
        F.struct(
            F.count_if((ref(c) < f["lo"]) | (ref(c) > f["hi"])).alias("beyond"),
            F.min(F.when(ref(c) >= f["lo"], ref(c))).alias("least"),
            F.max(F.when(ref(c) <= f["hi"], ref(c))).alias("most"),
        ).alias(f"c{i}")
        for i, (c, f) in enumerate(of.items())
    ]).first()
    for f, found in zip(of.values(), row):
        f |= found.asDict()


BOX = "column string, min double, q1 double, median double, q3 double, max double"


def box_stats(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """(column, min, q1, median, q3, max): whiskers end at the last values inside the fences.

    Two scans for all columns. Columns without values have no row.
    """
    cols = [cols] if isinstance(cols, str) else cols
    found = _beyond_fences(df, column_facts(df, cols, QUARTILES))
    rows = []
    for c, f in found.items():
        low = f["q1"] if f["least"] is None or f["least"] > f["hi"] else f["least"]
        high = f["q3"] if f["most"] is None or f["most"] < f["lo"] else f["most"]
        rows.append((c, low, f["q1"], f["median"], f["q3"], high))
    out = df.sparkSession.createDataFrame(rows, BOX)
    return out.select("column", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def box_outliers(df: DataFrame, c: str) -> DataFrame:
    """Values beyond the fences; above 100 of them, the 50 lowest and the 50 highest."""
    f = fences(df, [c])[c]
    x = as_double(df, c)
    out = df.select(x.alias("value")).where((F.col("value") < f["lo"]) | (F.col("value") > f["hi"]))
    out = out.select(F.round("value", 6).alias("value"))
    half = OUTLIERS_SHOWN // 2
    if out.limit(OUTLIERS_SHOWN + 1).count() <= OUTLIERS_SHOWN:
        return out.orderBy("value")
    low = out.orderBy("value").limit(half)
    high = out.orderBy(F.desc("value")).limit(half)
    return low.unionByName(high).orderBy("value")


def cdf(bins: DataFrame, order: str, label: str) -> DataFrame:
    """Running share of the counts over the (at most 20) bins, in percent."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    return bins.select(
        ref(label).alias("label"),
        F.round(ratio(F.sum("count").over(upto) * 100.0, F.sum("count").over(whole)), 2).alias(
            "cumulative_pct"
        ),
    )


# --- outliers --------------------------------------------------------------------------------


def _z_bounds(df: DataFrame, cols: list[str]) -> dict:
    return df.agg(
        *[
            F.struct(
                F.count(as_double(df, c)).alias("n"),
                F.avg(as_double(df, c)).alias("m"),
                F.stddev_pop(as_double(df, c)).alias("s"),
            ).alias(c)
            for c in cols
        ]
    ).first().asDict()


def _z_outlier(x: Column, m: float, s: float) -> Column:
    if not s:
        return F.lit(False)
    return F.abs((x - F.lit(m)) / F.lit(s)) > Z_LIMIT


OUTLIERS = "column string, z_score_count bigint, iqr_count bigint, z_score_pct double, iqr_pct double, n_valid bigint"


def outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, z_score_count, iqr_count, z_score_pct, iqr_pct, n_valid) for columns of 4 values up: two scans."""
    cols = [c for c in (cols or df.columns) if c in number_columns(df)]
    facts = column_facts(df, cols, QUARTILES, m=F.avg, s=F.stddev_pop, rows=lambda x: F.count("*")) if cols else {}
    facts = {c: f for c, f in facts.items() if f["n"] >= MIN_VALUES}
    flags = {c: lambda x, f=f: _z_outlier(x, f["m"], f["s"]) for c, f in facts.items()}
    rows = []
    for c, f in _beyond_fences(df, facts, flags).items():
        n, all_rows = facts[c]["n"], facts[c]["rows"]
        rows.append((c, f["flagged"], f["beyond"], f["flagged"] * 100.0 / all_rows, f["beyond"] * 100.0 / all_rows, n))
    out = df.sparkSession.createDataFrame(rows, OUTLIERS)
    shares = {c: F.round(c, 2) for c in ("z_score_pct", "iqr_pct")}
    return out.withColumns(shares)


def outliers_zscore(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Values further than 3 population standard deviations from the mean; no quartiles needed."""
    cols = [c for c in (cols or df.columns) if c in number_columns(df)]
    z = _z_bounds(df, cols)
    rows = []
    for c in [c for c in cols if z[c]["n"] >= MIN_VALUES]:
        far = F.count_if(_z_outlier(as_double(df, c), z[c]["m"], z[c]["s"]))
        rows.append(
            {
                "column": F.lit(c),
                "z_score_count": far,
                "z_score_pct": percent(far, F.count("*")),
                "n_valid": F.count(as_double(df, c)),
            }
        )
    return rows_of(df, rows)


def outliers_iqr(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return outliers(df, cols).select("column", "iqr_count", "iqr_pct", "n_valid")


def outliers_present(report: DataFrame) -> DataFrame:
    return report.where("z_score_count > 0 or iqr_count > 0")


def fence_rows(df: DataFrame, cols: list[str], method: str = "iqr") -> DataFrame:
    """Flag each row per column: is the value an outlier by the chosen method?"""
    require_columns(df, cols)
    if method == "iqr":
        f = fences(df, cols)
        flags = {
            c: (as_double(df, c) < F.lit(f[c]["lo"])) | (as_double(df, c) > F.lit(f[c]["hi"]))
            for c in f
        }
    elif method == "zscore":
        z = _z_bounds(df, cols)
        flags = {c: _z_outlier(as_double(df, c), z[c]["m"], z[c]["s"]) for c in cols}
    else:
        raise ValueError("method must be 'iqr' or 'zscore'")
    return df.select(
        "*", *[F.coalesce(e, F.lit(False)).alias(f"{c}_outlier") for c, e in flags.items()]
    )
