"""Derived columns: arithmetic on pairs, single-column transforms, label codes."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import as_double, dtype_of, is_numeric, present, ref
from tabulens.functions.moments import ratio
from tabulens.operators.ranks import lookup, medians, ordered_values, percentiles

# Signs in default names, the label of a missing category, default limits.
SIGNS = {"add": "+", "subtract": "−", "multiply": "×", "divide": "÷"}
MISSING_LABEL = "__MISSING__"
CLIP_DEFAULT = (1.0, 99.0)
BINS_ALLOWED = (2, 20)


def _append(df: DataFrame, name: str, value: Column) -> DataFrame:
    name = name.strip()
    if not name:
        raise ValueError("the new name must not be empty")
    if name in df.columns:
        raise ValueError(f"column '{name}' already exists")
    return df.withColumn(name, value)


def _pair(df: DataFrame, operation: str, a: str, b: str, name: str | None) -> DataFrame:
    for c in (a, b):
        if not is_numeric(dtype_of(df, c)):
            raise ValueError(f"column '{c}' must be numeric")
    x, y = present(df, a), present(df, b)
    value = {
        "add": lambda: x + y,
        "subtract": lambda: x - y,
        "multiply": lambda: x * y,
        "divide": lambda: ratio(as_double(df, a), as_double(df, b)),
    }[operation]()
    return _append(df, name or f"{a}_{SIGNS[operation]}_{b}", value)


def eng_add(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    return _pair(df, "add", a, b, name)


def eng_subtract(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    return _pair(df, "subtract", a, b, name)


def eng_multiply(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    return _pair(df, "multiply", a, b, name)


def eng_divide(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """A zero divisor gives a missing value."""
    return _pair(df, "divide", a, b, name)


def _require_non_negative(df: DataFrame, c: str) -> None:
    low = df.agg(F.min(as_double(df, c)).alias("m")).first()["m"]
    if low is not None and low < 0:
        raise ValueError(f"column '{c}' holds negative values")


def tx_log1p(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    _require_non_negative(df, c)
    return _append(df, name or f"{c}_log1p", F.log1p(as_double(df, c)))


def tx_sqrt(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    _require_non_negative(df, c)
    return _append(df, name or f"{c}_sqrt", F.sqrt(as_double(df, c)))


def tx_square(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    x = as_double(df, c)
    return _append(df, name or f"{c}_sq", x * x)


def tx_reciprocal(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    return _append(df, name or f"{c}_inv", ratio(F.lit(1.0), as_double(df, c)))


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """The Yeo-Johnson power transform for a given lambda."""
    lam = F.lit(lam) if isinstance(lam, int | float) else lam
    near = lambda c: F.abs(c) < 1e-12
    other = F.lit(2.0) - lam
    up = F.when(near(lam), F.log1p(x)).otherwise(F.try_divide(F.pow(x + 1, lam) - 1, lam))
    down = F.when(near(other), -F.log1p(-x)).otherwise(
        -F.try_divide(F.pow(1 - x, other) - 1, other)
    )
    return F.when(x >= 0, up).when(x < 0, down)


def fit_yeo_johnson(df: DataFrame, c: str, rounds: int = 4) -> float:
    """Lambda of maximum likelihood on the median-filled column.

    Every round evaluates 21 candidates in one scan (rows repeat per candidate and are
    reduced to 21 groups before any shuffle) and narrows tenfold around the best one; a
    parabola through the last three gives the final value.
    """
    mid = medians(df, [c])[c]
    if mid is None:
        raise ValueError(f"column '{c}' has no values")
    x = df.select(F.coalesce(as_double(df, c), F.lit(mid)).alias("x"))
    slope = F.sum(F.signum("x") * F.log1p(F.abs("x")))
    centre, step = 1.0, 0.5
    for turn in range(rounds):
        grid = [centre + step * i for i in range(-10, 11)]
        tried = (
            x.select("x", F.explode(F.array(*map(F.lit, grid))).alias("lam"))
            .groupBy("lam")
            .agg(
                F.count("*").alias("n"),
                slope.alias("s"),
                F.var_pop(yeo_johnson(F.col("x"), F.col("lam"))).alias("v"),
            )
            .orderBy("lam")
            .collect()
        )
        fit = [
            -r["n"] / 2.0 * math.log(r["v"]) + (r["lam"] - 1.0) * r["s"]
            if r["v"] and math.isfinite(r["v"]) and r["v"] > 0
            else -math.inf
            for r in tried
        ]
        best = max(range(len(fit)), key=lambda i: fit[i])
        centre = tried[best]["lam"]
        inner = 0 < best < len(fit) - 1
        if inner and turn == rounds - 1:
            a, b, d = fit[best - 1], fit[best], fit[best + 1]
            bend = a - 2 * b + d
            if math.isfinite(bend) and bend < 0:
                centre += 0.5 * (a - d) / bend * step
        if inner:
            step /= 10.0
    return centre


def tx_yeo_johnson(
    df: DataFrame, c: str, name: str | None = None, lam: float | None = None
) -> DataFrame:
    lam = fit_yeo_johnson(df, c) if lam is None else lam
    return _append(df, name or f"{c}_yj", yeo_johnson(as_double(df, c), lam))


def quantile_edges(df: DataFrame, cols: list[str], n_bins: int) -> dict[str, list[float]]:
    """Distinct percentile edges per column, lowest and highest included."""
    found = percentiles(df, cols, [i / n_bins for i in range(n_bins + 1)])
    return {c: sorted({v for v in vs if v is not None}) for c, vs in found.items()}


def edge_code(x: Column, inner: list[float]) -> Column:
    """Right-closed bin: the number of inner edges below x."""
    code = F.lit(0)
    for e in inner:
        code = code + (x > F.lit(e)).cast("int")
    return F.when(x.isNotNull(), code)


def with_codes(df: DataFrame, inner: dict[str, list[float]], new: dict[str, str]) -> DataFrame:
    """``edge_code`` of several double columns by binary search, for many edges.

    The splitter closes bins on the left, so each edge moves to the next double.
    """
    cols = [c for c in inner if inner[c]]
    out = df
    if cols:
        names = {c: f"_in{i}" for i, c in enumerate(cols)}
        out = Bucketizer(
            splitsArray=[[-math.inf, *(math.nextafter(e, math.inf) for e in inner[c]), math.inf] for c in cols],
            inputCols=[names[c] for c in cols],
            outputCols=[f"_out{i}" for i in range(len(cols))],
            handleInvalid="keep",
        ).transform(df.select("*", *[ref(c).alias(n) for c, n in names.items()]))
    at = {c: F.col(f"_out{i}").cast("int") for i, c in enumerate(cols)}
    codes = [F.when(ref(c).isNotNull(), at.get(c, F.lit(0))).alias(new[c]) for c in inner]
    return out.select(*[ref(c) for c in df.columns], *codes)


def _check_bins(n_bins: int) -> None:
    if not BINS_ALLOWED[0] <= n_bins <= BINS_ALLOWED[1]:
        raise ValueError("n_bins must be between 2 and 20")


def tx_quantile_bin(df: DataFrame, c: str, n_bins: int = 5, name: str | None = None) -> DataFrame:
    """Equal-frequency bins with right-closed edges; equal edges merge, a constant gives NULL."""
    _check_bins(n_bins)
    edges = quantile_edges(df, [c], n_bins)[c]
    x = as_double(df, c)
    code = edge_code(x, edges[1:-1]) if len(edges) > 1 else F.lit(None).cast("int")
    return _append(df, name or f"{c}_bin{n_bins}", code)


def tx_width_bin(df: DataFrame, c: str, n_bins: int = 5, name: str | None = None) -> DataFrame:
    """Equal-width bins with right-closed edges, the lowest value included."""
    _check_bins(n_bins)
    x = as_double(df, c)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return _append(df, name or f"{c}_bin{n_bins}", F.lit(None).cast("int"))
    if lo == hi:  # a constant is widened by a thousandth on both sides
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
    inner = [lo + (hi - lo) * i / n_bins for i in range(1, n_bins)]
    return _append(df, name or f"{c}_bin{n_bins}", edge_code(x, inner))


def tx_clip(
    df: DataFrame,
    c: str,
    lo: float = CLIP_DEFAULT[0],
    hi: float = CLIP_DEFAULT[1],
    name: str | None = None,
) -> DataFrame:
    """Clip to the given percentiles; missing values stay missing."""
    if not 0 <= lo < hi <= 100:
        raise ValueError("clip bounds must satisfy 0 <= lo < hi <= 100")
    low, high = percentiles(df, [c], [lo / 100.0, hi / 100.0])[c]
    x = as_double(df, c)
    value = F.when(x < F.lit(low), F.lit(low)).when(x > F.lit(high), F.lit(high)).otherwise(x)
    return _append(df, name or f"{c}_clipped", value)


def tx_polynomial(df: DataFrame, cols: list[str]) -> DataFrame:
    """Squares of all columns and products of all pairs, skipping names already there."""
    if len(cols) < 2:
        raise ValueError("polynomial features need at least 2 columns")
    x = {c: as_double(df, c) for c in cols}
    new = {f"{c}_sq": x[c] * x[c] for c in cols}
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            new[f"{a}_x_{b}"] = x[a] * x[b]
    return df.select("*", *[v.alias(k) for k, v in new.items() if k not in df.columns])


# --- label codes ---------------------------------------------------------------------------


def label_text(df: DataFrame, name: str) -> Column:
    """The category as text, missing values as their own label."""
    return F.coalesce(present(df, name).cast("string"), F.lit(MISSING_LABEL))


def label_tables(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """(column, class, code, n) for the categories of all ``cols``, in one pass, and their sizes."""
    long = df.select(*[label_text(df, c).alias(c) for c in cols]).unpivot(
        [], [ref(c) for c in cols], "column", "class"
    )
    counts = long.groupBy("column", "class").agg(F.count("*").alias("n"))
    table, facts = ordered_values(counts, "class", dense="code")
    return table.select("column", "class", "code", "n"), facts


def label_classes(df: DataFrame, name: str) -> DataFrame:
    """(class, code, n): every category in sorted order with its code and row count."""
    return label_tables(df, [name])[0].select("class", "code", "n")


def attach_code(
    df: DataFrame, name: str, classes: DataFrame, new: str, facts: dict | None = None
) -> DataFrame:
    return lookup(df, label_text(df, name), classes, "class", "code", new, "n", facts)


def attach_codes(
    df: DataFrame, cols: list[str], table: DataFrame, facts: dict, new: dict[str, str]
) -> DataFrame:
    out = df
    for c in cols:
        out = attach_code(out, c, table.where(F.col("column") == c), new[c], facts.get(c))
    return out


def label_encode(df: DataFrame, name: str, new: str | None = None) -> DataFrame:
    table, facts = label_tables(df, [name])
    return attach_codes(df, [name], table, facts, {name: new or f"{name}_code"})


def label_decode(df: DataFrame, code: str, classes: DataFrame, new: str | None = None) -> DataFrame:
    """Codes back to categories."""
    return lookup(df, ref(code), classes, "code", "class", new or f"{code}_label", "n")


def to_numeric_coerce(df: DataFrame, name: str, fallback: float | None = None) -> DataFrame:
    """Text to number; what does not parse takes the fallback (0 when none is known)."""
    value = F.lit(0.0 if fallback is None else float(fallback))
    return df.select(
        *[
            F.coalesce(coerced(df, c), value).alias(c) if c == name else ref(c)
            for c in df.columns
        ]
    )


def coerced(df: DataFrame, name: str) -> Column:
    x = F.trim(ref(name).cast("string")).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))
