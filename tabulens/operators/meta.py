"""Preprocessing fitted on one frame and replayed on another."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import as_double, dtype_of, is_numeric, ref, require_columns, union_all
from tabulens.operators.engineer import attach_code, coerced, label_tables, label_text
from tabulens.operators.ranks import Cells, brackets_of, column_facts, interpolated, medians, order_statistics, ranks_around


MAX_CLASSES = 10_000  # of a target: more are no classification problem
WARNING = "array<struct<feature: string, kind: string, value: string, lo: double, hi: double>>"


GRID = 1000  # steps of a stored distribution


@dataclass
class Spread:
    """A numeric column's distribution: of n rows with a value, how many lie below, and up to, each of some values.

    The values are quantiles of the column, or all it has where these are few. Between two of them
    lies at most the share ``gap`` of the rows.
    """

    n: int
    values: list[float]
    below: list[int]
    upto: list[int]

    @property
    def gap(self) -> float:
        between = [b - a for a, b in zip([0, *self.upto], [*self.below, self.n])]
        return max(between) / self.n if self.n else 0.0


@dataclass
class Meta:
    """What a frame's columns looked like when the preprocessing was fitted.

    ``numbers`` has one entry per numeric column; the categories, which may be many,
    stay in a written frame (column, class, code, n).
    """

    features: list[str]
    target: str | None
    numbers: dict[str, tuple[float | None, float | None, float | None]]
    classes: DataFrame | None
    texts: list[str] = field(default_factory=list)
    target_is_text: bool = False
    target_median: float | None = None
    sizes: dict = field(default_factory=dict)  # of each column's part of ``classes``
    spreads: dict[str, Spread] = field(default_factory=dict)  # of the numeric features

    def classes_of(self, name: str) -> DataFrame:
        return self.classes.where(F.col("column") == name).select("class", "code", "n")

    def target_labels(self) -> list[str]:
        """The target's classes in code order; more than MAX_CLASSES raise."""
        found = self.classes_of(self.target).orderBy("code").limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"target '{self.target}' has more than {MAX_CLASSES} classes")
        return [r["class"] for r in found]

    def frame(self, spark) -> DataFrame:
        """(column, kind, median, lo, hi) in feature order."""
        rows = [
            (c, "text", None, None, None) if c in self.texts else (c, "numeric", *self.numbers[c])
            for c in self.features
        ]
        return spark.createDataFrame(
            rows, "column string, kind string, median double, lo double, hi double"
        )


def fit_meta(df: DataFrame, target: str | None, cols: list[str], fit_on: Column | None = None) -> Meta:
    """Medians, ranges and distributions of the numeric columns in two scans, sorted classes of the others.

    ``fit_on`` is a condition on the rows to learn from, such as those of the training side; a row for
    which it is NULL is not learned from. By default all rows are.
    """
    require_columns(df, [*cols, *([target] if target else [])])
    if fit_on is not None:
        df = df.where(fit_on)
    numeric = [c for c in cols if is_numeric(dtype_of(df, c))]
    texts = [c for c in cols if c not in numeric]
    target_text = bool(target) and not is_numeric(dtype_of(df, target))
    plus = [target] if target and not target_text else []
    mids, ranges, spreads = _distributions(df, list(dict.fromkeys([*numeric, *plus])))
    coded = [*texts, *([target] if target_text else [])]
    classes, sizes = label_tables(df, coded) if coded else (None, {})
    return Meta(
        features=list(cols),
        target=target,
        numbers={c: (mids[c], *ranges[c]) for c in numeric},
        classes=classes,
        sizes=sizes,
        texts=texts,
        target_is_text=target_text,
        target_median=mids[target] if plus else None,
        spreads={c: spreads[c] for c in numeric},
    )


def _distributions(df: DataFrame, cols: list[str]) -> tuple[dict, dict, dict[str, Spread]]:
    """(medians, (least, largest), distributions): one scan for sketches, one for the counts between their values."""
    if not cols:
        return {}, {}, {}
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    facts = column_facts(df, cols, [0.5], lo=F.min, hi=F.max, grid=lambda x: F.percentile_approx(x, steps, 10 * GRID))
    mids = dict.fromkeys(cols)
    spreads = {c: Spread(0, [], [], []) for c in cols}
    some = [c for c in cols if facts[c]["n"]]
    if some:
        doubles = df.select(*[as_double(df, c).alias(c) for c in some])
        own = {c: sorted({(float(v), float(v)) for v in facts[c]["grid"]}) for c in some}
        wanted = {c: ranks_around(facts[c]["n"], [0.5]) for c in some}
        with Cells(doubles, {c: own[c] + brackets_of(facts[c]["sketch"]) for c in some}) as cells:
            totals = cells.totals()
            at, outside = cells.at(wanted)
            if outside:  # the sketch missed a rank
                at |= order_statistics(doubles, {c: wanted[c] for c in outside}, {c: facts[c]["n"] for c in outside}, {c: outside[c] for c in outside})
            for c in some:
                mids[c] = interpolated(at[c], facts[c]["n"], [0.5])[0]
                spreads[c] = Spread(facts[c]["n"], *cells.steps(c, totals))
    return mids, {c: (facts[c]["lo"], facts[c]["hi"]) for c in cols}, spreads


def fit_meta_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    return fit_meta(df, None, cols).frame(df.sparkSession)


def _number(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(None).cast("double")
    return as_double(df, c) if is_numeric(dtype_of(df, c)) else coerced(df, c)


def apply_meta(
    df: DataFrame,
    meta: Meta,
    with_target: bool = False,
    keep: list[str] | None = None,
    label: str = "label",
    warn: bool = False,
    target_fill: float | None = None,
) -> DataFrame:
    """The features as doubles, in training order.

    An absent feature counts as missing; a missing number takes the training median;
    a category unknown to the training frame takes code 0. With ``with_target`` the
    encoded target is added as ``label``; a missing number there takes ``target_fill``, by
    default the training median. With ``warn`` the row's warnings (WARNING) are added as
    ``_warnings``: numbers outside the training range and categories it did not have.
    """
    keep = keep or []
    if with_target and label in meta.features:
        raise ValueError(f"a feature is named '{label}': give the target column another name")
    out = df
    for c in meta.texts:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(T.StringType()))
        out = attach_code(out, c, meta.classes_of(c), f"_code_{c}", meta.sizes.get(c))
    exprs = []
    for c in meta.features:
        if c in meta.texts:
            e = F.coalesce(ref(f"_code_{c}"), F.lit(0)).cast("double")
        else:
            mid = meta.numbers.get(c, (None,))[0]
            e = F.coalesce(_number(df, c), F.lit(0.0 if mid is None else mid))
        exprs.append(e.alias(c))
    if with_target:
        if meta.target_is_text:
            out = attach_code(
                out, meta.target, meta.classes_of(meta.target), "_label", meta.sizes.get(meta.target)
            )
            target = F.coalesce(F.col("_label"), F.lit(0)).cast("double")
        else:
            mid = meta.target_median if target_fill is None else target_fill
            target = F.coalesce(_number(df, meta.target), F.lit(0.0 if mid is None else mid))
        exprs.append(target.alias(label))
    if warn:
        unseen = [
            F.when(ref(f"_code_{c}").isNull(), _warning(c, "unseen", label_text(df, c)))
            for c in meta.texts
            if c in df.columns
        ]
        exprs.append(F.concat(range_warnings(df, meta), _listed(unseen)).alias("_warnings"))
    return out.select(*[ref(k).alias(f"_keep_{k}") for k in keep], *exprs)


def target_fill(df: DataFrame, meta: Meta) -> float | None:
    """What a missing numeric target of an evaluated frame takes: the median of that frame."""
    if meta.target_is_text or meta.target not in df.columns:
        return None
    return medians(df.select(_number(df, meta.target).alias("target")), ["target"])["target"]


def missing_features(df: DataFrame, meta: Meta) -> list[str]:
    return [c for c in meta.features if c not in df.columns]


def unseen_categories(df: DataFrame, meta: Meta) -> DataFrame:
    """(column, value, n): categories of ``df`` that the training frame did not have."""
    found = []
    for c in [c for c in meta.texts if c in df.columns]:
        values = df.select(label_text(df, c).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
        found.append(
            values.join(meta.classes_of(c).select("class"), "class", "left_anti").select(
                F.lit(c).alias("column"), F.col("class").alias("value"), "n"
            )
        )
    if not found:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    return union_all(found)


def outside(df: DataFrame, meta: Meta) -> dict[str, Column]:
    """Per numeric feature present: is the raw value outside the training range?"""
    flags = {}
    for c, (_, lo, hi) in meta.numbers.items():
        if c in df.columns and lo is not None:
            x = _number(df, c)
            flags[c] = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
    return flags


def extrapolation_flags(df: DataFrame, meta: Meta) -> DataFrame:
    """Each row with the list of features whose value lies outside the training range."""
    named = [F.when(flag, F.lit(c)) for c, flag in outside(df, meta).items()]
    return df.select("*", F.array_compact(F.array(*named)).alias("outside_range"))


def _warning(feature: str, kind: str, value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    number = lambda x: F.lit(x).cast("double")
    return F.struct(
        F.lit(feature).alias("feature"), F.lit(kind).alias("kind"), value.alias("value"),
        number(lo).alias("lo"), number(hi).alias("hi"),
    )


def _listed(warnings: list[Column]) -> Column:
    return F.array_compact(F.array(*warnings)).cast(WARNING) if warnings else F.array().cast(WARNING)


def range_warnings(df: DataFrame, meta: Meta) -> Column:
    """The row's numbers outside the training range, with that range."""
    return _listed([
        F.when(flag, _warning(c, "range", ref(c).cast("string"), *map(float, meta.numbers[c][1:])))
        for c, flag in outside(df, meta).items()
    ])
