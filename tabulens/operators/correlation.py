"""Feature preparation and the three correlation matrices."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import (
    as_double,
    dtype_of,
    is_numeric,
    number_columns,
    ref,
    require_columns,
)
from tabulens.functions.comoments import Moments, comoments
from tabulens.operators import ranks
from tabulens.operators.engineer import attach_codes, label_tables
from tabulens.operators.ranks import avg_rank, by_row, distinct_sizes, medians, ranked_long

RANK_BUCKET_BITS = 21  # a block of the Kendall count has about 2**21 rows
LEAST_EDGES, MOST_EDGES = 64, 1000  # values that the blocks of a column end at


def encoded(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns as doubles, text by its label code; missing numbers stay missing."""
    texts = [c for c in cols if not is_numeric(dtype_of(df, c))]
    out = df.select(*[ref(c) for c in cols])
    if texts:
        table, facts = label_tables(df, texts)
        out = attach_codes(out, texts, table, facts, {c: f"_code_{c}" for c in texts})
    return out.select(*[(ref(f"_code_{c}").cast("double") if c in texts else as_double(df, c)).alias(c) for c in cols])


def encode_and_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns as doubles: text by its label code, numbers with missing values at the median."""
    mids = medians(df, with_gaps(df, [c for c in cols if is_numeric(dtype_of(df, c))]))
    filled = lambda c: F.coalesce(ref(c), F.lit(mids[c]).cast("double")) if c in mids else ref(c)
    return encoded(df, cols).select(*[filled(c).alias(c) for c in cols])


def filled_moments(df: DataFrame, cols: list[str]) -> Moments:
    """Moments of ``encode_and_fill`` in one scan; further ones only for the medians of columns with gaps."""
    found = comoments(encoded(df, cols), cols)
    gaps = [c for c, n in zip(cols, found.gaps()) if n]
    mids = medians(df, gaps)
    return found.filled(np.array([np.nan if mids.get(c, 0.0) is None else mids.get(c, 0.0) for c in cols], float))


def with_gaps(df: DataFrame, cols: list[str]) -> list[str]:
    """Those of ``cols`` that miss a value somewhere; only they need a median."""
    if not cols:
        return []
    row = df.agg(*[F.max(as_double(df, c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def prepare_features(df: DataFrame, target: str) -> DataFrame:
    """Features and target as doubles, the target last."""
    require_columns(df, [target])
    return encode_and_fill(df, [c for c in df.columns if c != target] + [target])


def _matrix(df: DataFrame, cols: list[str], moments: Moments) -> DataFrame:
    """(x, y, value) for all ordered pairs; NULL where a column is constant, missing or infinite."""
    found = moments.correlations().round(4).tolist()
    rows = [(x, y, None if v != v else v) for x, of in zip(cols, found) for y, v in zip(cols, of)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, value double")


def corr_pearson_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(x, y, value): all pair moments in one scan; a constant column gives NULL."""
    cols = cols or number_columns(df)
    return _matrix(df, cols, filled_moments(df, cols))


def with_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each column by its average-tie rank.

    Where all columns are ranked and some have too many values to look up, all take the long form;
    the rows then come in another order.
    """
    if cols and set(cols) == set(df.columns):
        n, sizes = distinct_sizes(df, cols)
        if max(sizes.values()) > ranks.BROADCAST_ROWS:
            return by_row(ranked_long(df, cols, n), cols, F.col("below") + (F.col("equal") + 1) / 2.0, n)
    out = avg_rank(df, cols, {c: f"_rank_{c}" for c in cols})
    return out.select(
        *[ref(f"_rank_{c}").alias(c) if c in cols else ref(c) for c in df.columns]
    )


def corr_spearman_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or number_columns(df)
    ranked = with_ranks(encode_and_fill(df, cols), cols)
    return _matrix(df, cols, comoments(ranked, cols).filled(np.zeros(len(cols))))


def _block_edges(values: list[float] | None) -> list[float]:
    """Edges of the blocks of a column: every value is a block of its own, and between two lies an open one."""
    ends = {e for v in values or () for e in (v, float(np.nextafter(v, ranks.INF))) if abs(e) < ranks.INF}
    return [-ranks.INF, *sorted(ends), ranks.INF]


def _blocks(doubles: DataFrame, cols: list[str]) -> tuple[DataFrame, list[np.ndarray], list[bool]]:
    """Columns v0, v1, ... with their blocks b0, b1, ... in order of value; which blocks hold one value only
    (a mask per column); and which columns have more than one value.

    Blocks end at sketched quantiles, so an open block has about 2**RANK_BUCKET_BITS rows (more where
    MOST_EDGES of them do not suffice), and a value of more rows than that is a block of its own.
    """
    zero = lambda c: F.when(ref(c) == 0, 0.0).otherwise(ref(c))  # noqa: E731 - the two zeros are equal
    wide = doubles.select(*[zero(c).alias(f"v{i}") for i, c in enumerate(cols)])
    n = min(max(wide.count() >> RANK_BUCKET_BITS, LEAST_EDGES), MOST_EDGES)
    probs = F.array(*[F.lit((i + 1) / (n + 1)) for i in range(n)])
    about = [F.struct(F.percentile_approx(c, probs, ranks.ACCURACY), F.min(c) < F.max(c)) for c in wide.columns]
    found = [tuple(r) for r in wide.agg(*about).first()]
    edges = [_block_edges(values) for values, _ in found]
    cut = [i for i, of in enumerate(edges) if len(of) > 2]
    if cut:
        wide = Bucketizer(
            splitsArray=[edges[i] for i in cut],
            inputCols=[f"v{i}" for i in cut],
            outputCols=[f"b{i}" for i in cut],
            handleInvalid="keep",
        ).transform(wide)
    blocks = [(F.col(f"b{i}") if i in cut else F.lit(0)).cast("int").alias(f"b{i}") for i in range(len(cols))]
    single = [np.array([np.nextafter(a, b) == b for a, b in zip(of, of[1:])]) for of in edges]
    return wide.select(*[f"v{i}" for i in range(len(cols))], *blocks), single, [bool(varies) for _, varies in found]


def inversions(x: np.ndarray) -> int:
    """Pairs of places in decreasing order of value, by one pass for each bit of the values' ranks."""
    v = np.unique(x, return_inverse=True)[1]
    total, place = 0, np.arange(len(v))
    for bit in reversed(range(int(v.max()).bit_length() if len(v) else 0)):
        # runs of equal higher bits stand together; within one, the places of each bit keep their order
        upper, one = v >> bit + 1, v >> bit & 1
        first = np.flatnonzero(np.concatenate(([True], upper[1:] != upper[:-1])))
        sizes = np.diff(first, append=len(v))
        ones = np.cumsum(one) - one
        start, ones = np.repeat(first, sizes), ones - np.repeat(ones[first], sizes)
        total += int(ones[one == 0].sum())
        zeros = place - start - ones
        low = np.repeat(sizes - np.add.reduceat(one, first), sizes)
        moved = np.empty_like(v)
        moved[start + np.where(one == 1, low + ones, zeros)] = v
        v = moved
    return total


def _ties(*sorted_by: np.ndarray) -> int:
    """Pairs of rows equal in all of the columns, whose rows are sorted."""
    if not len(sorted_by[0]):
        return 0
    new = np.any([of[1:] != of[:-1] for of in sorted_by], axis=0)
    sizes = np.diff(np.flatnonzero(np.concatenate(([True], new))), append=len(sorted_by[0]))
    return int((sizes * (sizes - 1) // 2).sum())


def _pairs_of(n: np.ndarray) -> int:
    return sum(k * (k - 1) // 2 for k in n.ravel().tolist())


def _inside(block: pa.Table) -> pa.Table:
    """Of a block of one side of a pair: its discordant pairs of rows, those tied on x, and those tied on both sides."""
    x, y, whole = (block[c].to_numpy() for c in ("x", "y", "whole"))
    order = np.lexsort((y, x))
    x, y, whole = x[order], y[order], whole[order]
    found = {"side": [block["side"][0].as_py()], "discordant": [inversions(y)], "tied": [_ties(x)], "both": [_ties(x[whole], y[whole])]}
    return pa.table(found, pa.schema([("side", pa.int32()), *[(c, pa.int64()) for c in ("discordant", "tied", "both")]]))


def _between(single: list[np.ndarray], pairs: list[tuple[int, int]]) -> Callable[[pa.Table], pa.Table]:
    """Of the counts by blocks of one pair: its rows, the discordant pairs of rows of different blocks on both sides,
    those tied by blocks of one value, and the rows that go on to ``_inside``."""
    names = ("n", "discordant", "tied_a", "tied_b", "both", "sent")

    def count(cells: pa.Table) -> pa.Table:
        k = cells["pair"][0].as_py()
        a, b = (single[i] for i in pairs[k])
        n = np.zeros((len(a), len(b)), np.int64)
        n[cells["p"].to_numpy(), cells["q"].to_numpy()] = cells["n"].to_numpy()
        later = n.sum(0) - np.cumsum(n, 0)  # by block of b, the rows of later blocks of a
        below = np.cumsum(later, 1) - later  # of those, the rows of earlier blocks of b
        tied = [_pairs_of(m) for m in (n.sum(1)[a], n.sum(0)[b], n[np.ix_(a, b)])]
        found = [n.sum(), (n * below).sum(), *tied, n[~a].sum() + n[:, ~b].sum()]
        return pa.table({"pair": [k], **{c: [int(v)] for c, v in zip(names, found)}}, pa.schema([("pair", pa.int32()), *[(c, pa.int64()) for c in names]]))

    return count


def _pair_counts(blocks: DataFrame, single: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """(rows, discordant, tied on a, tied on b, tied on both) of every pair (a, b) of columns; the last four in pairs of rows.

    Two rows of different blocks on both sides are discordant or not by their blocks, so counts by pairs of
    blocks tell. Rows of one block of a, and those of one block of b and different blocks of a, are counted by
    the task that has the block: a row goes through the shuffle twice at most, whatever the number of rows.
    Rows of a block of one value are tied on that side and do not go there, so no task has a hot value.
    """
    known = [F.col(f"v{a}").isNotNull() & F.col(f"v{b}").isNotNull() for a, b in pairs]
    cell = [
        F.when(ok, F.struct(F.lit(k).alias("pair"), F.col(f"b{a}").alias("p"), F.col(f"b{b}").alias("q")))
        for k, ((a, b), ok) in enumerate(zip(pairs, known))
    ]
    cells = blocks.select(F.inline(F.array(*cell))).where("pair is not null").groupBy("pair", "p", "q").agg(F.count("*").alias("n"))
    schema = "pair int, n bigint, discordant bigint, tied_a bigint, tied_b bigint, both bigint, sent bigint"
    found = {r["pair"]: list(r[1:]) for r in cells.groupBy("pair").applyInArrow(_between(single, pairs), schema).collect()}
    found = [found.get(k, [0] * 6) for k in range(len(pairs))]
    sent = sum(of.pop() for of in found)
    if sent:
        at = [of.nonzero()[0].tolist() for of in single]
        blocks = blocks.select("*", *[(F.col(f"b{i}").isin(of) if of else F.lit(False)).alias(f"s{i}") for i, of in enumerate(at)])
        alone = [F.col(f"s{i}") for i in range(len(single))]
        sides = []
        for k, ((a, b), ok) in enumerate(zip(pairs, known)):
            for side, i, y, whole in ((2 * k, a, F.col(f"v{b}"), F.lit(True)), (2 * k + 1, b, F.col(f"b{a}").cast("double"), alone[a])):
                to = (F.lit(side).alias("side"), F.col(f"b{i}").alias("block"), F.col(f"v{i}").alias("x"), y.alias("y"), whole.alias("whole"))
                sides.append(F.when(ok & ~alone[i], F.struct(*to)))
        parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent >> RANK_BUCKET_BITS))
        rows = blocks.select(F.inline(F.array(*sides))).where("side is not null").repartition(parts, "side", "block")
        inside = rows.groupBy("side", "block").applyInArrow(_inside, "side int, discordant bigint, tied bigint, both bigint")
        total = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("discordant", "tied", "both")]
        for side, discordant, tied, both in inside.groupBy("side").agg(*total).collect():
            of = found[side // 2]
            of[1] += int(discordant)
            of[2 + side % 2] += int(tied)
            of[4] += int(both)
    return [tuple(of) for of in found]


def corr_kendall_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Kendall's tau-b, exact at any size; all pairs of columns go through one shuffle."""
    cols = cols or number_columns(df)
    blocks, single, varies = _blocks(encode_and_fill(df, cols), cols)
    rows = [(c, c, 1.0 if more else None) for c, more in zip(cols, varies)]
    pairs = list(combinations(range(len(cols)), 2))
    for (a, b), (n, discordant, *ties, both) in zip(pairs, _pair_counts(blocks, single, pairs) if pairs else []):
        n0 = n * (n - 1) // 2
        spread = float(n0 - ties[0]) * float(n0 - ties[1])
        # pairs of rows tied on neither side are either concordant or discordant
        untied = n0 - ties[0] - ties[1] + both
        tau = round((untied - 2 * discordant) / spread**0.5, 4) if spread else None
        rows += [(cols[a], cols[b], tau), (cols[b], cols[a], tau)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, value double")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    kinds = {
        "pearson": corr_pearson_matrix,
        "spearman": corr_spearman_matrix,
        "kendall": corr_kendall_matrix,
    }
    if method not in kinds:
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    if cols:
        require_columns(df, cols)
    return kinds[method](df, cols)


def corr_top_pairs(matrix: DataFrame, n: int = 6) -> DataFrame:
    """The n strongest pairs, each once, without the diagonal."""
    return (
        matrix.where("x < y").orderBy(F.desc_nulls_last(F.abs("value")), "x", "y").limit(n)
    )


def corr_strength(matrix: DataFrame) -> DataFrame:
    size = F.abs("value")
    label = (
        F.when(size >= 0.8, "very strong")
        .when(size >= 0.6, "strong")
        .when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak")
        .otherwise("negligible")
    )
    side = F.when(size < 0.2, "none").when(F.col("value") > 0, "positive").otherwise("negative")
    return matrix.where("value is not null").select("*", label.alias("strength"), side.alias("direction"))


# --- collinearity -----------------------------------------------------------------------------


NULL_SPACE = 1e-12  # eigenvalues and squared shares in it below this are rounding


def inflation(products: np.ndarray) -> list[float | None]:
    """Variance inflation of every column from X'X, None where the other columns determine it.

    One eigendecomposition of the scaled matrix: a column with a part in the null space is
    determined; for any other the diagonal of the pseudo-inverse is 1 / (1 - R squared).
    """
    scale = np.sqrt(np.diag(products))
    values, vectors = np.linalg.eigh(products / np.outer(scale, scale))
    null = values <= NULL_SPACE * max(values[-1], 1.0)
    determined = (vectors[:, null] ** 2).sum(1) > NULL_SPACE
    found = (vectors[:, ~null] ** 2 / values[~null]).sum(1)
    return [None if d or v * NULL_SPACE >= 1 else round(float(v), 4) for d, v in zip(determined, found)]


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, vif) without intercept: missing values first, then the largest.

    Every column is regressed on the others through X'X; one that the others determine fully
    gives NULL. Columns without spread, without values or with an infinite one are left out.
    """
    cols = [c for c in cols if c in df.columns and is_numeric(dtype_of(df, c))]
    if len(cols) < 2:
        raise ValueError("at least 2 numeric columns are required")
    moments = filled_moments(df, cols)
    kept = [i for i in range(len(cols)) if not moments.constant()[i] and np.isfinite(moments.moments[i, i])]
    if len(kept) < 2:
        raise ValueError("not enough columns with variance")
    values = inflation(moments.products()[np.ix_(kept, kept)])
    rows = df.sparkSession.createDataFrame([(cols[i], v) for i, v in zip(kept, values)], "feature string, vif double")
    return rows.orderBy(F.desc_nulls_first("vif"), "feature")


def vif_band(report: DataFrame) -> DataFrame:
    band = F.when(F.col("vif") < 5, "ok").when(F.col("vif") < 10, "warn").when(
        F.col("vif") >= 10, "high"
    )
    return report.withColumn("band", band)


def signed(value: Column) -> Column:
    return F.when(value >= 0, "positive").when(value < 0, "negative").otherwise("n/a")
