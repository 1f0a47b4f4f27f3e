"""Exact order statistics and ranks that never put raw rows into one task.

Four building blocks carry the rest of the package:

* ``percentiles``: exact interpolated percentiles of many columns in two scans. A quantile
  sketch brackets each wanted rank; the second scan counts the rows between brackets and
  lists the distinct values inside, and only these are ever sorted.
* ``running_totals``: exact running sums over ordered distinct values, by range
  partitioning, per-partition totals and an offset per partition.
* ``ranked_long``: ranks of columns with too many values for a lookup, by a range shuffle of
  (row, column, value) and a second one back to the rows, whatever the number of columns.
* ``lookup``: a join to a table with one row per key that spreads the hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import as_double, ref
from tabulens.session import settle, settled, written

ACCURACY = 10000  # of the quantile sketch
SORT_LIMIT = 200_000  # values of one bracket that one task may sort
BROADCAST_ROWS = 200_000  # rows of a lookup table that may be broadcast
BROADCAST_BYTES = 32 * 1024 * 1024  # and its size
HOT_SHARE = 1000  # a key above 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE
TASK_ROWS = 4_000_000  # values that one task ranks
INF = float("inf")


# --- order statistics -------------------------------------------------------------------


def _around(p: float, accuracy: int) -> tuple[float, float]:
    """Probabilities whose sketched values lie below and above the exact one at ``p``."""
    slack = 2.0 / accuracy
    return max(p - slack, 0.0), min(p + slack, 1.0)


def sketch(x: Column, probs: list[float], accuracy: int | None = None) -> Column:
    """A (low, high) pair of approximate values around each probability, from one mergeable quantile sketch."""
    accuracy = accuracy or ACCURACY
    around = [_around(p, accuracy) for p in probs]
    asked = sorted({q for pair in around for q in pair})
    at = {q: i for i, q in enumerate(asked)}
    found = F.percentile_approx(x, F.array(*map(F.lit, asked)), accuracy)
    return F.array(*[F.array(found[at[lo]], found[at[hi]]) for lo, hi in around])


def column_facts(df: DataFrame, cols: list[str], probs: list[float], **aggregates) -> dict[str, dict]:
    """One scan over all columns in long form: per column ``n``, ``sketch`` at ``probs``, and each of
    ``aggregates``, a function of the column of values. A column without values has n 0."""
    x = F.col("x")
    long = df.select(*[as_double(df, c).alias(c) for c in cols]).unpivot([], [ref(c) for c in cols], "column", "x")
    every = {"n": F.count(x), "sketch": sketch(x, probs), **{k: f(x) for k, f in aggregates.items()}}
    found = {r["column"]: r.asDict() for r in long.groupBy("column").agg(*[e.alias(k) for k, e in every.items()]).collect()}
    return {c: found.get(c, dict.fromkeys(every) | {"n": 0}) for c in cols}


class Cells:
    """Counts of the values of several columns between edges, with all distinct values inside brackets.

    ``brackets`` holds (low, high) pairs per column. Every pair's ends are edges, and so are the numbers
    next above them, so a value that fills a third of all rows has a cell of its own. One scan gives a
    row (i, cell, value, n, low, high) per distinct value inside a bracket and one per other cell, where
    ``value`` is NULL; ``flags`` adds ``flagged``, the rows of it for which a column's flag holds. The
    rows are written once, in the shared folder, and deleted on leaving the context.
    """

    def __init__(self, doubles: DataFrame, brackets: dict[str, list[tuple[float, float]]], flags: dict[str, Column] | None = None):
        self.cols, self.edges, kept = list(brackets), [], []
        for pairs in brackets.values():
            ends = {e for pair in pairs for b in pair for e in (b, float(np.nextafter(b, INF))) if abs(e) < INF}
            edges = [-INF, *sorted(ends), INF]
            self.edges.append(edges)
            kept.append([j for j, (a, b) in enumerate(zip(edges, edges[1:])) if np.nextafter(a, INF) < b and any(lo <= a and b <= np.nextafter(hi, INF) for lo, hi in pairs)])
        self.kept = kept
        self.flags = flags or {}
        self._written = written(self._counted(doubles), "cells")

    def __enter__(self) -> Cells:
        self.table = self._written.__enter__()
        return self

    def __exit__(self, *error) -> None:
        self._written.__exit__(*error)

    def _counted(self, doubles: DataFrame) -> DataFrame:
        wide = doubles.select(*[ref(c).alias(f"v{i}") for i, c in enumerate(self.cols)])
        cut = [i for i, edges in enumerate(self.edges) if len(edges) > 2]
        if cut:
            wide = Bucketizer(
                splitsArray=[self.edges[i] for i in cut],
                inputCols=[f"v{i}" for i in cut],
                outputCols=[f"b{i}" for i in cut],
                handleInvalid="keep",
            ).transform(wide)
        parts = []
        for i, c in enumerate(self.cols):
            x = F.col(f"v{i}")
            cell = F.col(f"b{i}").cast("int") if i in cut else F.lit(0)
            inside = F.when(cell.isin(self.kept[i]), x) if self.kept[i] else F.lit(None).cast("double")
            parts += [F.lit(i), cell, inside, x, self.flags[c](x) if c in self.flags else F.lit(False)]
        long = wide.select(F.stack(F.lit(len(self.cols)), *parts).alias("i", "cell", "value", "x", "flag")).where("x is not null")
        return long.groupBy("i", "cell", "value").agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_if("flag").alias("flagged")
        )

    def totals(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rows, distinct values listed) of every (i, cell) that has any: columns x edges at most."""
        rows = self.table.groupBy("i", "cell").agg(F.sum("n").alias("n"), F.count("value").alias("values")).collect()
        return {(r["i"], r["cell"]): (r["n"], r["values"]) for r in rows}

    def steps(self, c: str, totals: dict) -> tuple[list[float], list[int], list[int]]:
        """The finite edges that are values of their own, and the rows below and up to each."""
        i, before = self.cols.index(c), 0
        values, below, upto = [], [], []
        for cell, (a, b) in enumerate(zip(self.edges[i], self.edges[i][1:])):
            n = totals.get((i, cell), (0, 0))[0]
            if np.nextafter(a, INF) == b:
                values.append(a)
                below.append(before)
                upto.append(before + n)
            before += n
        return values, below, upto

    def at(self, wanted: dict[str, list[int]]) -> tuple[dict[str, dict[int, float]], dict[str, list[tuple[float, float]]]]:
        """Values at 0-based ranks, and the brackets to ask again for ranks that no bracket held."""
        counts = self.totals()
        found: dict[str, dict[int, float]] = {c: {} for c in wanted}
        again: dict[str, list[tuple[float, float]]] = {}
        marks, large = [], False
        for i, c in enumerate(self.cols):
            before = 0
            for cell, (a, b) in enumerate(zip(self.edges[i], self.edges[i][1:])):
                n, values = counts.get((i, cell), (0, 0))
                ks = [k for k in wanted.get(c, ()) if before <= k < before + n]
                if ks and np.nextafter(a, INF) == b:  # room for one value only
                    found[c].update({k: a for k in ks})
                elif ks and cell in self.kept[i]:
                    marks += [(i, cell, k - before, k) for k in ks]
                    large = large or values > SORT_LIMIT
                elif ks:
                    again.setdefault(c, []).append((a, b))
                before += n
        if marks:
            for r in self._hits(marks, large):
                found[self.cols[r["i"]]][r["k"]] = r["value"]
        return found, again

    def _hits(self, marks: list[tuple], large: bool) -> list:
        """The values at places within cells; cells of many distinct values are ranked by many tasks."""
        spark = self.table.sparkSession
        asked = F.broadcast(spark.createDataFrame(marks, "i int, cell int, place bigint, k bigint"))  # a row per wanted rank
        cells = F.broadcast(spark.createDataFrame(sorted({m[:2] for m in marks}), "i int, cell int"))
        values = self.table.where("value is not null").join(cells, ["i", "cell"]).select("i", "cell", "value", "n")
        if large:
            ranked = running_totals(values, [F.col("value")], {"before": "n"}, by=["i", "cell"])
        else:
            up_to = Window.partitionBy("i", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
            ranked = values.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
        hit = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        return ranked.join(asked, ["i", "cell"]).where(hit).select("i", "k", "value").collect()


def order_statistics(
    doubles: DataFrame,
    wanted: dict[str, list[int]],
    sizes: dict[str, int],
    first: dict[str, list] | None = None,
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ranks per column of a frame of doubles, in two scans.

    ``first`` may hold the ``sketch`` around each wanted rank already. The sketch brackets the ranks;
    one scan then counts the rows between brackets and lists the values inside. Should a rank lie
    outside its bracket after all, the cell that holds it is listed by a further scan.
    """
    wanted = {c: ks for c, ks in wanted.items() if ks and sizes[c]}
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    if not wanted:
        return found
    if first is None:
        exprs = [sketch(ref(c), [k / max(sizes[c] - 1, 1) for k in ks]).alias(f"s{i}") for i, (c, ks) in enumerate(wanted.items())]
        first = dict(zip(wanted, doubles.agg(*exprs).first()))
    todo = {c: brackets_of(first[c]) for c in wanted}
    while todo:
        with Cells(doubles, todo) as cells:
            values, todo = cells.at({c: [k for k in wanted[c] if k not in found[c]] for c in todo})
        for c, of in values.items():
            found[c].update(of)
    return found


def brackets_of(pairs) -> list[tuple[float, float]]:
    return sorted({(float(lo), float(hi)) for lo, hi in pairs if lo is not None})


def ranks_around(n: int, probs: list[float]) -> list[int]:
    """The 0-based ranks that percentiles of n values lie between."""
    spots = [p * (n - 1) for p in probs] if n else []
    return sorted({k for s in spots for k in (math.floor(s), math.ceil(s))})


def interpolated(at: dict[int, float], n: int, probs: list[float]) -> list[float | None]:
    if not n:
        return [None] * len(probs)
    out = []
    for p in probs:
        spot = p * (n - 1)
        a, b = at[math.floor(spot)], at[math.ceil(spot)]
        out.append(a if a == b else a + (b - a) * (spot - math.floor(spot)))
    return out


def percentiles(
    df: DataFrame, cols: list[str], probs: list[float], facts: dict[str, dict] | None = None
) -> dict[str, list[float | None]]:
    """Exact percentiles with linear interpolation between neighbours, missing values aside: two scans,
    one where the ``column_facts`` at ``probs`` are there already."""
    facts = facts or column_facts(df, cols, probs)
    sizes = {c: facts[c]["n"] for c in cols}
    wanted = {c: ranks_around(sizes[c], probs) for c in cols}
    doubles = df.select(*[as_double(df, c).alias(c) for c in cols])
    at = order_statistics(doubles, wanted, sizes, {c: facts[c]["sketch"] for c in cols})
    return {c: interpolated(at.get(c, {}), sizes[c], probs) for c in cols}


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    return {c: v[0] for c, v in percentiles(df, cols, [0.5]).items()}


# --- running totals over distinct values --------------------------------------------------


def running_totals(
    table: DataFrame,
    order: list[Column],
    sums: dict[str, str],
    by: list[str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add to each row the sum over all rows ordered before it (exclusive running sum).

    ``table`` holds one row per (by, ordering) value, so no ordering value repeats.
    ``sums`` maps new column -> summed column; ``number`` names a 0-based row number.
    Rows are range-partitioned and written once; each partition then runs its own
    window and adds the total of the partitions before it. The offsets table has one
    row per (partition, by value) and is joined on the partition id.
    """
    by = by or []
    table = table.withColumn("_one", F.lit(1).cast("bigint"))
    feeds = dict(sums)
    if number:
        feeds[number] = "_one"
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(
        table.repartitionByRange(n, *[ref(b) for b in by], *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    keys = ["_part", *by]
    totals = parts.groupBy(*keys).agg(*[F.sum(src).alias(f"_t_{new}") for new, src in feeds.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}")
            for new in feeds
        ],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select(
        "*",
        *[F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_l_{new}") for new, src in feeds.items()],
    )
    known = [F.col(f"_k{i}").eqNullSafe(ref(k)) for i, k in enumerate(keys)]  # a missing ``by`` value is one too
    offsets = offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    joined = local.join(offsets, known)
    return joined.select(
        *[ref(c) for c in table.columns if c != "_one"],
        *[(F.col(f"_l_{new}") + F.col(f"_o_{new}")).alias(new) for new in feeds],
    )


# --- joins to one-row-per-key tables --------------------------------------------------------


def lookup(
    df: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, new: str,
    weight: str | None = None, facts: dict | None = None,
) -> DataFrame:
    """Left-join ``table`` (one row per ``table_key``) and add its ``value`` as ``new``.

    A table within the size bound is broadcast. A larger one is shuffled; of the at most
    HOT_SHARE keys above the hot share (known from the ``weight`` column of counts) only
    hashes are broadcast: rows with such a hash are spread over as many salts as its weight
    fills shuffle partitions, and rows without a key, which match nothing, over all; the table
    has its rows of these hashes once per salt. The salt hashes the row and its partition, so
    equal rows are spread as well.
    ``facts`` gives the table's size (see ``table_facts``) where it is already known.
    """
    table = table.select(
        ref(table_key).alias("_k"),
        ref(value).alias("_v"),
        (ref(weight) if weight else F.lit(0)).cast("bigint").alias("_w"),
    )
    size = facts or table_facts(table, "_k", "_w", value="_v")
    left = df.withColumn("_key", key)
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        out = left.join(F.broadcast(table), F.col("_key") == F.col("_k"), "left")
        return out.select(*[ref(c) for c in df.columns], F.col("_v").alias(new))
    if not weight:
        out = left.join(table, F.col("_key") == F.col("_k"), "left")
        return out.select(*[ref(c) for c in df.columns], F.col("_v").alias(new))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = table.where(F.col("_w") * HOT_SHARE > F.lit(size["w"]))
    share = F.ceil(F.col("_w") * parts / F.lit(size["w"])).cast("bigint")
    hot = F.broadcast(hot.select(F.xxhash64("_k").alias("_hot"), share.alias("_n")).groupBy("_hot").agg(F.max("_n").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(parts).cast("bigint"))
    spread = 1 + F.pmod(F.xxhash64(F.spark_partition_id(), *[ref(c) for c in df.columns]), salts)
    salt = F.when(F.col("_hot").isNotNull() | F.col("_key").isNull(), spread).otherwise(F.lit(0))
    same_type = F.col("_key").try_cast(table.schema["_k"].dataType)
    left = left.join(hot, F.xxhash64(same_type) == F.col("_hot"), "left").withColumn("_salt", salt.cast("bigint"))
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(1).cast("bigint"), F.col("_salts"))).otherwise(F.array(F.lit(0).cast("bigint")))
    right = table.join(hot, F.xxhash64("_k") == F.col("_hot"), "left").select("_k", "_v", F.explode(every).alias("_s"))
    out = left.join(right, (F.col("_key") == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    return out.select(*[ref(c) for c in df.columns], F.col("_v").alias(new))


def table_facts(
    table: DataFrame, key: str, weight: str | None = None, by: str | None = None, value: str | None = None
) -> dict:
    """Rows, bytes (of keys, and of values where named) and total weight of a lookup table, or of each ``by`` part."""
    size = F.octet_length(ref(key).cast("string"))
    if value:
        size = F.coalesce(size, F.lit(0)) + F.coalesce(F.octet_length(ref(value).cast("string")), F.lit(0))
    row = F.struct(
        F.count("*").alias("n"),
        F.coalesce(F.sum(size), F.lit(0)).alias("b"),
        F.coalesce(F.sum(ref(weight)) if weight else F.lit(0), F.lit(0)).cast("bigint").alias("w"),
    )
    if by is None:
        return table.agg(row.alias("f")).first()["f"].asDict()
    return {r[0]: r[1].asDict() for r in table.groupBy(by).agg(row.alias("f")).collect()}


def ordered_values(counts: DataFrame, value: str, dense: str | None = None) -> tuple[DataFrame, dict]:
    """Number the (column, value, n) counts of several columns at once, and say how large each is.

    Adds the rows before each value (``before``), its average-tie ``rank`` and, under the
    name ``dense``, its 0-based position. The result is written once.
    """
    ranked = running_totals(counts, [ref(value)], {"before": "n"}, by=["column"], number=dense)
    table = settle(ranked.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0))
    return table, table_facts(table, value, "n", by="column")


def value_ranks(df: DataFrame, cols: list[str], dense: str | None = None) -> tuple[DataFrame, dict]:
    """(column, value, n, before, rank) for the distinct values of all numeric ``cols``."""
    long = df.select(*[as_double(df, c).alias(c) for c in cols]).unpivot(
        [], [ref(c) for c in cols], "column", "value"
    )
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return ordered_values(counts, "value", dense)


def attach_values(
    df: DataFrame, cols: list[str], table: DataFrame, facts: dict, value: str, new: dict[str, str]
) -> DataFrame:
    """Add one column of a ``value_ranks`` table per name in ``cols``."""
    none = {"n": 0, "b": 0, "w": 0}
    out = df
    for c in cols:
        part = table.where(F.col("column") == c)
        out = lookup(out, as_double(df, c), part, "value", value, new[c], "n", facts.get(c, none))
    return out


# --- ranks of many columns of many values -----------------------------------------------------


def distinct_sizes(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and about how many distinct values each column has: one scan."""
    row = df.agg(F.count("*"), *[F.approx_count_distinct(as_double(df, c)) for c in cols]).first()
    return row[0], dict(zip(cols, row[1:]))


def _parts(df: DataFrame, values: int) -> int:
    """Partitions of a shuffle of so many values, of which no task gets more than about TASK_ROWS."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-values // TASK_ROWS))


def ranked_long(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """(row, i, x, below, equal): every value x of the i-th column with the rows below it and equal to it.

    The rows travel as (row, i, x) only: once to the task that owns their range of values, where ranks
    are positions in sorted order. A value's rows may lie in several ranges; the first and last
    value of each range, and the rows before it, are joined back by a broadcast of at most a few
    rows per range. What each range holds is written once.
    """
    spark = df.sparkSession
    parts = _parts(df, n * len(cols))
    wide = df.select(F.monotonically_increasing_id().alias("row"), *[as_double(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    pairs = [e for i in range(len(cols)) for e in (F.lit(i), F.col(f"v{i}"))]
    long = wide.select("row", F.stack(F.lit(len(cols)), *pairs).alias("i", "x")).where("x is not null")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        i, x = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("i", "x"))
        opens = np.concatenate(([True], i[1:] != i[:-1]))  # of a column
        starts = np.flatnonzero(opens | np.concatenate(([True], x[1:] != x[:-1])))  # of equal values
        sizes = np.diff(starts, append=len(x))
        first = np.maximum.accumulate(np.where(opens, np.arange(len(x)), 0))[starts]
        ends = np.concatenate((opens[starts][1:], [True]))
        run = np.repeat(np.arange(len(starts)), sizes)
        columns = {
            "row": np.concatenate([b["row"].to_numpy() for b in held]), "i": i, "x": x,
            "part": np.full(len(x), TaskContext.get().partitionId(), np.int32),
            "below": (starts - first)[run], "equal": sizes[run], "edge": (opens[starts] | ends)[run],
        }
        yield from pa.table(columns).to_batches(max_chunksize=100_000)

    ordered = long.repartitionByRange(parts, "i", "x", "row").sortWithinPartitions("i", "x", "row")
    schema = "row bigint, i int, x double, part int, below bigint, equal bigint, edge boolean"
    found = settled(ordered.mapInArrow(local, schema), "ranges")
    before = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.groupBy("part", "i").agg(F.count("*").alias("n"))  # a row per range, and one per column
    offsets = F.broadcast(offsets.select("part", "i", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    edges = found.where("edge").groupBy("part", "i", "x").agg(F.min("below").alias("b"), F.max("equal").alias("e"))
    edges = edges.join(offsets, ["part", "i"]).groupBy("i", "x")
    edges = F.broadcast(edges.agg(F.min(F.col("offset") + F.col("b")).alias("b"), F.sum("e").alias("e")))  # two per range
    out = found.join(offsets, ["part", "i"]).join(edges, ["i", "x"], "left")
    return out.select(
        "row", "i", "x", F.coalesce("b", F.col("offset") + F.col("below")).alias("below"), F.coalesce("e", "equal").alias("equal")
    )


def by_row(long: DataFrame, names: list[str], value: Column, n: int | None = None) -> DataFrame:
    """The long form back as one row per row, with ``value`` under each column's name.

    With the number ``n`` of rows, the values go to as many tasks as they need before any table of rows is
    made: the values of a row come from different ranges, so nothing could be summed up before.
    """
    if n is not None:
        long = long.select("row", "i", value.alias("_value")).repartition(_parts(long, n * len(names)), "row")
        value = F.col("_value")
    out = long.groupBy("row").agg(*[F.max(F.when(F.col("i") == i, value)).alias(c) for i, c in enumerate(names)])
    return out.select(*[ref(c) for c in names])


def avg_rank(df: DataFrame, names: str | list[str], new: dict[str, str] | None = None) -> DataFrame:
    """Add the average-tie ranks of numeric columns; missing values stay missing."""
    names = [names] if isinstance(names, str) else list(names)
    table, facts = value_ranks(df, names)
    return attach_values(df, names, table, facts, "rank", new or {c: f"{c}_rank" for c in names})
