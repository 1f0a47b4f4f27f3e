"""Queries: histograms, densities, box statistics, running shares, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import distribution as D
from tabulens.plans import plan, union
from tabulens.plans.inputs import REVENUE, picked
from tabulens.sources.tables import table


def _hist_sql(c, source, n=20, y=None):
    mean = f", round(avg({y}), 4) AS mean_y" if y else ""
    return f"""WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi, least({n}, count(DISTINCT {c})) AS n FROM {source}),
    c AS (SELECT least(floor(({c} - lo) / (hi - lo) * n)::BIGINT + 1, n) AS bin, count(*) AS count{mean}
          FROM {source}, r GROUP BY 1),
    b AS (SELECT unnest(range(1, n + 1)) AS bin, lo, (hi - lo) / n AS w FROM r),
    h AS (SELECT b.bin AS bin, lo + (b.bin - 1) * w AS "start", lo + b.bin * w AS "end",
      coalesce(count, 0) AS count{', mean_y' if y else ''} FROM b LEFT JOIN c ON b.bin = c.bin)
    """


@plan(
    "hist_numeric",
    _hist_sql("l_extendedprice", "lineitem")
    + """SELECT bin, round("start", 4) AS "start", round("end", 4) AS "end",
    round(("start" + "end") / 2, 4) AS midpoint, count FROM h""",
)
def hist_numeric(spark, folder):
    out = D.hist_numeric(table(spark, folder, "lineitem"), "l_extendedprice")
    return out.select("bin", *[F.round(c, 4).alias(c) for c in ("start", "end", "midpoint")], "count")


@plan(
    "hist_mean_target",
    _hist_sql("value", "events", 30, "user_id") + "SELECT bin, count, mean_y FROM h",
)
def hist_mean_target(spark, folder):
    out = D.hist_mean_target(table(spark, folder, "events"), "value", "user_id", 30)
    return out.withColumn("mean_y", F.round("mean_y", 4))


@plan(
    "value_counts_top20",
    """SELECT label, count, 0.0::DOUBLE AS midpoint, mean_y FROM (
    SELECT p_type AS label, count(*) AS count, round(avg(p_retailprice), 4) AS mean_y FROM part
    GROUP BY p_type ORDER BY count DESC, label LIMIT 20)""",
)
def value_counts_top20(spark, folder):
    out = D.value_counts_top20(table(spark, folder, "part"), "p_type", "p_retailprice")
    return out.withColumn("mean_y", F.round("mean_y", 4))


@plan(
    "value_counts_numeric",
    """SELECT label, count, midpoint, mean_y FROM (SELECT CAST(l_discount AS VARCHAR) AS label,
    count(*) AS count, l_discount AS midpoint, round(avg(l_extendedprice), 4) AS mean_y FROM lineitem GROUP BY l_discount)""",
)
def value_counts_numeric(spark, folder):
    out = D.distribution_bins(table(spark, folder, "lineitem"), "l_discount", "l_extendedprice")
    return out.withColumn("mean_y", F.round("mean_y", 4))


META = [("lineitem", "l_extendedprice", "numeric"), ("lineitem", "l_discount", "numeric"), ("events", "event_type", "categorical")]


@plan(
    "distribution_meta",
    union(
        f"""SELECT '{c}' AS "column", '{k}' AS col_type,
        CASE WHEN '{k}' = 'categorical' OR count(DISTINCT {c}) <= 15 THEN 'per_value' ELSE 'histogram' END AS chart_type,
        count({c}) AS total, count(DISTINCT {c}) AS "unique", count(*) - count({c}) AS n_nan FROM {t}"""
        for t, c, k in META
    ),
)
def distribution_meta(spark, folder):
    parts = [D.distribution_meta(table(spark, folder, t), c) for t, c, _ in META]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _kde_sql(c, source):
    return f"""kr AS (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n,
      stddev_samp({c}) * pow(count({c}), -0.2) AS h FROM {source}),
    kg AS (SELECT CAST(i AS INT) AS point, CASE WHEN i = 99 THEN hi ELSE lo + (hi - lo) / 99 * i END AS x, h, n
          FROM kr, (SELECT unnest(range(100)) AS i)),
    kv AS (SELECT {c} AS v, count(*) AS w FROM {source} GROUP BY {c}),
    k AS (SELECT point, round(x, 6) AS x,
      round(sum(w * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
      FROM kg, kv GROUP BY point, x)"""


@plan("kde_gaussian", f"WITH {_kde_sql('value', 'events')} SELECT point, x, density FROM k")
def kde_gaussian(spark, folder):
    return D.kde_gaussian(table(spark, folder, "events"), "value")


@plan(
    "kde_on_bins",
    _hist_sql("value", "events").rstrip()
    + f", {_kde_sql('value', 'events')}"
    + """ SELECT bin, count, (SELECT arg_min(density, abs(k.x - ("start" + "end") / 2)) FROM k) AS density FROM h""",
)
def kde_on_bins(spark, folder):
    events = table(spark, folder, "events")
    out = D.kde_on_bins(D.hist_numeric(events, "value"), D.kde_gaussian(events, "value"))
    return out.select("bin", "count", "density")


BOXES = [("l_extendedprice", "lineitem"), ("l_quantity", "lineitem"), ("n_chars", "documents"), ("value", "events")]


def _fence_sql(c, source):
    return f"""(SELECT q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
     quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}))"""


@plan(
    "box_stats",
    union(
        f"""SELECT '{c}' AS "column", round(min(CAST({c} AS DOUBLE)) FILTER ({c} BETWEEN lo AND hi), 6) AS min,
        round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
        round(max(CAST({c} AS DOUBLE)) FILTER ({c} BETWEEN lo AND hi), 6) AS max FROM {t}, {_fence_sql(c, t)}"""
        for c, t in BOXES
    ),
)
def box_stats(spark, folder):
    out = D.box_stats(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])
    out = out.unionByName(D.box_stats(table(spark, folder, "documents"), "n_chars"))
    return out.unionByName(D.box_stats(table(spark, folder, "events"), "value"))


@plan(
    "box_outliers",
    f"""WITH o AS (SELECT round(value, 6) AS value FROM events, {_fence_sql('value', 'events')} WHERE value < lo OR value > hi)
    SELECT value FROM o WHERE (SELECT count(*) FROM o) <= 100
    UNION ALL (SELECT value FROM o WHERE (SELECT count(*) FROM o) > 100 ORDER BY value LIMIT 50)
    UNION ALL (SELECT value FROM o WHERE (SELECT count(*) FROM o) > 100 ORDER BY value DESC LIMIT 50)""",
)
def box_outliers(spark, folder):
    return D.box_outliers(table(spark, folder, "events"), "value")


@plan(
    "cdf",
    _hist_sql("value", "events")
    + """SELECT bin AS label, round(sum(count) OVER (ORDER BY bin) * 100.0 / sum(count) OVER (), 2) AS cumulative_pct FROM h""",
)
def cdf(spark, folder):
    return D.cdf(D.hist_numeric(table(spark, folder, "events"), "value"), "bin", "bin")


@plan(
    "cdf_per_value",
    """WITH h AS (SELECT l_returnflag AS label, count(*) AS count FROM lineitem GROUP BY 1)
    SELECT label, round(sum(count) OVER (ORDER BY label) * 100.0 / sum(count) OVER (), 2) AS cumulative_pct FROM h""",
)
def cdf_per_value(spark, folder):
    return D.cdf(D.value_counts_top20(table(spark, folder, "lineitem"), "l_returnflag"), "label", "label")


OUTLIER_SRC = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "rev": REVENUE, "rev2": f"pow({REVENUE}, 4)"}
_LINES = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in OUTLIER_SRC.items()) + " FROM lineitem)"
OUTLIERS = [(c, _LINES) for c in OUTLIER_SRC] + [("value", "events"), ("n_chars", "documents")]


def _outlier_sql(c, source, which):
    z = f"count(*) FILTER (abs(({c} - m) / s) > 3)"
    q = f"count(*) FILTER ({c} < lo OR {c} > hi)"
    cols = {
        "z": f"{z} AS z_score_count, round({z} * 100.0 / count(*), 2) AS z_score_pct",
        "q": f"{q} AS iqr_count, round({q} * 100.0 / count(*), 2) AS iqr_pct",
    }
    return f"""SELECT '{c}' AS "column", {', '.join(cols[w] for w in which)}, count({c}) AS n_valid
    FROM {source}, {_fence_sql(c, source)}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source})"""


def _outlier_frames(spark, folder, fn):
    out = fn(picked(table(spark, folder, "lineitem"), OUTLIER_SRC), list(OUTLIER_SRC))
    out = out.unionByName(fn(table(spark, folder, "events"), ["value"]))
    return out.unionByName(fn(table(spark, folder, "documents"), ["n_chars"]))


@plan("outliers_zscore", union(_outlier_sql(c, s, "z") for c, s in OUTLIERS))
def outliers_zscore(spark, folder):
    return _outlier_frames(spark, folder, D.outliers_zscore)


@plan("outliers_iqr", union(_outlier_sql(c, s, "q") for c, s in OUTLIERS))
def outliers_iqr(spark, folder):
    return _outlier_frames(spark, folder, D.outliers_iqr)


@plan(
    "outliers_present",
    "SELECT * FROM (" + union(_outlier_sql(c, s, "zq") for c, s in OUTLIERS) + ") WHERE z_score_count > 0 OR iqr_count > 0",
)
def outliers_present(spark, folder):
    return D.outliers_present(_outlier_frames(spark, folder, D.outliers))


@plan(
    "fence_rows",
    f"SELECT event_id, value < lo OR value > hi AS value_outlier FROM events, {_fence_sql('value', 'events')}",
)
def fence_rows(spark, folder):
    return D.fence_rows(table(spark, folder, "events"), ["value"]).select("event_id", "value_outlier")
