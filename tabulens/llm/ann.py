"""Nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors are lifted to one more dimension so that the largest inner product is the smallest
distance, and rotated at random. Within a probed list, candidates are read in column blocks; after
each block a hypothesis test on the partial distance abandons those that are unlikely to come
under the query's threshold. Survivors are scored exactly, in double precision, on the original
vectors.

Equal vectors are searched once: of each distinct vector only the k + 1 smallest ids can appear in
an answer, so a vector that a third of the rows share costs k + 1 candidates and one query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import settled

FIT_ROWS = 8192  # rows that centroids, rotation and first thresholds are fitted on
MAX_LISTS = 4096
LIST_ROWS = 256  # rows a list has on average, as long as there are fewer than MAX_LISTS lists
PROBE_SHARE = 0.6  # of the lists, at least MIN_PROBES: vectors without clusters need that many for a recall of 0.9
MIN_PROBES = 48
COLUMN_BLOCK = 8
EPSILON = 2.1  # of the test: larger abandons fewer candidates
BLOCK_ROWS = 4096  # candidates of a list that one task scans at once
BLOCK_QUERIES = 1024
SCAN_PAIRS = 1 << 17  # pairs of a query and a candidate that are scanned together
SCORE_PAIRS = 1 << 14  # pairs scored together
DENSE = 0.2  # share of the pairs alive from which on blocks are read for all of them
SEED = 7


@dataclass
class Index:
    """What is fitted on the sample: bounded by FIT_ROWS and MAX_LISTS, whatever the number of rows."""

    top2: float  # largest squared length
    rotation: np.ndarray
    centroids: np.ndarray  # rotated space
    sample: np.ndarray  # rotated space

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top2 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]) @ self.rotation

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T))


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, k1, k2): rows with an id whose vector is neither NULL, empty nor zero and holds only finite numbers.

    Vectors of another length than most would not be comparable; the most frequent length counts,
    the smaller on a tie. k1, k2: 128 bits of the vector.
    """
    v = df[f"`{vec_col}`"].cast("array<double>")
    rows = df.where(df[f"`{id_col}`"].isNotNull()).select(df[f"`{id_col}`"].cast("bigint").alias("vec_id"), v.alias("v"))
    rows = rows.where(
        F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return rows.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def fit(rows: DataFrame, distinct: DataFrame, n: int, dim: int) -> Index:
    """Fit on at most FIT_ROWS distinct vectors, chosen by a hash of the vector."""
    rng = np.random.default_rng(SEED)
    top2 = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    some = distinct.orderBy(F.xxhash64("k1", "k2"), "vec_id").limit(FIT_ROWS).select("v").toPandas()["v"]
    x = np.stack([np.asarray(r, np.float64) for r in some])
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    index = Index(top2, rotation, np.zeros((0, dim + 1)), np.zeros((0, dim + 1)))
    index.sample = index.lift(x)
    lists = max(1, min(MAX_LISTS, len(x) // 4 or 1, n // LIST_ROWS))
    index.centroids = _centroids(index.sample, lists, rng)
    return index


def scan(q: np.ndarray, x: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that may be among the k nearest of that q and within its limit, by partial distances.

    Column blocks are read for all pairs at once while most are alive, then for those alive alone.
    """
    dim = x.shape[1]
    if len(x) > 2 * k:  # a first threshold from the list itself
        limits = np.minimum(limits, np.partition(_distances(q, x[: 2 * k]), k - 1, 1)[:, k - 1])
    slack = 1e-9 * (1.0 + (q * q).sum(1).max() + (x * x).sum(1).max())
    part, at, row = np.zeros((len(q), len(x))), None, None
    for start in range(0, dim, COLUMN_BLOCK):
        stop = min(dim, start + COLUMN_BLOCK)
        bound = slack + (limits if stop == dim else limits * (stop / dim * (1.0 + EPSILON / math.sqrt(stop)) ** 2))
        if at is None:
            part += _distances(q[:, start:stop], x[:, start:stop])
            part[part > bound[:, None]] = np.inf  # abandoned
            alive = np.isfinite(part)
            if stop == dim or np.count_nonzero(alive) < DENSE * part.size:
                at, row = np.nonzero(alive)
                part = part[at, row]
        else:
            gap = q[at, start:stop] - x[row, start:stop]
            part = part + np.einsum("ij,ij->i", gap, gap)
            stay = part <= bound[at]
            at, row, part = at[stay], row[stay], part[stay]
    return at, row


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    probes: int | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (id and vector) its k nearest rows of ``df``.

    A query's own id is no candidate. Ties go to the smaller id; fewer than k candidates give all
    that the probed lists hold. Invalid vectors take no part; an empty table gives no rows. An id
    that occurs with several vectors is a candidate with each.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], out_schema)
    dim = lengths[0]["d"]
    copies = Window.partitionBy("k1", "k2").orderBy("vec_id")
    rows = rows.where(F.size("v") == dim).distinct()
    rows = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    rows = settled(rows, "vectors")
    n = rows.count()
    index = fit(rows, rows.where("copy = 1"), n, dim)
    probes = probes or max(MIN_PROBES, math.ceil(PROBE_SHARE * len(index.centroids)))
    keep = k + 1  # the query itself may be among them

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        lifted = index.lift(np.stack(vectors.to_numpy()))
        near = [_distances(lifted[i : i + 2048], index.centroids).argmin(1) for i in range(0, len(lifted), 2048)]
        return pd.Series(np.concatenate(near).astype(np.int32))

    @F.pandas_udf("struct<limit: double, lists: array<int>>")
    def probe(vectors: pd.Series) -> pd.DataFrame:
        lifted = index.lift_query(np.stack(vectors.to_numpy()))
        limits, lists = [], []
        for i in range(0, len(lifted), 256):
            d = _distances(lifted[i : i + 256], index.sample)
            at = min(d.shape[1], keep) - 1
            limits += np.partition(d, at, 1)[:, at].tolist() if d.shape[1] >= keep else [float("inf")] * len(d)
            d = _distances(lifted[i : i + 256], index.centroids)
            m = min(probes, d.shape[1])
            lists += list(np.argpartition(d, m - 1, 1)[:, :m].astype(np.int32))
        return pd.DataFrame({"limit": limits, "lists": lists})

    asked = valid_vectors(queries, id_col, vec_col).where(F.size("v") == dim).select(F.col("vec_id").alias("query_id"), "k1", "k2", "v").distinct()
    distinct_queries = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    probed = distinct_queries.withColumn("p", probe("v")).select(
        "k1", "k2", "v", F.col("p.limit").alias("limit"), F.explode("p.lists").alias("list")
    )
    probed = settled(probed, "probes")
    homed = settled(rows.select("vec_id", "v", home("v").alias("list")), "lists")
    # At most MAX_LISTS rows each: into how many blocks the rows and the queries of a list are dealt.
    sizes = homed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("row_blocks")).join(
        probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("query_blocks")), "list"
    )
    sizes = F.broadcast(settled(sizes, "sizes"))
    left = homed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "row_blocks").alias("rb"), "vec_id", "v",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_blocks") - 1)).alias("qb"),
    )
    right = probed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("k1", "k2"), "query_blocks").alias("qb"), "k1", "k2", "v", "limit",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_blocks") - 1)).alias("rb"),
    )

    def search(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if cand.empty or ask.empty:
            return pd.DataFrame({"k1": [], "k2": [], "vec_id": [], "score": []})
        cand = cand.sort_values("vec_id")
        raw, ids = np.stack(cand["v"].to_numpy()), cand["vec_id"].to_numpy()
        lifted = index.lift(raw)
        raw_q, limits = np.stack(ask["v"].to_numpy()), ask["limit"].to_numpy()
        lifted_q, m = index.lift_query(raw_q), max(1, SCAN_PAIRS // len(raw))
        parts = []
        for i in range(0, len(raw_q), m):
            at, row = scan(lifted_q[i : i + m], lifted, limits[i : i + m], keep)
            score = np.empty(len(at))
            for j in range(0, len(at), SCORE_PAIRS):
                some = slice(j, j + SCORE_PAIRS)
                score[some] = np.einsum("ij,ij->i", raw_q[i + at[some]], raw[row[some]])
            order = np.lexsort((ids[row], -score, at))
            at, row, score = at[order], row[order], score[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < keep
            parts.append((i + at[best], ids[row[best]], score[best]))
        at, found, score = map(np.concatenate, zip(*parts))
        return pd.DataFrame({"k1": ask["k1"].to_numpy()[at], "k2": ask["k2"].to_numpy()[at], "vec_id": found, "score": score})

    by = ["list", "rb", "qb"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "k1 bigint, k2 bigint, vec_id bigint, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).drop("r")
    own = Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "vec_id")
    answers = asked.select("query_id", "k1", "k2").join(hits, ["k1", "k2"]).where("query_id <> vec_id")
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
