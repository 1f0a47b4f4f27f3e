"""Importance resampling towards a target corpus: array-scored weights, ranks by a distributed radix sort.

A text's features are its runs of 1 to n words, hashed into buckets. The log ratio of a bucket's share
in the target and in the raw texts is its gain, and the sum of gains over a text's features its weight.
Adding Gumbel noise, a function of the seed and the id alone, to the weights and taking the largest
draws without replacement in proportion to exp(weight / 1000).

Ranks come from an LSD radix sort over the digits of (score descending, id ascending). Rows lie in
blocks; a pass counts each digit's rows per block, and prefix sums over (digit, block) give where the
rows of a block with a digit go. A stable counting sort within the block gives the place of each row
among them; that destination names its next block. After the last pass it is the rank. A pass moves
every row once and no task ever holds more than a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import documents, settled

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 18
KNOWN_FEATURES = 500_000  # features whose buckets a worker remembers before it starts anew
# Words are runs of ASCII letters, digits and all bytes above ASCII; capitals are lowered, the rest are spaces.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


class Hasher:
    """Features of texts as bucket numbers."""

    def __init__(self, max_run: int, buckets: int):
        self.max_run, self.buckets = max_run, buckets
        self.known: dict[bytes, int] = {}

    def _bucket(self, feature: bytes) -> int:
        if len(self.known) >= KNOWN_FEATURES:
            self.known.clear()
        found = self.known[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all features with repeats."""
        words = text.encode().translate(WORD_BYTES).split()
        features = words
        for n in range(2, self.max_run + 1):
            features = features + [b" ".join(run) for run in zip(*(words[i:] for i in range(n)))]
        found = map(self.known.get, features)
        buckets = [self._bucket(f) if b is None else b for f, b in zip(features, found)]
        return len(words), np.array(buckets, "<u4")


def features(df: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets): buckets is a binary of little-endian 32-bit bucket numbers, one per feature.

    One row per row with an id; NULL texts have no words; repeated rows repeat.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(max_run, buckets)
        for batch in batches:
            found = [hasher.of(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())], schema=out
            )

    return documents(df, id_col, text_col).mapInArrow(hashed, "doc_id bigint, n_words bigint, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket over all rows of ``features``: one number per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["buckets"].to_pylist()), "<u4"), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    counts = found.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of target to raw shares of each bucket, one added to every count, rounded down."""
    buckets = len(raw)
    all_raw, all_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    ratios = ((t + 1.0) * all_raw / ((s + 1.0) * all_target) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """Add n_features and weight to rows of ``features``; the buckets go."""

    @F.pandas_udf("bigint")
    def weigh(buckets: pd.Series) -> pd.Series:
        return pd.Series([int(gain[np.frombuffer(b, "<u4")].sum()) for b in buckets], dtype="int64")

    kept = [c for c in found.columns if c != "buckets"]
    return found.select(*kept, (F.octet_length("buckets") / 4).cast("bigint").alias("n_features"), weigh("buckets").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel value of the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    share = (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


# ---------------------------------------------------------------- radix sort


def radix_ranked(df: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``rank`` (1, 2, 3, ...) by bigint ``keys`` (name, descending?), the first key weighing most.

    Keys must not be NULL. Only as many digits are sorted by as the range of a key needs. Rows that are
    equal in all keys take neighbouring ranks in the order in which they were read. An empty table
    stays empty.
    """
    spark, schema = df.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = settled(df.withColumn("place", F.monotonically_increasing_id()), "unsorted")  # in the order of reading
    ends = rows.agg(F.count("*"), *[x for k, _ in keys for x in (F.min(k), F.max(k))]).first()
    if not ends[0]:
        return df.withColumn("rank", F.lit(None).cast("bigint"))
    size = max(1, min(block_rows, ends[0] // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    digits = []
    for i, (name, down) in enumerate(keys):
        least, most = ends[2 * i + 1 : 2 * i + 3]
        value = F.lit(most) - F.col(name) if down else F.col(name) - F.lit(least)
        bits = (most - least).bit_length()
        if bits > 63:  # the range has no bigint: order by the bits themselves, the sign turned
            value = (F.bitwise_not(F.col(name)) if down else F.col(name)).bitwiseXOR(F.lit(-(1 << 63)))
        digits.append([F.shiftrightunsigned(value, s).bitwiseAND((1 << digit_bits) - 1) for s in range(0, bits, digit_bits)])
    rows = rows.withColumn("block", F.expr(f"place div {size}"))
    for digit in [d for of_key in reversed(digits) for d in of_key] or [F.lit(0)]:
        rows = settled(_pass(rows, digit, schema, size), "sorted")
    return rows.select(*df.columns, (F.col("place") + 1).alias("rank"))


def _pass(rows: DataFrame, digit: Column, schema: str, size: int) -> DataFrame:
    """A stable counting sort by one digit: every row's new place and block."""
    rows = rows.withColumn("digit", digit.cast("bigint"))
    counts = settled(rows.groupBy("digit", "block").agg(F.count("*").alias("n")), "counts")
    starts, total = [], 0
    for d, n in sorted(counts.groupBy("digit").agg(F.sum("n")).collect()):  # one row per digit
        starts.append((d, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "digit bigint, start bigint"))
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "digit")
    offsets = offsets.select("block", "digit", (F.col("start") + F.col("inside")).alias("offset"))

    def placed(block: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        block = block.iloc[np.argsort(block["digit"].to_numpy(np.uint32), kind="stable")]
        offsets = offsets.sort_values("digit")
        values, first = block["digit"].to_numpy(), np.searchsorted(block["digit"], offsets["digit"])
        which = np.searchsorted(offsets["digit"], values)
        place = offsets["offset"].to_numpy()[which] + np.arange(len(values)) - first[which]
        return block.drop(columns="digit").assign(place=place, block=place // size)

    return rows.groupBy("block").cogroup(offsets.groupBy("block")).applyInPandas(placed, f"{schema}, place bigint, block bigint")


# ---------------------------------------------------------------- drawing


def resampled(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN,
    buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row with an id; rank is NULL for rows not drawn.

    Of the N rows with at least ``min_words`` words the floor(percent * N / 100) largest scores are drawn.
    NULL texts have no features and weight 0. Rows of one id have the same noise. An empty target
    or corpus is an even one.
    """
    raw = features(df, max_run, buckets, id_col, text_col)
    raw = settled(raw, "features")
    wanted = target.select(F.lit(0).cast("bigint").alias("doc_id"), target[f"`{target_text}`"].alias("text"))
    gain = gains(bucket_counts(raw, buckets), bucket_counts(features(wanted, max_run, buckets), buckets))
    scored = weighted(raw, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = settled(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words).select("doc_id", "n_features", "weight", "score")
    ranked = radix_ranked(able, [("score", True), ("doc_id", False)])
    drawn = able.count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*rest.columns).unionByName(rest)
