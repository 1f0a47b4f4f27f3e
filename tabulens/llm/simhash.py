"""SimHash fingerprints and their self-join over a binary trie.

Node pairs of the trie are walked together from the root: a pair carries the number of bits in
which its two prefixes differ, and is dropped as soon as that exceeds the error budget. The upper
levels are walked by Spark: each fingerprint is sent to the node pairs it belongs to, several
levels at a time, until a pair has few enough fingerprints; the rest of the walk is done in the
task that holds the pair. A pair that is still too large, because many fingerprints share a
prefix, goes on to deeper levels in the next round. Fingerprints are distinct by then, so a node
has at most 2,080 neighbours within two bits and hot texts count once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import documents, settled
from tabulens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
LEAF_ROWS = 4096  # fingerprints of a node pair that one task walks
STEP_BITS = 4  # levels of a further round
SEED = 42
CHUNK = 1 << 16  # shingles whose bits are counted at once
FRONTIER = 1 << 17  # node pairs walked at once in a task


def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    n, ones = len(tokens) - words + 1, np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        some = tokens[start : start + CHUNK + words - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(words))))
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(
    df: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp): one row per input row; a text without words has fingerprint 0."""

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return documents(df, id_col, text_col).select("doc_id", hashed("text").alias("fp"))


def _expand(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """Send each fingerprint from its node pair to the child pairs ``step`` levels further down."""
    masks = [m for m in range(1 << step) if m.bit_count() <= budget]
    child = F.shiftrightunsigned("fp", 64 - depth - step)
    low = child.bitwiseAND(F.lit((1 << step) - 1))
    mask = F.explode(F.filter(F.lit(masks).cast("array<bigint>"), lambda m: F.bit_count(m) <= F.lit(budget) - F.col("err")))
    rows = rows.select("*", child.alias("child"), low.alias("low"), mask.alias("mask"))
    upper = F.when(F.col("side") == 1, F.col("pb")).otherwise(F.col("pa"))
    other = F.when(F.col("side") == 0, F.col("child").bitwiseXOR(F.col("mask"))).otherwise(
        F.shiftleft(upper, step).bitwiseOR(F.col("low").bitwiseXOR(F.col("mask")))
    )
    rows = rows.withColumn("other", other)
    side = (
        F.when(F.col("side") != 0, F.col("side"))
        .when(F.col("mask") == 0, F.lit(0))
        .when(F.col("child") < F.col("other"), F.lit(1))
        .otherwise(F.lit(2))
    )
    return rows.withColumn("side", side).select(
        F.when(F.col("side") == 2, F.col("other")).otherwise(F.col("child")).alias("pa"),
        F.when(F.col("side") == 2, F.col("child")).otherwise(F.col("other")).alias("pb"),
        (F.col("err") + F.bit_count("mask")).cast("int").alias("err"),
        "side",
        "fp",
    )


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` turns to 1 within each node's range of sorted values."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    first = (values[lo] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(values, first), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, depth: int, err: int, budget: int, same: bool):
    """Yield (i, j) index arrays of all a[i], b[j] within the budget; sorted distinct uint64 values.

    ``same``: a and b are one array, and each pair comes once, with i < j.
    """
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero + len(a), zero, zero + len(b), zero + err)]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        wide = bhi - blo
        work = (ahi - alo) * wide
        done = (work <= 32) | (depth == 64)
        if done.any():
            which = np.repeat(np.flatnonzero(done), work[done])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(work[done]) - work[done], work[done])
            i, j = alo[which] + nth // wide[which], blo[which] + nth % wide[which]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~done] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        amid, bmid = _halves(a, alo, ahi, depth), _halves(b, blo, bhi, depth)
        twin = same & (alo == blo) & (ahi == bhi)
        nexts = []
        for x0, x1, y0, y1, more, use in (
            (alo, amid, blo, bmid, 0, True),
            (amid, ahi, bmid, bhi, 0, True),
            (alo, amid, bmid, bhi, 1, True),
            (amid, ahi, blo, bmid, 1, ~twin),
        ):
            alive = (x1 > x0) & (y1 > y0) & (err + more <= budget) & use
            nexts.append((x0[alive], x1[alive], y0[alive], y1[alive], err[alive] + more))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*nexts))))


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j; every entry of the result points at its root."""
    while True:
        ri, rj = parent[i], parent[j]
        apart = ri != rj
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _pair_links(depth: int, budget: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        same = bool((side == 0).any())
        a = np.sort(fp if same else fp[side == 1])
        b = a if same else np.sort(fp[side == 2])
        nodes = a if same else np.concatenate([a, b])
        parent = np.arange(len(nodes))
        for i, j in walk(a, b, depth, int(pdf["err"].iloc[0]), budget, same):
            parent = join_roots(parent, i, j if same else j + len(a))
        moved = np.flatnonzero(parent != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[moved].view(np.int64), "b": nodes[parent[moved]].view(np.int64)})

    return links


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b) of distinct fingerprints ``fps.fp``: links whose components are those of all pairs within ``max_bits``.

    Every pair within the budget is found; a task hands on a spanning forest of the pairs it found,
    so no group of near copies is written out as all its pairs.
    """
    fps = settled(fps.select("fp"), "fps")
    n = fps.count()
    rows = fps.select(
        F.lit(0).cast("bigint").alias("pa"), F.lit(0).cast("bigint").alias("pb"),
        F.lit(0).alias("err"), F.lit(0).alias("side"), "fp",
    )
    depth, step = 0, min(20, max(1, math.ceil(math.log2(max(1, n) / leaf_rows)))) if n else 1
    found = None
    while True:
        last = depth + step >= 64
        rows = _expand(rows, depth, step, max_bits)
        depth += step
        sizes = rows.groupBy("pa", "pb").agg(
            *[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1, 2)]
        )
        sizes = sizes.where("n0 > 1 or (n1 > 0 and n2 > 0)").select(
            "pa", "pb", (F.col("n0") + F.col("n1") + F.col("n2") > (n if last else leaf_rows)).alias("heavy")
        )
        # rows are many times the fingerprints Spark sizes them by, so the join is never left to broadcast them
        rows = settled(rows.join(sizes.hint("shuffle_hash"), ["pa", "pb"]), "pairs")
        links = rows.where(~F.col("heavy")).groupBy("pa", "pb").applyInPandas(
            _pair_links(depth, max_bits), "a bigint, b bigint"
        )
        found = links if found is None else found.union(links)
        rows = rows.where("heavy").drop("heavy")
        if last or rows.isEmpty():
            return found
        step = min(STEP_BITS, 64 - depth)


def groups(
    df: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``max_bits`` bits.

    Rows with equal texts share a fingerprint and so a component; texts without words have
    fingerprint 0 and link like any other. An id that occurs with several texts joins their
    components only through links. An empty table gives no rows.
    """
    docs = settled(fingerprints(df, words, id_col, text_col), "simhash")
    nodes = settled(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = near_links(nodes, max_bits)
    edges = links.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(
        nodes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b"
    )
    roots = components(edges, "x", "y")
    of_fp = nodes.join(roots, nodes["rep"] == roots["u"], "left").select(
        "fp", F.coalesce("v", "rep").alias("component_id")
    )
    return docs.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group: the smallest id, then the smallest hash of the text.

    Rows are judged one by one: repeated ids are told apart by their texts, rows without id are
    judged too and come after all others. Of rows with equal id and text any one stays.
    """

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    text = F.coalesce(df[f"`{text_col}`"], F.lit(""))
    key = [df[f"`{id_col}`"].cast("bigint"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    rows = df.select(*(k.alias(n) for k, n in zip(key, ("id", "h1", "h2"))), hashed(text).alias("fp"))
    keys = settled(rows.groupBy("id", "h1", "h2", "fp").agg(F.count("*").alias("n")), "keys")
    order = F.struct(F.isnull("id").alias("last"), "id", "h1", "h2")
    nodes = settled(keys.groupBy("fp").agg(F.min(order).alias("head")), "nodes")
    roots = components(near_links(nodes, max_bits), "a", "b")
    nodes = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", F.coalesce("v", "fp").alias("root"), "head")
    heads = nodes.groupBy("root").agg(F.min("head").alias("first"))
    heads = nodes.join(heads, "root").select("fp", "first")
    judged = keys.join(heads, "fp").select("id", "h1", "h2", "n", (F.col("first") != order).alias("gone"))
    judged = settled(judged.where("gone or n > 1"), "judged")

    def same(other: DataFrame) -> Column:
        return key[0].eqNullSafe(other["id"]) & (key[1] == other["h1"]) & (key[2] == other["h2"])

    gone, repeated = judged.where("gone"), judged.where("not gone")
    kept = df.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept.select(*df.columns)
    names = ["__id", "__h1", "__h2"]
    once = df.join(repeated, same(repeated), "left_semi").withColumns(dict(zip(names, key))).dropDuplicates(names)
    return kept.join(repeated, same(repeated), "left_anti").select(*df.columns).union(once.select(*df.columns))


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
