"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

Lengths are counted by Spark; the driver sees the histogram only, at most one number per length up
to the capacity, and computes packing patterns with counts. Each piece then finds its pattern by
its rank among the pieces of its length: ranks are numbered where the pieces are made and shifted
by the counts of the parts before, so no length, however frequent, passes one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import documents, settled
from tabulens.llm.tokens import END_ID, encoder

CAPACITY = 2048
Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Packing patterns and how many packs have each.

    Lengths go longest first, each piece into the least filled pack that has room, and into a new
    pack where none has. Packs of one pattern are moved together, so the work depends on the number
    of lengths and patterns, not of pieces.
    """
    packs: dict[int, list[tuple[Pattern, int]]] = {}  # by fill
    fills: list[int] = []

    def add(fill: int, pattern: Pattern, count: int) -> None:
        if count:
            if fill not in packs:
                packs[fill] = []
                heapq.heappush(fills, fill)
            packs[fill].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not fills or fills[0] + length > capacity:
                each = capacity // length
                add(each * length, ((length, each),), left // each)
                rest = left % each
                add(rest * length, ((length, rest),), int(rest > 0))
                break
            fill = fills[0]
            pattern, count = packs[fill].pop()
            if not packs[fill]:
                del packs[fill]
                heapq.heappop(fills)
            used = min(count, left)
            add(fill, pattern, count - used)
            if pattern[-1][0] == length:
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1))
            else:
                grown = (*pattern, (length, 1))
            add(fill + length, grown, used)
            left -= used
    return [x for fill in sorted(packs, reverse=True) for x in packs[fill]]


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length, rank intervals: (length, first rank, pieces a pack, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            used[length] = first + each * count
            offset += length * each
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", without_id: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth): documents with end id, cut at the capacity.

    ``nth`` numbers the pieces of one length within ``part``. ``without_id`` takes rows without id too.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], coder.dtype).tobytes()
        for pdf in batches:
            rows = []
            for known, doc, ids in zip(pdf["known"], pdf["doc_id"], coder.encode(pdf["text"])):
                ids = np.frombuffer(ids + end, coder.dtype).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    nth = seen.get(len(piece), 0)
                    seen[len(piece)] = nth + 1
                    rows.append((known, doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, nth))
            out = pd.DataFrame(rows, columns=["known", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])
            out["doc_id"] = out["doc_id"].astype("Int64").where(out["known"].astype(bool))
            yield out.drop(columns="known")

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"
    docs = documents(df, id_col, text_col).select(F.lit(True).alias("known"), "doc_id", "text")
    if without_id:
        text = F.coalesce(df[f"`{text_col}`"], F.lit("")).alias("text")
        key = df[f"`{id_col}`"].cast("bigint")
        docs = df.select(key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("doc_id"), text)
    return settled(docs.mapInPandas(cut, schema), "pieces")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with columns length (1 to capacity), part and nth.

    Each piece gets a place of its own; within a sequence the pieces lie without gaps from 0.
    Equal lengths are told apart by rank only, so repeated rows are packed like others. No piece
    gives no row.
    """
    counts = settled(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, capacity))
    wide = 1 << 40  # ranks of one length stay below
    keys = table["length"] * wide + table["first"]

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        inside = rank.to_numpy() - table["first"][at]
        pack, slot = np.divmod(inside, table["each"][at])
        return pd.DataFrame({
            "sequence_id": table["sequence"][at] + pack,
            "offset": table["offset"][at] + slot * length.to_numpy(),
        })

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    out = ranked.withColumn("place", place("length", "rank"))
    return out.select("*", "place.sequence_id", "place.offset").drop("place", "rank", "before")


def packed(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", without_id: bool = False) -> DataFrame:
    """One row per piece of a document, placed: see ``token_pieces`` and ``placed``.

    The empty text is one piece of one id, the end id.
    """
    return placed(token_pieces(df, tokenizer, capacity, id_col, text_col, without_id), capacity).drop("part", "nth")
