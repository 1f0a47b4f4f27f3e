"""Line deduplication: keep bitmaps from a range-partitioned stream of line hashes.

Line hashes are range-partitioned by (hash, document descending, position), so a line that holds a
third of all rows is cut over as many tasks as its rows need. Each task streams its sorted rows
once and keeps a few values per line: the keeper is the document seen first, a third document
proves the line a duplicate. Only the first and the last hash of a task can go on in another task;
their open rows are settled by a table of two rows per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tabulens.llm.common import ascii_lower, documents, settled

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3
DROPPED, OPEN, SUMMARY = 0, 1, 2
OUT = "kind int, h1 bigint, h2 bigint, doc bigint, text_key bigint, pos int, n bigint, last bigint"
KEYS = ["h1", "h2", "doc", "text_key", "pos"]


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, text_key, pos): the lines long enough to be judged, by 128 bits of their key."""
    rows = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    rows = rows.select("doc", "text_key", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_key", "pos")


def _stream(min_docs: int):
    """One pass over sorted rows. ``rank``: how many larger documents of the line came before."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, doc, rank, top, first = None, None, 0, None, True  # of the line being read
        held: list[np.ndarray] = []  # its rows of rank below min_docs - 1 that still may stay

        def out(kind, rows, n=0, last=0):
            frame = pd.DataFrame(rows, columns=KEYS)
            return frame.assign(kind=kind, n=n, last=last)

        def close():
            # Only the last line of the task: what is held may go on in the next task.
            if key is not None:
                if held:
                    yield out(OPEN, np.concatenate(held))
                yield out(SUMMARY, np.array([[*key, top, 0, 0]]), rank + 1, doc)

        for pdf in batches:
            rows = pdf[KEYS].to_numpy(np.int64)
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
            ends = np.r_[starts[1:], len(rows)]
            new_doc = np.r_[False, rows[1:, 2] != rows[:-1, 2]]
            new_doc[starts] = False
            steps = np.cumsum(new_doc)
            ranks = steps - np.repeat(steps[starts], ends - starts)
            goes_on = key is not None and tuple(rows[0, :2]) == key
            if goes_on:
                ranks[: ends[0]] += rank + int(rows[0, 2] != doc)
            elif key is not None:
                if first:
                    yield out(SUMMARY, np.array([[*key, top, 0, 0]]), rank + 1, doc)
                held, first = [], False
            most = np.repeat(ranks[ends - 1], ends - starts)
            of_first = np.zeros(len(rows), bool)
            if first:
                of_first[: ends[0]] = True
            drop = (ranks > 0) & (most >= min_docs - 1) & ~of_first
            if goes_on and not first and ranks[ends[0] - 1] >= min_docs - 1 and held:
                yield out(DROPPED, np.concatenate(held))
                held = []
            if first:
                yield out(OPEN, rows[: ends[0]])
                if len(starts) > 1:  # the first line ends here
                    head = top if goes_on else int(rows[0, 2])
                    yield out(SUMMARY, np.array([[*rows[0, :2], head, 0, 0]]), int(ranks[ends[0] - 1]) + 1, int(rows[ends[0] - 1, 2]))
                    first = False
                    goes_on = False
            yield out(DROPPED, rows[drop])
            if not (goes_on and len(starts) == 1):
                top, held = int(rows[starts[-1], 2]), []
            tail = np.arange(starts[-1], len(rows))
            if not of_first[-1]:
                undecided = tail[(ranks[tail] > 0) & (ranks[-1] < min_docs - 1)]
                if len(undecided):
                    held.append(rows[undecided])
            key, doc, rank = tuple(rows[-1, :2]), int(rows[-1, 2]), int(ranks[-1])
        yield from close()

    return judge


def dropped_lines(
    rows: DataFrame, min_docs: int = MIN_DOCUMENTS, partitions: int | None = None
) -> DataFrame:
    """(doc, text_key, pos) of the lines that go: in at least ``min_docs`` documents, and not in the largest."""
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_key"), F.col("pos")]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = settled(sorted_rows.mapInPandas(_stream(min_docs), OUT), "lines")
    # Two rows per task at most, whatever the data.
    ends: dict[tuple, list] = {}
    for r in out.where(F.col("kind") == SUMMARY).collect():
        ends.setdefault((r.h1, r.h2), []).append((r.doc, r.last, r.n))
    known = []
    for key, parts_of in ends.items():
        parts_of.sort(key=lambda p: (-p[0], -p[1]))
        total = sum(p[2] for p in parts_of)
        total -= sum(p[1] == q[0] for p, q in zip(parts_of, parts_of[1:]))  # a document cut in two
        if total >= min_docs:
            known.append((*key, parts_of[0][0]))
    keepers = spark.createDataFrame(known, "h1 bigint, h2 bigint, keeper bigint")
    settled_open = out.where(F.col("kind") == OPEN).join(F.broadcast(keepers), ["h1", "h2"]).where("doc <> keeper")
    return out.where(F.col("kind") == DROPPED).select("doc", "text_key", "pos").union(
        settled_open.select("doc", "text_key", "pos")
    )


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    maps = []
    for n, gone in zip(n_lines, dropped):
        keep = np.ones(n, bool)
        if gone is not None:
            keep[np.asarray(gone, np.int64)] = False
        maps.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(maps, dtype=object)


def bits_of(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def keep_bitmaps(
    df: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep): one row per distinct (doc_id, text).

    ``keep`` is a compressed bitmap over the lines; ``text_key`` is xxhash64 of the text. Rows with
    equal ids count as one document, each judged on its own lines; repeated rows share a bitmap.
    The empty text has one line, which stays.
    """
    docs = documents(df, id_col, text_col)
    gone = dropped_lines(line_rows(docs, min_chars), min_docs, partitions)
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("gone"))
    heads = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
    ).distinct()
    return heads.join(gone, ["doc", "text_key"], "left").select(
        F.col("doc").alias("doc_id"), "text_key", "n_lines",
        F.greatest(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        _bitmap("n_lines", "gone").alias("keep"),
    )


@F.pandas_udf(StringType())
def _kept_text(texts: pd.Series, keep: pd.Series) -> pd.Series:
    out = []
    for text, bitmap in zip(texts, keep):
        if bitmap is None:
            out.append(text)
            continue
        lines = text.split("\n")
        out.append("\n".join(x for x, k in zip(lines, bits_of(bitmap, len(lines))) if k))
    return pd.Series(out, dtype=object)


def with_kept_text(
    df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False
) -> DataFrame:
    """``df`` with only the kept lines in its text column; other columns and rows without id stay.

    ``counts`` adds n_lines and n_dropped and leaves out rows without id. A text of which every line
    goes is empty. NULL texts stay NULL unless ``counts`` is set, when they are empty texts.
    """
    maps = bitmaps.select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("keep").alias("_keep"),
        F.col("n_lines").alias("_lines"), F.col("n_dropped").alias("_gone"),
    )
    text = F.coalesce(df[f"`{text_col}`"], F.lit(""))
    same = (df[f"`{id_col}`"].cast("bigint") == maps["_doc"]) & (F.xxhash64(text) == maps["_key"])
    joined = df.join(maps, same, "inner" if counts else "left")
    whole = text if counts else df[f"`{text_col}`"]
    kept = F.when(F.coalesce(maps["_gone"], F.lit(0)) == 0, whole).otherwise(_kept_text(text, maps["_keep"]))
    columns = [kept.alias(c) if c == text_col else df[f"`{c}`"] for c in df.columns]
    if counts:
        columns += [maps["_lines"].alias("n_lines"), maps["_gone"].alias("n_dropped")]
    return joined.select(*columns)
