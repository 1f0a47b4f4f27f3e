"""Token ids in shard files with Elias-Fano coded document boundaries.

A shard is one file: a header, the document ids and the document boundaries as Elias-Fano
sequences, and all ids of its documents in one array of 2 or 4 bytes each. A sequence of n values
up to u takes about 2 + log2(u / n) bits a value; every 256th set bit of its upper half is listed,
so a boundary is found without reading a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import documents, filesystem, new_folder, put_file, settled

END_ID = 1
SHARD_IDS = 1 << 22  # ids after which a shard is closed
CACHE_WORDS = 1_200_000  # about 250 MB a worker
LONG_WORD = 64
SELECT_STEP = 256
MAX_TASKS = 10_000  # of a read; a task may read several shards
MAGIC = b"IDEF0001"
HEADER = struct.Struct("<8sBqqqqq")  # magic, id bytes, documents, ids, smallest doc_id, lengths of the two sequences


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once while it is remembered.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of
    its words in turn; the six ASCII spaces are white space for its patterns too. A test compares
    with whole-text encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.mark is not None and "\x01" not in w]
        if plain:  # one call; the mark stands between words
            ids = np.array(self.tokenizer.encode_batch_fast([" \x01 ".join(plain)], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(ids == self.mark)
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            starts = [0, *((cuts + 1) * size).tolist()]
            ends = [*(cuts * size).tolist(), len(data)]
            if len(starts) == len(plain):
                self.known.update(zip(plain, (data[s:e] for s, e in zip(starts, ends))))
                words = [w for w in words if "\x01" in w]
        for w in words:
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            self.known[w] = np.array(ids, self.dtype).tobytes()

    @staticmethod
    def _words(text: str) -> list[str]:
        for space in "\t\n\x0b\x0c\r":
            text = text.replace(space, " ")
        return text.split(" ")

    def encode(self, texts) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        texts, out = list(texts), []
        for start in range(0, len(texts), 64):
            some = [self._words(t) for t in texts[start : start + 64]]
            new = set().union(*some).difference(self.known)
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {"": b""}
                new = set().union(*some) - {""}
            new = list(new)
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
            out += [b"".join(map(self.known.__getitem__, words)) for words in some]
            for w in new:
                if len(w) > LONG_WORD:
                    del self.known[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray, top: int) -> bytes:
    """A sequence of ascending integers in [0, top]."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    low = max(0, (top // n).bit_length() - 1) if n else top.bit_length()
    upper = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(n + (top >> low) + 1, np.uint8)
    bits[upper] = 1
    shifts = np.arange(low, dtype=np.uint64)
    lower = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    select = upper[::SELECT_STEP].astype("<u4" if len(bits) < 1 << 32 else "<u8")
    high, low_bytes = np.packbits(bits, bitorder="little").tobytes(), np.packbits(lower, bitorder="little").tobytes()
    return struct.pack("<qBqBq", n, low, len(bits), select.itemsize, len(low_bytes)) + select.tobytes() + low_bytes + high


class EliasFano:
    """Reads a sequence written by ``ef_encode``."""

    def __init__(self, data: bytes):
        self.n, self.low, self.n_bits, size, n_low = struct.unpack_from("<qBqBq", data)
        at = struct.calcsize("<qBqBq")
        n_select = -(-self.n // SELECT_STEP)
        self.select_table = np.frombuffer(data, f"<u{size}", n_select, at)
        at += n_select * size
        self.lower = np.frombuffer(data, np.uint8, n_low, at)
        self.upper = np.frombuffer(data, np.uint8, -(-self.n_bits // 8), at + n_low)

    def _low(self, start: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.uint64)
        first, end = start * self.low, (start + count) * self.low
        bits = np.unpackbits(self.lower[first // 8 : -(-end // 8)], bitorder="little")[first % 8 :][: end - first]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return (bits.reshape(count, self.low).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, from the listed bit before it and the bits up to it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.select_table[i // SELECT_STEP])
        left, byte = i % SELECT_STEP, at // 8
        skip = int(self.upper[byte] & ((1 << at % 8) - 1)).bit_count()
        left += skip
        while True:
            ones = int(self.upper[byte]).bit_count()
            if left < ones:
                break
            left -= ones
            byte += 1
        place = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))[left]
        return ((byte * 8 + int(place) - i) << self.low) | int(self._low(i, 1)[0])

    def values(self, start: int, count: int) -> np.ndarray:
        """``count`` values from number ``start`` on, from the bits between the listed ones around them."""
        count = max(0, min(count, self.n - start))
        if not count:
            return np.zeros(0, np.uint64)
        block, after = start // SELECT_STEP, -(-(start + count) // SELECT_STEP)
        first = int(self.select_table[block])
        end = int(self.select_table[after]) if after < len(self.select_table) else self.n_bits
        bits = np.unpackbits(self.upper[first // 8 : -(-end // 8)], bitorder="little")[first % 8 : first % 8 + end - first]
        ones = np.flatnonzero(bits)[start - block * SELECT_STEP :][:count] + first
        return ((ones - np.arange(start, start + count)).astype(np.uint64) << np.uint64(self.low)) | self._low(start, count)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, count=self.n_bits, bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._low(0, self.n)


# ---------------------------------------------------------------- shards


def shard_bytes(doc_ids: list[int], parts: list[bytes], dtype: np.dtype) -> bytes:
    """A shard of documents in ascending id order; ``parts`` are their ids as bytes."""
    least = doc_ids[0]
    ends = np.cumsum([0, *(len(p) // dtype.itemsize for p in parts)])
    bounds = ef_encode(ends, int(ends[-1]))
    spans = [d - least for d in doc_ids]
    names = ef_encode(np.array(spans, np.uint64), spans[-1])
    head = HEADER.pack(MAGIC, dtype.itemsize, len(doc_ids), int(ends[-1]), least, len(names), len(bounds))
    return b"".join([head, names, bounds, *parts])


class Shard:
    """Random access to a shard in memory: document ids, boundaries, ids of document i."""

    def __init__(self, data: bytes):
        magic, size, self.n_docs, self.n_ids, self.least, n_names, n_bounds = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.names, self.bounds = EliasFano(data[at : at + n_names]), EliasFano(data[at + n_names : at + n_names + n_bounds])
        self.ids = np.frombuffer(data, f"<u{size}", self.n_ids, at + n_names + n_bounds)

    def doc_id(self, i: int) -> int:
        return self.names.select(i) + self.least

    def span(self, i: int) -> tuple[int, int]:
        """Where the ids of document i begin and end."""
        return self.bounds.select(i), self.bounds.select(i + 1)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]

    def find(self, doc_id: int) -> range:
        """The documents of an id, by halving over the id sequence."""
        wanted, ends = doc_id - self.least, []
        for above in (False, True):
            low, high = 0, self.n_docs
            while low < high:
                middle = (low + high) // 2
                value = self.names.select(middle)
                if value < wanted or (above and value == wanted):
                    low = middle + 1
                else:
                    high = middle
            ends.append(low)
        return range(*ends)


def write_shards(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode texts in ascending id order into shards; the manifest (path, n_docs, n_ids, first_id, least_doc, last_doc).

    Each document ends with id 1. ``first_id`` is the number of ids in all shards before. Rows of
    equal id come in text order. A document is never cut, so a shard holds at most one document
    more than ``shard_ids`` ids. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "shards")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], coder.dtype).tobytes()
        names, parts, n = [], [], 0

        def flush():
            path = put_file(folder, f"shard-{part:06d}-{seq:05d}.idef", shard_bytes(names, parts, coder.dtype))
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(names)], "n_ids": [n], "least_doc": names[0], "last_doc": names[-1]})

        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], coder.encode(pdf["text"])):
                names.append(int(doc))
                parts.append(ids + end)
                n += len(ids) // coder.dtype.itemsize + 1
                if n >= shard_ids:
                    yield flush()
                    names, parts, n, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    docs = documents(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, seq int, path string, n_docs bigint, n_ids bigint, least_doc bigint, last_doc bigint"
    written = settled(docs.mapInPandas(write, schema), "manifest")
    # One row per task, then the shards of each task.
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return written.join(parts, "part").select("path", "n_docs", "n_ids", (F.col("base") + inside).alias("first_id"), "least_doc", "last_doc")


DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _shard(path: str) -> Shard:
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        return Shard(f.read())


def _described(shard: Shard, first: int, runs: list[range]) -> pd.DataFrame:
    """Documents by number, their ids and offsets from the select structures, a few at a time."""
    parts = [(np.zeros(0, np.int64),) * 4]
    for run in runs:
        for i in range(run.start, run.stop, SELECT_STEP):
            n = min(SELECT_STEP, run.stop - i)
            bounds = shard.bounds.values(i, n + 1).astype(np.int64)
            crc = [zlib.crc32(shard.ids[s:e].astype("<u4").tobytes()) for s, e in zip(bounds, bounds[1:])]
            names = shard.names.values(i, n).astype(np.int64) + shard.least
            parts.append((names, first + bounds[:-1], np.diff(bounds), np.array(crc)))
    return pd.DataFrame(dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), map(np.concatenate, zip(*parts)))))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, first in zip(pdf["path"], pdf["first_id"]):
                shard = _shard(path)
                yield _described(shard, first, [range(shard.n_docs)])

    spread = manifest.select("path", "first_id").repartition(min(MAX_TASKS, max(1, manifest.count())))
    return spread.mapInPandas(read, DOCUMENT)


def look_up(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``read_shards`` for the ids of ``wanted`` only: each shard that may hold some is opened once.

    Ids and shards meet in equal spans of ids, about one per shard, so neither side is broadcast. Ids that
    no shard holds, and NULL ones, give no row; repeated ids count once, repeated documents all.
    """
    ends = manifest.agg(F.count("*"), F.min("least_doc"), F.max("last_doc")).first()
    if not ends[0]:
        return manifest.sparkSession.createDataFrame([], DOCUMENT)
    span = (ends[2] - ends[1]) // ends[0] + 1
    cell = lambda c: F.expr(f"({c} - {ends[1]}) div {span}")
    ids = wanted.select(wanted[f"`{id_col}`"].cast("bigint").alias("wanted")).where(f"wanted between {ends[1]} and {ends[2]}").distinct()
    shards = manifest.withColumn("cell", F.explode(F.sequence(cell("least_doc"), cell("last_doc"))))
    met = ids.withColumn("cell", cell("wanted")).join(shards, "cell").where("wanted between least_doc and last_doc")

    def read(group: pd.DataFrame) -> pd.DataFrame:
        shard, first = _shard(group["path"].iloc[0]), int(group["first_id"].iloc[0])
        return _described(shard, first, [shard.find(int(d)) for d in group["wanted"]])

    return met.select("path", "first_id", "wanted").groupBy("path").applyInPandas(read, DOCUMENT)
