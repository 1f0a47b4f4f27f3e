"""Alignment of two tokenizers over the same text, cut at the byte offsets where both end a token.

A text's tokens by A and by B are two rising sequences of end offsets. Divide and conquer: of an
interval, the A end nearest to the middle that is also a B end is found by bisecting B's ends; it cuts
the interval in two, and both halves are treated alike. An interval without a shared end inside is a
leaf, one group of tokens on either side. All intervals of a batch of texts take each step together.

A link is a pair of tokens that end together, so there is one at the end of every group. Links are
counted over the whole corpus by id pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import documents, settled
from tabulens.llm.units import Rows, Units, spans

# The byte-level alphabet shows these byte ranges as themselves, all other bytes from U+0100 on.
SHOWN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
SPACE = "▁"
CHUNK_BYTES = 1_000_000  # of texts aligned together; a longer text is aligned by itself
KNOWN_CHARS = 4_000_000  # of the units that a worker remembers before it starts anew
JOINED_CHARS = 100_000  # of new units that are encoded in one call
BROADCAST_PAIRS = 2_000_000  # id pairs that tasks look up in memory: 17 bytes each
COUNTED_LINKS = 2_000_000  # links that a task sorts at a time
# The characters that regular expressions take for white space, U+001C to U+001F aside.
WHITE = np.zeros(0x3002, bool)
WHITE[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def is_white(chars: np.ndarray) -> np.ndarray:
    return WHITE[np.minimum(chars, len(WHITE) - 1)]


def utf8_size(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


def byte_level_decoder() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet."""
    shown = {chr(b): b for part in SHOWN_BYTES for b in part}
    rest = [b for b in range(256) if chr(b) not in shown]
    return shown | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; gets the text with a space before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        # Its pattern never joins a character to white space after it, so texts fall apart into units.
        self.by_units = not kind["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        of, vocabulary = byte_level_decoder(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()

    def encode(self, spaced: str) -> list[int]:
        return self.tokenizer.encode(spaced, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece file with byte fallback, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of, self.by_units = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            plain = piece.replace(SPACE, " ")
            self.bytes_of.append(b"" if self.model.is_control(i) else plain.encode())
            if not (self.model.is_control(i) or self.model.is_unknown(i)) and re.search(r"\S[ \n]", plain):
                self.by_units = False
        self.lead = len(self.model.encode("x"))

    def encode(self, spaced: str) -> list[int]:
        if not self.by_units:
            return self.model.encode(spaced[1:])
        # After a word of its own, a unit may begin with any white space or be nothing else.
        return self.model.encode("x" + spaced)[self.lead :]


def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Pair:
    """Two tokenizers, and the ids of the units of text met so far.

    A unit begins with a space or line break after a character that is not white space. Neither
    tokenizer joins characters over its start, so a text's ids are those of its units in turn.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = tokenizer(a), tokenizer(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.by_units = self.a.by_units and self.b.by_units
        self.known = Units()
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.units = Rows(1 << 18, at_a=np.int64, n_a=np.int32, at_b=np.int64, n_b=np.int32, odd=bool)
        self.ids_a, self.ids_b = Rows(1 << 21, id=np.uint32), Rows(1 << 21, id=np.uint32)

    def _cut(self, coder, sizes: np.ndarray, text: str, ends: np.ndarray):
        """(ids, ids of each part) of ``text`` cut at the byte offsets ``ends``; None if the tokens do not spell it or cross a cut."""
        ids = coder.encode(text)
        if b"".join(map(coder.bytes_of.__getitem__, ids)) != text.encode():
            return None
        ids = np.array(ids, np.uint32)
        token_ends = np.cumsum(sizes[ids])
        cuts = np.searchsorted(token_ends, ends, side="right")
        if not np.array_equal(token_ends[cuts - 1], ends):
            return None
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, chars: np.ndarray, size: np.ndarray) -> None:
        """Encode new units: runs of those that end in a visible character joined, any other, and odd ones, by itself."""
        ends, through = np.cumsum(size), np.cumsum(utf8_size(chars))
        lone = is_white(chars[ends - 1]) | ((chars >= 0x1C) & (chars <= 0x1F))[ends - 1]
        block = (ends - 1) // JOINED_CHARS
        cuts = np.flatnonzero(lone[1:] | lone[:-1] | (block[1:] != block[:-1])) + 1
        todo = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]))[::-1]
        while todo:
            i, j = todo.pop()
            first = ends[i] - size[i]
            text = chars[first : ends[j - 1]].tobytes().decode("utf-32-le")
            here = through[ends[i:j] - 1] - (through[first - 1] if first else 0)
            found = self._cut(self.a, self.size_a, text, here), self._cut(self.b, self.size_b, text, here)
            if None not in found:
                self._keep(*found[0], *found[1], np.zeros(j - i, bool))
            elif j - i > 1:
                middle = (i + j) // 2
                todo += [(middle, j), (i, middle)]
            else:
                nothing = np.zeros(0, np.uint32), np.zeros(1, np.int64)
                self._keep(*nothing, *nothing, np.ones(1, bool))

    def _keep(self, ids_a, n_a, ids_b, n_b, odd) -> None:
        self.units.extend(at_a=self.ids_a.n + np.cumsum(n_a) - n_a, n_a=n_a, at_b=self.ids_b.n + np.cumsum(n_b) - n_b, n_b=n_b, odd=odd)
        self.ids_a.extend(id=ids_a)
        self.ids_b.extend(id=ids_b)

    def encode(self, texts: list[str | None]):
        """(ids of A, ids of B, tokens of A and of B by text) of all texts; a text without tokens has none."""
        spaced = [" " + t if t else "" for t in texts]
        chars = np.frombuffer("".join(spaced).encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
        white = is_white(chars)
        opens = ((chars == 10) | (chars == 32)) & ~np.concatenate(([True], white[:-1]))
        # U+001C to U+001F are white space for some patterns only: such texts stay whole.
        unsure = np.zeros(len(ends), bool)
        unsure[np.searchsorted(ends, np.flatnonzero((chars >= 0x1C) & (chars <= 0x1F)), side="right")] = True
        opens[np.repeat(unsure | (not self.by_units), np.diff(ends, prepend=0))] = False
        opens[(ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]] = True
        start = np.flatnonzero(opens)
        if self.known.chars.n > KNOWN_CHARS:
            self._forget()
        unit = self.known.numbered(chars, start, np.diff(start, append=len(chars)), self._learn, self._forget)
        last = np.searchsorted(start, ends)
        odd = np.concatenate(([0], np.cumsum(self.units["odd"][unit])))[last]
        odd = np.diff(odd, prepend=0) > 0
        unit = unit[np.repeat(~odd, np.diff(last, prepend=0))]
        units = np.cumsum(np.where(odd, 0, np.diff(last, prepend=0)))  # through each text
        n_a, n_b = self.units["n_a"][unit].astype(np.int64), self.units["n_b"][unit].astype(np.int64)
        ids_a = self.ids_a["id"][spans(self.units["at_a"][unit], n_a)]
        ids_b = self.ids_b["id"][spans(self.units["at_b"][unit], n_b)]
        through = lambda n: np.diff(np.concatenate(([0], np.cumsum(n)))[units], prepend=0)
        return ids_a, ids_b, through(n_a), through(n_b)

    def align(self, texts: list[str | None]):
        """Ids as ``encode`` gives them, and the last token of A and of B of every group, in order."""
        ids_a, ids_b, n_a, n_b = self.encode(texts)
        last_a, last_b = shared_cuts(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), n_a, n_b)
        return ids_a, ids_b, n_a, n_b, last_a, last_b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """Positions of the tokens of A and of B that end together, over texts of ``n_a`` and ``n_b`` tokens.

    The texts follow each other, and each has the same bytes on both sides, so its end is shared. Only
    rising ends are cut; of tokens that end together, having no bytes, the last ones count.
    """
    whole = (n_a > 0) & (n_b > 0)
    hi_a, hi_b = np.cumsum(n_a)[whole], np.cumsum(n_b)[whole]
    lo_a, lo_b = hi_a - n_a[whole], hi_b - n_b[whole]
    found_a, found_b = [hi_a - 1], [hi_b - 1]
    while len(lo_a):
        open_ = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)  # one token on a side: a leaf
        lo_a, hi_a, lo_b, hi_b = lo_a[open_], hi_a[open_], lo_b[open_], hi_b[open_]
        middle = (lo_a + hi_a) // 2 - 1
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        asked, step = np.arange(len(lo_a)), 0
        while len(asked):
            # the middle, then one to the right, one to the left, two to the right and so on
            at = middle[asked] + (-(step // 2) if step % 2 == 0 else (step + 1) // 2)
            inside = (at >= lo_a[asked]) & (at < hi_a[asked] - 1)
            who, at = asked[inside], at[inside]
            spot = np.searchsorted(ends_b, ends_a[at], side="right") - 1
            hit = (spot >= lo_b[who]) & (spot < hi_b[who] - 1)
            hit[hit] = ends_b[spot[hit]] == ends_a[at[hit]]
            cut_a[who[hit]], cut_b[who[hit]] = at[hit], spot[hit]
            step += 1
            width = (step + 1) // 2
            left = (middle[asked] - width >= lo_a[asked]) | (middle[asked] + width < hi_a[asked] - 1)
            asked = asked[left & (cut_a[asked] < 0)]
        cut = cut_a >= 0
        found_a.append(cut_a[cut])
        found_b.append(cut_b[cut])
        lo_a, hi_a, cut_a = lo_a[cut], hi_a[cut], cut_a[cut] + 1
        lo_b, hi_b, cut_b = lo_b[cut], hi_b[cut], cut_b[cut] + 1
        lo_a, hi_a = np.concatenate((lo_a, cut_a)), np.concatenate((cut_a, hi_a))
        lo_b, hi_b = np.concatenate((lo_b, cut_b)), np.concatenate((cut_b, hi_b))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """One pair of tokenizers per worker process."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about CHUNK_BYTES."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        until = max(at + 1, int(np.searchsorted(ends, CHUNK_BYTES + (ends[at - 1] if at else 0))))
        yield texts.slice(at, until - at).to_pylist()
        at = until


def link_type(bits: int) -> str:
    """A pair of ids of so many bits each is an unsigned number of twice as many, little-endian."""
    return {16: "<u4", 32: "<u8"}[bits]


class Alignment:
    """One text's ids by A and B, and how many tokens of each there are through every group."""

    TYPES = {
        "a_ids": "binary", "b_ids": "binary", "a_ends": "binary", "b_ends": "binary",
        "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "groups_sha256": "string", "links": "binary",
    }

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, link_bits: int):
        self.ids_a, self.ids_b, self.ends_a, self.ends_b, self.link_bits = ids_a, ids_b, ends_a, ends_b, link_bits

    def column(self, name: str):
        """The value of an output column."""
        if name == "links":
            a, b = (x.astype(link_type(self.link_bits)) for x in (self.ids_a[self.ends_a - 1], self.ids_b[self.ends_b - 1]))
            return ((a << a.dtype.type(self.link_bits)) | b).tobytes()
        if name == "groups_sha256":
            return group_digest(self.ids_a, self.ids_b, self.ends_a, self.ends_b)
        of = {"a_ids": self.ids_a, "n_a": self.ids_a, "b_ids": self.ids_b, "n_b": self.ids_b, "b_ends": self.ends_b}
        values = of.get(name, self.ends_a)
        return len(values) if name.startswith("n_") else values.astype("<u4").tobytes()


def aligned(
    df: DataFrame, a: str, b: str, columns=("a_ids", "b_ids", "a_ends", "b_ends"), id_col: str = "doc_id", text_col: str = "text", link_bits: int = 32
) -> DataFrame:
    """(doc_id, columns): the tokens of every whole text by two tokenizers, in groups that end together.

    ``a`` is a byte-level BPE file, ``b`` a SentencePiece model. Columns: ``a_ids`` and ``b_ids``, and
    ``a_ends`` and ``b_ends``, the tokens through each group, as little-endian unsigned 32-bit numbers;
    ``n_a``, ``n_b``, ``n_groups``, their numbers; ``groups_sha256``, the digest of
    `a1,a2|b1;a3|b2,b3`, all groups in order; ``links``, the pairs of ids that end together, as numbers
    (A id << link_bits | B id) of twice ``link_bits`` bits, 16 where both vocabularies fit, or 32.

    A text that is NULL or empty, or that the tokens of either side do not spell after a space, has no
    tokens: empty binaries, zeros and the digest ''. One row per row with an id; repeated rows repeat.
    """
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    out = pa.schema([("doc_id", pa.int64()), *((c, types[Alignment.TYPES[c]]) for c in columns)])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch["text"]):
                ids_a, ids_b, n_a, n_b, last_a, last_b = pair(a, b).align(texts)
                through_a, through_b = np.cumsum(n_a), np.cumsum(n_b)
                groups = np.searchsorted(last_a, through_a)
                found = [
                    Alignment(ids_a[x - n : x], ids_b[y - m : y], last_a[f:g] + 1 - (x - n), last_b[f:g] + 1 - (y - m), link_bits)
                    for x, n, y, m, f, g in zip(through_a, n_a, through_b, n_b, [0, *groups], groups)
                ]
                values = [pa.array([d.column(c) for d in found], types[Alignment.TYPES[c]]) for c in columns]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), *values], schema=out)
                at += len(texts)

    schema = "doc_id bigint, " + ", ".join(f"{c} {Alignment.TYPES[c]}" for c in columns)
    return documents(df, id_col, text_col).mapInArrow(align, schema)


# ---------------------------------------------------------------- digests


def _spelled(ids: np.ndarray, last: np.ndarray, inner: int, outer: int, table: np.ndarray) -> np.ndarray:
    """Decimal ids as rows of bytes, each followed by ``inner``, by ``outer`` where ``last``."""
    rows = table[ids]
    rows[:, -1] = np.where(last, outer, inner)
    return rows


def group_digest(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
    """sha256 of the groups' decimal ids; '' without groups."""
    if not len(ends_a):
        return ""
    top = int(max(ids_a.max(), ids_b.max()))
    table = decimal_table(top)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[ends_a - 1], last_b[ends_b - 1] = True, True
    rows = np.empty((len(ids_a) + len(ids_b), table.shape[1]), np.uint8)
    before_a = np.concatenate(([0], ends_b[:-1]))  # tokens of B in the groups before
    sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    rows[np.arange(len(ids_a)) + np.repeat(before_a, sizes_a)] = _spelled(ids_a, last_a, 44, 124, table)
    rows[np.arange(len(ids_b)) + np.repeat(ends_a, sizes_b)] = _spelled(ids_b, last_b, 44, 59, table)
    flat = rows.ravel()
    return hashlib.sha256(flat[flat > 0][:-1]).hexdigest()


_TABLES: dict[int, np.ndarray] = {}


def decimal_table(top: int) -> np.ndarray:
    """Row i: the digits of i, padded with zero bytes, and room for a separator."""
    width = max(5, len(str(top)))
    if width > 6:
        raise ValueError("ids beyond 999,999 are not supported")
    if width not in _TABLES:
        text = np.array([str(i) for i in range(10**width)], f"S{width}")
        _TABLES[width] = np.pad(text.view(np.uint8).reshape(-1, width), ((0, 0), (0, 1)))
    return _TABLES[width]


# ---------------------------------------------------------------- counts of links


def link_counts(df: DataFrame, link_bits: int = 32) -> DataFrame:
    """(link, n, best): how often each id pair is linked in the corpus, and whether no pair with its B id is
    linked more often. The pairs of one B id are at most as many as A has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for links in batch["links"]:
                held.append(np.frombuffer(links.as_buffer(), link_type(link_bits)))
                n += len(held[-1])
                if n >= COUNTED_LINKS:
                    yield counted(held)
                    held, n = [], 0
            held = [np.concatenate(held)] if held else []  # a copy: nothing holds on to the batch
        if n:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        links, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(links.astype(np.int64)), pa.array(n.astype(np.int64))], names=["link", "n"])

    seen = df.select("links").mapInArrow(count, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND(F.lit((1 << link_bits) - 1)))
    return seen.select("link", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def link_scores(df: DataFrame, counts: DataFrame, bound: int = BROADCAST_PAIRS, link_bits: int = 32) -> DataFrame:
    """Add n_best and count_sum to rows with a unique ``row`` and ``links``; ``links`` goes.

    The most frequent pairs, at most ``bound``, are looked up in the tasks' memory. Links of all other
    pairs, none of which can be frequent, are joined by a shuffle.
    """
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()  # 64 rows at most
    least, held = None, 0
    for size, n in sorted(by_size, reverse=True):
        if held + n > bound:
            break
        least, held = size, held + n
    frequent = F.floor(F.log2("n")) >= (64 if least is None else least)
    table = counts.where(frequent).toPandas()
    keys = table["link"].to_numpy(np.int64).astype(link_type(link_bits))
    order = np.argsort(keys)
    known = df.sparkSession.sparkContext.broadcast((keys[order], table["n"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))

    def looked(links: np.ndarray):
        keys, n, best = known.value
        if not len(keys):
            return np.zeros(len(links), bool), links, links
        at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
        there = keys[at] == links
        return there, np.where(there, n[at], 0), np.where(there, best[at], False)

    kept = [f for f in df.schema.fields if f.name not in ("links", "row")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", row bigint, n_best bigint, count_sum bigint"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bests, sums = [], []
            for x in batch["links"]:
                there, n, best = looked(np.frombuffer(x.as_buffer(), link_type(link_bits)))
                bests.append(int(best[there].sum()))
                sums.append(int(n[there].sum()))
            names = [*(f.name for f in kept), "row"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*names, "n_best", "count_sum"]
            )

    found = df.select(*[f.name for f in kept], "row", "links").mapInArrow(score, schema)
    if held == sum(n for _, n in by_size):
        return found.drop("row")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch["row"].to_pylist(), batch["links"]):
                links = np.frombuffer(x.as_buffer(), link_type(link_bits))
                link, times = np.unique(links[~looked(links)[0]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(link), row)), pa.array(link.astype(np.int64)), pa.array(times.astype(np.int64))], names=["row", "link", "times"]
                )

    others = df.select("row", "links").mapInArrow(rare, "row bigint, link bigint, times bigint")
    others = others.join(counts.where(~frequent), "link").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more")
    )
    added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return found.join(others, "row", "left").select(*[f.name for f in kept], added("n_best", "more_best"), added("count_sum", "more"))


def aligned_documents(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row with an id: doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum."""
    both = pair(a, b)
    bits = 16 if max(len(both.size_a), len(both.size_b)) <= 1 << 16 else 32
    found = aligned(df, a, b, ("n_a", "n_b", "n_groups", "groups_sha256", "links"), id_col, text_col, bits)
    found = settled(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = settled(link_counts(found, bits), "links")
    return link_scores(found.withColumn("n_links", F.col("n_groups")), counts, link_bits=bits)
