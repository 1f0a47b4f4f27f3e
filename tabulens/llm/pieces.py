"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a text falls apart where no piece can cross: before a run of spaces and before a line
break. Within such a unit, the forward pass sums the weights of all segmentations up to each
character, and sampling walks back from the end, choosing each last piece with its share. Random
numbers are a hash of the row key and the character position, so a row's sample depends on nothing
else. Characters without a piece, and a literal space mark, become byte pieces; so decoding gives
back the text.

The weight of a piece is (rank + 1) ** -alpha: the vocabulary lists pieces by rank, not probability.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import documents
from tabulens.llm.units import Rows, Units, spans

SPACE = "▁"
ALPHA = 1.0
SEED = 42
CHUNK_CHARS = 250_000  # of texts sampled together; a longer text is sampled by itself
KNOWN_EDGES = 4_000_000  # edges of units that a worker remembers before it starts anew
CHARACTERS = 1 << 21  # code points, and one value that no piece has


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64. Its three constants."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_level(level: np.ndarray, into: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order by level, state and length; two bytes at a time, which sorts without comparing."""
    order = np.arange(len(level))
    for key in (length, into, level):
        for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
            digit = (key[order] >> shift).astype(np.uint16)
            order = order[np.argsort(digit, kind="stable")]
    return order


class Lattice:
    """The pieces of a model file as a trie with weights, and sampling over texts."""

    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.seed, self.bytes_of, self.byte_ids = seed, [], np.full(256, -1, np.int64)
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece, data = model.id_to_piece(i), b""
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                data = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} would cross a unit")
                data = piece.replace(SPACE, " ").encode()
                self.ids[piece] = i
                self.weight[piece] = (len(self.ids)) ** -alpha
            self.bytes_of.append(data)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        self.byte_log = math.log((len(self.ids) + 1) ** -alpha)
        steps: dict[int, int] = {}  # node and next character to node; node 0 is the root
        self.piece_at, self.log_at = [-1], [0.0]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                key = node * CHARACTERS + ord(c)
                node = steps.setdefault(key, len(self.piece_at))
                if node == len(self.piece_at):
                    self.piece_at.append(-1)
                    self.log_at.append(0.0)
            self.piece_at[node], self.log_at[node] = i, math.log(self.weight[piece])
        self._table(np.fromiter(steps, np.int64), np.fromiter(steps.values(), np.int64))
        self.piece_at, self.log_at = np.array(self.piece_at), np.array(self.log_at)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_size = np.fromiter(map(len, self.bytes_of), np.int64)
        self.flat_start = np.cumsum(self.flat_size) - self.flat_size
        self.known = Units()
        self._forget()

    def _table(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        """The steps in an open hash table, at most a quarter full."""
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.step_keys, self.step_nodes = np.full(self.mask + 1, -1), np.zeros(self.mask + 1, np.int64)
        place = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.step_keys[place] < 0)
            slots, first = np.unique(place[free], return_index=True)
            self.step_keys[slots], self.step_nodes[slots] = keys[free[first]], nodes[free[first]]
            left = self.step_keys[place] != keys
            keys, nodes, place = keys[left], nodes[left], (place[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The node that each step leads to, -1 where there is no such step."""
        place = self._slot(keys)
        held = self.step_keys[place]
        node = np.where(held == keys, self.step_nodes[place], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        place = place[rest]
        while len(rest):
            place = (place + 1) & self.mask
            held = self.step_keys[place]
            hit = held == keys[rest]
            node[rest[hit]] = self.step_nodes[place[hit]]
            more = ~hit & (held >= 0)
            rest, place = rest[more], place[more]
        return node

    def _forget(self) -> None:
        """Units passed forward so far: the first state of each; see _filtered for the states and edges."""
        self.known.clear()
        self.units = Rows(1 << 18, base=np.int32)
        self.states = Rows(1 << 21, first=np.int32)
        self.edges = Rows(KNOWN_EDGES * 3 // 2, share=np.float64, start=np.int32, code=np.int32)

    def _learn(self, chars: np.ndarray, size: np.ndarray) -> None:
        """Pass new units forward and keep them."""
        base, first, share, starts, codes = self._filtered(chars, size)
        states, edges = self.states.n, self.edges.n
        self.units.extend(base=base + states)
        self.states.extend(first=first + edges)
        self.edges.extend(share=share, start=starts + states, code=codes)

    def _edges(self, chars: np.ndarray, size: np.ndarray):
        """(start, end, code, log weight) of all pieces in the units that ``chars`` joins; end is exclusive.

        A code below 0 is -1 minus a character that is spelled in bytes.
        """
        chars = chars.astype(np.int64)
        unit_end = np.repeat(np.cumsum(size), size)
        read = np.where(chars == 32, ord(SPACE), np.where(chars == ord(SPACE), CHARACTERS - 1, chars))
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        alone = np.zeros(len(chars), bool)
        for length in itertools.count(1):
            inside = at + length <= unit_end[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self._step(node * CHARACTERS + read[at + length - 1])
            hit = node >= 0
            at, node = at[hit], node[hit]
            ends = self.piece_at[node] >= 0
            found.append((at[ends], at[ends] + length, self.piece_at[node[ends]], self.log_at[node[ends]]))
            if length == 1:
                alone[at[ends]] = True
        odd = np.flatnonzero(~alone)
        c = chars[odd]
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        found.append((odd, odd + 1, -1 - c, n_bytes * self.byte_log))
        return (np.concatenate(x) for x in zip(*found))

    def _filtered(self, chars: np.ndarray, size: np.ndarray):
        """Forward pass over all units at once, by end position within the unit.

        State: unit and position. Returns the first state of each unit, the first edge into each
        state, and of each edge the share summed up within its state, the start, the code.
        """
        base = np.cumsum(size + 1) - (size + 1)
        start, end, code, log_weight = self._edges(chars, size)
        state = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
        place = state - np.repeat(base, size)
        into, level = state[end - 1] + 1, place[end - 1] + 1
        order = _by_level(level, into, end - start)
        start, into, code, log_weight, level = (x[order] for x in (state[start], into, code, log_weight, level))
        total, share = np.zeros(len(state) + len(size)), np.empty(len(into))
        first = np.zeros(len(total), np.int64)
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, np.int64)
        for a, b in zip(cuts, cuts[1:]):
            value, to = total[start[a:b]] + log_weight[a:b], into[a:b]
            heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            n = np.diff(np.r_[heads, b - a])
            top = np.maximum.reduceat(value, heads)
            value = np.exp(value - np.repeat(top, n))
            whole = np.add.reduceat(value, heads)
            total[to[heads]], first[to[heads]] = top + np.log(whole), a + heads
            value = value / np.repeat(whole, n)
            for j in range(1, n.max()):  # summed state by state, so that other units cannot change a rounding
                more = heads[n > j] + j
                value[more] += value[more - 1]
            value[heads + n - 1] = 1.0
            share[a:b] = value
        return base, first, share, start, code

    def sample(self, keys, texts) -> list[np.ndarray]:
        """Ids of a sampled segmentation of each text; equal keys and texts give equal samples."""
        return list(self.samples(keys, texts))

    def samples(self, keys, texts) -> Iterator[np.ndarray]:
        from xxhash import xxh64_intdigest

        seeds, some, held = [], [], 0
        for key, text in zip(keys, texts):
            seeds.append(xxh64_intdigest(str(key), self.seed))
            some.append(" " + text)
            held += len(text) + 1
            if held >= CHUNK_CHARS:
                yield from map(self._spelled, self._sample(seeds, some))
                seeds, some, held = [], [], 0
        if some:
            yield from map(self._spelled, self._sample(seeds, some))

    def _sample(self, seeds: list[int], texts: list[str]) -> list[np.ndarray]:
        """Walk back from the end of every unit, all at once; the codes of each text."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        # A unit begins at a line break, at the first of several spaces and at the start of a text.
        opens = (chars == 10) | ((chars == 32) & (np.concatenate(([0], chars[:-1])) != 32))
        opens[np.concatenate(([0], ends[:-1]))] = True
        start = np.flatnonzero(opens)
        size = np.diff(start, append=len(chars))
        if self.edges.n > KNOWN_EDGES:
            self._forget()
        unit = self.known.numbered(chars, start, size, self._learn, self._forget)
        base, last = self.units["base"][unit].astype(np.int64), np.searchsorted(start, ends)
        counts = np.diff(last, prepend=0)
        first, share, starts, codes = self.states["first"], self.edges["share"], self.edges["start"], self.edges["code"]
        seeds = np.repeat(np.array(seeds, np.uint64), counts)
        begin = start - np.repeat(start[last - counts], counts)
        left, at, steps, found = np.arange(len(unit)), base + size, np.zeros(len(unit), np.int64), []
        while len(left):
            position = (begin[left] + at - base[left]).astype(np.uint64)
            random = (mix(seeds[left] + mix(position)) >> np.uint64(11)) * 2.0**-53
            edge = first[at].astype(np.int64)
            above = np.flatnonzero(share[edge] <= random)
            while len(above):
                edge[above] += 1
                above = above[share[edge[above]] <= random[above]]
            found.append((left, steps[left], codes[edge]))
            steps[left] += 1
            at = starts[edge].astype(np.int64)
            more = at > base[left]
            left, at = left[more], at[more]
        ends = np.cumsum(steps)
        ids = np.empty(ends[-1], np.int32)
        for who, step, code in found:  # sampled from the last piece to the first
            ids[ends[who] - 1 - step] = code
        return np.split(ids, ends[last - 1][:-1])

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Replace the characters among the ids by their byte pieces."""
        odd = ids < 0
        if odd.any():
            chars = [chr(-1 - c).encode() for c in ids[odd].tolist()]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(c) for c in chars]
            ids = np.repeat(ids, n)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        return ids

    def decode(self, ids) -> str:
        """The text of any segmentation of it."""
        ids = np.asarray(ids, np.int64)
        return self.flat[spans(self.flat_start[ids], self.flat_size[ids])][1:].tobytes().decode()


_LATTICES: dict[tuple, Lattice] = {}


def lattice(path: str, alpha: float, seed: int) -> Lattice:
    """One lattice per worker process."""
    key = (path, alpha, seed)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(path, alpha, seed)
    return _LATTICES[key]


def sampled(
    df: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """(doc_id, text, ids): ids is a binary of little-endian 32-bit piece ids of a sampled segmentation.

    With ``decode``, ``decoded`` is the text that the ids give back, made in the same worker. The row key
    is the id, so rows that repeat id and text repeat the sample. The empty text is the space mark alone.
    """

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def sample(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pieces = lattice(model, alpha, seed)
        ids = [x.astype("<u4").tobytes() for x in pieces.samples(keys.tolist(), texts.tolist())]
        back = [pieces.decode(np.frombuffer(x, "<u4")) if decode else None for x in ids]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(back, dtype=object)})

    found = documents(df, id_col, text_col).withColumn("s", sample("doc_id", "text"))
    return found.select("doc_id", "text", "s.ids", *(["s.decoded"] if decode else []))


def decoded(df: DataFrame, model: str, ids_col: str = "ids", to: str = "decoded", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Add the text of a binary id column; NULL for NULL."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        pieces = lattice(model, alpha, seed)
        return pd.Series([None if x is None else pieces.decode(np.frombuffer(x, "<u4")) for x in ids], dtype=object)

    return df.withColumn(to, decode(df[f"`{ids_col}`"]))


def crc32_of(ids_col: str = "ids"):
    """(n_pieces, ids_crc32) of a binary id column, in SQL functions."""
    return (F.octet_length(ids_col) / 4).cast("bigint").alias("n_pieces"), F.crc32(ids_col).alias("ids_crc32")
