"""Runs of characters that recur, numbered by their content without a Python object for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Arrays that grow together without being copied each time."""

    def __init__(self, capacity: int, **types):
        self.n, self.columns = 0, {name: np.empty(capacity, t) for name, t in types.items()}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][: self.n]

    def extend(self, **values) -> None:
        more = self.n + len(next(iter(values.values())))
        for name, new in values.items():
            column = self.columns[name]
            if more > len(column):
                column = self.columns[name] = np.concatenate((column[: self.n], np.empty(max(more - self.n, self.n // 2), column.dtype)))
            column[self.n : more] = new
        self.n = more


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Units:
    """Numbers for runs of characters (code points below 2**21).

    Runs are found by a 64-bit hash; their characters are kept and compared, so a number always
    stands for one content. Should two contents share a hash, all is forgotten and hashed anew.
    """

    def __init__(self):
        self.salt = 0
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.runs = Rows(1 << 18, size=np.int32, at=np.int64)
        self.chars = Rows(1 << 21, char=np.uint32)

    def _hashed(self, chars: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        mixed = (place.astype(np.uint64) << np.uint64(21)) + chars + np.uint64(self.salt << 52)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), start)

    def numbered(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, learn: Callable, forget: Callable) -> np.ndarray:
        """The number of every run; the runs cover ``chars`` without gaps.

        ``learn(chars, size)`` gets the new ones in the order of their numbers; ``forget()`` is called
        when numbers start anew.
        """
        if not len(start):
            return np.zeros(0, np.int32)
        place = np.arange(len(chars)) - np.repeat(start, size)
        some, first, which = np.unique(self._hashed(chars, place, start), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, some)
        new, inside = np.ones(len(some), bool), spot < len(self.hashes)
        new[inside] = self.hashes[spot[inside]] != some[inside]
        if new.any():
            sizes = size[first[new]]
            text = chars[spans(start[first[new]], sizes)]
            self.hashes = np.insert(self.hashes, spot[new], some[new])
            self.number = np.insert(self.number, spot[new], self.runs.n + np.arange(len(sizes), dtype=np.int32))
            self.runs.extend(size=sizes, at=self.chars.n + np.cumsum(sizes) - sizes)
            self.chars.extend(char=text)
            learn(text, sizes)
            spot += np.cumsum(new) - new
        number = self.number[spot][which]
        if np.array_equal(self.runs["size"][number], size):
            there = np.repeat(self.runs["at"][number], size) + place
            if np.array_equal(self.chars["char"][there], chars):
                return number
        self.salt = (self.salt + 1) % 4096
        self.clear()
        forget()
        return self.numbered(chars, start, size, learn, forget)
