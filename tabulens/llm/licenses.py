"""License scan: known phrases, and template containment by an exact set-similarity join.

Every line of a text is a block. A block matches a template when it holds at least THRESHOLD of the
template's distinct words. Template words are ordered by how many blocks of the corpus hold them,
rarest first. A matching block must hold one of the first n - c + 1 words of a template of n words,
c being the words needed (prefix filter); it must have c template words at all (length filter);
and after the first shared word enough must be left on both sides (positional filter). What passes
is verified, so the join is exact. Words in no template never add to an overlap and are left out
of the blocks' order.

``scan_runs`` takes runs of words over the whole text as blocks instead, so a notice may be wrapped
over any number of lines. Its templates also name the words that tell them apart, and of the
templates that match one place only the best stays.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import documents

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, and the wording of a short notice.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This program is free software under the GNU General Public License version 3."),
    ("gpl-2.0", "This program is free software under the GNU General Public License version 2."),
    ("gpl-later", "either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "Copyright. All rights reserved."),
]

GPL_NOTICES = [
    "This program is free software under the GNU General Public License version {}.",
    "This work is licensed under the GNU General Public License, version {}.",
    "GNU General Public License as published by the Free Software Foundation, version {}",
]
LATER_NOTICES = [
    "GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version",
    "either version {} of the License, or (at your option) any later version",
]
CC = {"": "Attribution", "-sa": "Attribution-ShareAlike", "-nc": "Attribution-NonCommercial", "-nd": "Attribution-NoDerivatives",
      "-nc-sa": "Attribution-NonCommercial-ShareAlike", "-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
# Label, wording, and the words that a run must hold.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("mit-notice", "Released under the MIT License.", "mit"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    *((f"gpl-{v}.0", wording.format(v), f"gnu general public {v}") for v in "23" for wording in GPL_NOTICES),
    *((f"gpl-{v}.0-or-later", wording.format(v), f"version {v} or later") for v in "23" for wording in LATER_NOTICES),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary"),
    *((f"cc-by{k}-4.0", f"Licensed under CC BY{k.upper()} 4.0.", f"cc by{k} 4 0") for k in CC),
    *((f"cc-by{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"creative commons {name} 4 0") for k, name in CC.items()),
    ("reserved", "All rights reserved.", "all rights reserved"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(UPPER_TO_LOWER))


def phrase_places(words: list[str], phrases: dict[str, str] = PHRASES) -> list[tuple[int, int, str]]:
    """(first word, last word, label) of every place where a phrase's words stand consecutively."""
    found, vocabulary = [], set(words)
    for phrase, label in phrases.items():
        parts = phrase.split()
        if vocabulary.issuperset(parts):
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    found.append((at, at + len(parts) - 1, label))
    return found


def blocks_of(text: str, vocabulary: frozenset[str]) -> Iterator[tuple[int, set[str]]]:
    """(line number, template words in it) of the lines that hold any."""
    for number, line in enumerate(text.split("\n")):
        held = vocabulary.intersection(words_of(line))
        if held:
            yield number, held


class Templates:
    """Templates with their words in a global order, and an index over their prefixes."""

    def __init__(self, templates, frequency: dict[str, int], threshold: float):
        self.rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.rows, self.index = [], {}
        for label, wording in templates:
            words = sorted(set(words_of(wording)), key=self.rank.__getitem__)
            if not words:
                continue
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            number = len(self.rows)
            self.rows.append((label, frozenset(words), need))
            for place, word in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(word, []).append((number, place))

    def matches(self, held: set[str]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that a block holds to the threshold."""
        tried, found = set(), []
        if self.index.keys().isdisjoint(held):
            return found
        ordered = sorted(held, key=self.rank.__getitem__)
        for here, word in enumerate(ordered):
            for number, place in self.index.get(word, ()):
                label, words, need = self.rows[number]
                if number in tried or len(ordered) < need:
                    continue
                tried.add(number)  # later shared words leave less on both sides
                if 1 + min(len(words) - place - 1, len(ordered) - here - 1) < need:
                    continue
                overlap = len(words & held)
                if overlap >= need:
                    found.append((label, overlap / len(words)))
        return found


def word_frequency(df: DataFrame, vocabulary: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """In how many blocks of the whole corpus each template word stands; one number per template word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                for _, held in blocks_of(text, vocabulary):
                    n.update(held)
        if n:
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    counts = documents(df, id_col, text_col).select("text").mapInPandas(count, "word string, n bigint")
    found = {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


SCAN = (
    "doc_id bigint, n_words bigint, places array<struct<first: bigint, last: bigint, label: string>>,"
    " matches array<struct<line: bigint, label: string, containment: double>>"
)


def scan(df: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, matches): phrase places and matching blocks of every whole text.

    One row per row with an id; texts without words, and NULL texts, have no places or matches.
    A phrase or template without words never matches. Repeated rows repeat.
    """
    vocabulary = frozenset(w for _, wording in templates for w in words_of(wording))
    table = Templates(templates, word_frequency(df, vocabulary, id_col, text_col), threshold)

    def matches(text: str, words: list[str]) -> list[dict]:
        if vocabulary.isdisjoint(words):
            return []
        return [
            {"line": number, "label": label, "containment": share}
            for number, held in blocks_of(text, vocabulary)
            for label, share in table.matches(held)
        ]

    match = pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    return _looked(df, phrases, matches, match, SCAN, id_col, text_col)


def _looked(df: DataFrame, phrases: dict[str, str], matches: Callable[[str, list[str]], list[dict]], match: pa.DataType, schema: str, id_col: str, text_col: str) -> DataFrame:
    place = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("matches", pa.list_(match))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                places = [{"first": a, "last": b, "label": c} for a, b, c in phrase_places(words, phrases)]
                rows.append({"doc_id": doc, "n_words": len(words), "places": places, "matches": matches(text, words)})
            yield pa.RecordBatch.from_pylist(rows, out)

    return documents(df, id_col, text_col).mapInArrow(look, schema)


class Runs:
    """Templates against runs of words over a whole text.

    A run begins with a template word, has at most (words of the wording) / threshold words, and ends
    with the last word that adds a template word. Texts are filtered by prefix and length, starts by
    the distance to the next prefix word and to the last word needed; what passes is verified.
    """

    def __init__(self, templates, frequency: dict[str, int], threshold: float):
        rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.rows = []
        for label, wording, *must in templates:
            said = words_of(wording)
            words = sorted(set(said), key=rank.__getitem__)
            if words:
                need = max(1, math.ceil(threshold * len(words) - 1e-9))
                width = max(len(said), math.floor(len(said) / threshold + 1e-9))
                self.rows.append((label, frozenset(words), need, width, frozenset(words[: len(words) - need + 1]), said[0], frozenset(words_of(" ".join(must)))))

    def matches(self, words: list[str], held: set[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, label, containment), ``held`` being the template words of the text.

        Runs are taken best first: those with the most template words, then the largest containment,
        then the shortest, then one that begins as the wording does, then the first. A run goes if it
        overlaps a better one of its template, or if better ones hold half of its words.
        """
        wanted = [r for r in self.rows if not r[4].isdisjoint(held) and len(r[1] & held) >= r[2] and r[6] <= held]
        if not wanted:
            return []
        places: dict[str, list[int]] = {}
        for at, word in enumerate(words):
            if word in held:
                places.setdefault(word, []).append(at)
        runs = [x for number, row in enumerate(wanted) for x in self._runs(number, row, places)]
        taken: list[set[int]] = [set() for _ in wanted]
        better: set[int] = set()
        found = []
        for overlap, share, length, _, first, number in sorted(runs, key=lambda r: (-r[0], -r[1], *r[2:])):
            here = range(first, first + length)
            if taken[number].isdisjoint(here) and 2 * len(better.intersection(here)) < length:
                taken[number].update(here)
                better.update(here)
                found.append((first, first + length - 1, wanted[number][0], share))
        return sorted(found)

    @staticmethod
    def _runs(number, row, places) -> Iterator[tuple[int, float, int, bool, int, int]]:
        _, words, need, width, prefix, opening, must = row
        spots = sorted((p, w) for w in words for p in places.get(w, ()))
        anchors = sorted(p for w in prefix for p in places.get(w, ()))
        for i in range(len(spots) - need + 1):
            first, word = spots[i]
            if spots[i + need - 1][0] >= first + width:
                continue
            near = bisect_left(anchors, first)
            if near == len(anchors):
                return
            if anchors[near] >= first + width:
                continue
            seen, last = set(), first
            for j in range(i, min(len(spots), i + width)):
                at, x = spots[j]
                if at >= first + width:
                    break
                if x not in seen:
                    seen.add(x)
                    last = at
            if len(seen) >= need and must <= seen:
                yield len(seen), len(seen) / len(words), last - first + 1, word != opening, first, number


SCAN_RUNS = (
    "doc_id bigint, n_words bigint, places array<struct<first: bigint, last: bigint, label: string>>,"
    " matches array<struct<first: bigint, last: bigint, label: string, containment: double>>"
)


def scan_runs(df: DataFrame, phrases: dict[str, str] = PHRASES, templates=NOTICES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with runs of words as blocks: matches are (first word, last word, label, containment).

    A template is (label, wording) or (label, wording, words that a run must hold).
    """
    vocabulary = frozenset(w for _, wording, *_ in templates for w in words_of(wording))
    table = Runs(templates, word_frequency(df, vocabulary, id_col, text_col), threshold)

    def matches(text: str, words: list[str]) -> list[dict]:
        found = table.matches(words, vocabulary.intersection(words))
        return [{"first": a, "last": b, "label": label, "containment": share} for a, b, label, share in found]

    match = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    return _looked(df, phrases, matches, match, SCAN_RUNS, id_col, text_col)
