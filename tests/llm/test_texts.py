"""Operators over single texts: round trips, brute force and held-out accuracy."""

import base64
import gzip
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import licenses, packing, pieces, quality, tokens, warc, winnow
from tabulens.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, PIECES = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "One two\tthree\u000bfour", "it's 12 o'clock", "<|endoftext|> a<|startoftext|>b", "\x01 \x01a \x01",
    "É́té  x y", "日本語のテキスト 漢字", "🙂🙂 a🙂", "▁ a▁b ▁▁", "a" * 3000, "x y " * 5000, "İstanbul ΟΔΟΣ", "\u0085  z", "  two  spaces ",
]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    return [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(None, "left out"), (-20, None)]


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- tokens


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_cache_equals_whole_text_encoding(texts):
    coder = tokens.encoder(WORD_BPE)
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)]
    assert got == [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    coder = tokens.WordEncoder(WORD_BPE)
    texts = ["a b c d e f", "g h", "a " + "long" * 40, "a b"] * 40
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)]
    assert got == [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(0, 1 << 50))
@settings(max_examples=80, deadline=None)
def test_elias_fano_round_trip(values, above):
    values = sorted(values)
    top = (values[-1] if values else 0) + above
    coded = tokens.EliasFano(tokens.ef_encode(np.array(values, np.uint64), top))
    assert coded.all().tolist() == values
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1000, 100_000))
    data = tokens.ef_encode(ends, int(ends[-1]))
    assert len(data) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 0.3


@pytest.mark.parametrize("shard_ids", [1, 4000, 1 << 22])
def test_shards_give_back_every_document(spark, shard_ids, tmp_path):
    rows = odd_rows()
    manifest = tokens.write_shards(frame(spark, rows).repartition(3), WORD_BPE, shard_ids=shard_ids)
    got = sorted(tuple(r) for r in tokens.read_shards(manifest).collect())
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in rows if i is not None)):
        ids = whole_ids(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)
    path = manifest.orderBy("first_id").first()["path"].removeprefix("file:")
    with open(path, "rb") as f:
        shard = tokens.Shard(f.read())
    assert shard.doc_id(0) == -20 and shard.document(0).tolist() == [1]


def test_shards_of_an_empty_table(spark):
    assert tokens.read_shards(tokens.write_shards(frame(spark, []), WORD_BPE)).count() == 0


# ---------------------------------------------------------------- packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
@settings(max_examples=150, deadline=None)
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for pattern, count in patterns:
        assert sum(length * n for length, n in pattern) <= 64 and count > 0
        for length, n in pattern:
            used[length] += n * count
    assert used == histogram


def one_by_one(histogram, capacity):
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = [f for f in fills if f + length <= capacity]
            if room:
                fills.remove(min(room))
                fills.append(min(room) + length)
            else:
                fills.append(length)
    return sorted(fills)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=8))
@settings(max_examples=100, deadline=None)
def test_patterns_equal_packing_piece_by_piece(histogram):
    fills = [sum(a * b for a, b in p) for p, n in packing.shortest_pack_first(histogram, 40) for _ in range(n)]
    assert sorted(fills) == one_by_one(histogram, 40)


def check_packed(rows, want, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(ids[at : at + r.length]), len(ids))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= capacity


def test_packed_documents(spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None][:-1] + [(1000 + i, "same few words") for i in range(300)]
    df = frame(spark, [(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, rank int, part int").repartition(5)
    check_packed(packing.packed(df, WORD_BPE, 256).collect(), {i: whole_ids(t) for i, t in rows}, 256)


def test_packing_of_nothing_and_of_repeated_rows(spark):
    assert packing.packed(frame(spark, []), WORD_BPE).count() == 0
    got = packing.packed(frame(spark, [(1, "a"), (1, "a"), (None, "b")]), WORD_BPE).collect()
    assert sorted((r.doc_id, r.sequence_id, r.offset) for r in got) == [(1, 0, 0), (1, 0, 2)]


# ---------------------------------------------------------------- WARC


PAGES = "page_id bigint, url string, html string"


def page_rows():
    pages = [(i, f"http://e.x/{i}", ["<p>a</p>", "é\r\n\r\nb", "", "only once"][min(i % 5, 3)] if i % 5 < 3 else f"page {i}") for i in range(60, 0, -1)]
    return pages + [(100, None, None), (101, "http://a b\r\nX: y", "q"), (None, "u", "z"), (5, "http://e.x/5", "<p>a</p>")]


@pytest.mark.parametrize("min_bytes, file_bytes", [(0, 1), (0, 1 << 25), (5, 2000)])
def test_archives_round_trip(spark, min_bytes, file_bytes):
    rows = page_rows()
    df = frame(spark, [(*r, "n", b"s") for r in rows], PAGES + ", n string, sha binary").repartition(3)
    manifest = warc.write_archives(df, min_bytes=min_bytes, file_bytes=file_bytes)
    got = warc.resolved(warc.read_archives(manifest)).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        if i is not None:
            data = (html or "").encode()
            refers = first[html or ""] if first[html or ""] != i and len(data) >= min_bytes else None
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    key = lambda r: (r[0], r[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_archive_files_are_plain_warc(spark):
    manifest = warc.write_archives(frame(spark, [(1, "http://a/", "hi"), (2, "http://b/", "hi")], PAGES).coalesce(1))
    data = b""
    for r in manifest.collect():
        with gzip.open(r.path.removeprefix("file:")) as f:
            data += f.read()
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To-Target-URI: http://a/\r\n" in data and data.count(b"\r\n\r\nhi\r\n\r\n") == 1


def test_a_damaged_archive_raises(spark, tmp_path):
    record = warc.record_bytes(1, "u", b"abc", 3, warc.base32_sha1(b"abd"), None, None, warc.DATE)
    (tmp_path / "x.warc.gz").write_bytes(record)
    manifest = frame(spark, [(f"file:{tmp_path}/x.warc.gz",)], "path string")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(manifest).collect()
    (tmp_path / "x.warc.gz").write_bytes(record[:-20])
    with pytest.raises(Exception, match="within a record"):
        warc.read_archives(manifest).collect()


def test_no_pages(spark):
    assert warc.resolved(warc.read_archives(warc.write_archives(frame(spark, [], PAGES)))).count() == 0


# ---------------------------------------------------------------- winnowing


def plain_marks(hashes, window):
    """Position of the smallest hash of each window, the rightmost on ties."""
    out = []
    for a in range(max(1, len(hashes) - window + 1)):
        some = hashes[a : a + window]
        at = a + max(i for i, h in enumerate(some) if h == min(some))
        if not out or out[-1] != at:
            out.append(at)
    return out


TEXTS = ["", "a", "a b c d e", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "b " * 40, "日本語のテキストです", "é, è; x1 y2!", "\n \t", "one two three four five six seven eight " * 9]


def test_marks_against_brute_force(spark):
    import re

    from pyspark.sql import functions as F

    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in winnow.fingerprints(frame(spark, rows)).collect()}
    for i, text in rows:
        symbols = re.findall(winnow.SYMBOL, text, re.ASCII)
        grams = [symbols[j : j + winnow.GRAM] for j in range(max(1, len(symbols) - winnow.GRAM + 1))]
        hashed = frame(spark, [(j, g) for j, g in enumerate(grams)], "j int, g array<string>")
        h = [r[0] >> 31 for r in hashed.orderBy("j").select(F.xxhash64("g")).collect()]
        at = plain_marks(h, winnow.WINDOW)
        assert got[i].positions == [p + 1 for p in at] and got[i].hashes == [h[p] for p in at]


def test_any_long_shared_run_shares_a_mark(spark):
    rng = np.random.default_rng(4)
    shared = " ".join(str(x) for x in rng.integers(0, 9, winnow.GRAM + winnow.WINDOW - 1))
    rows = [(i, " ".join(str(x) for x in rng.integers(10, 99, 30)) + " " + shared + " " + " ".join(str(x) for x in rng.integers(10, 99, 20))) for i in range(6)]
    found = [set(r.hashes) for r in winnow.fingerprints(frame(spark, rows)).collect()]
    assert all(a & b for a in found for b in found)


def test_compared_neighbours_and_edits(spark):
    rng = np.random.default_rng(6)
    ids = sorted({int(x) for x in [*rng.integers(-3000, 9000, 40), -64, -65, 0, 63, 64, 1 << 40]})
    texts = [None if i % 11 == 0 else " ".join(str(x) for x in rng.integers(0, 30, rng.integers(0, 60))) + "é🙂" for i in range(len(ids))]
    rows = list(zip(ids, texts))
    df = frame(spark, [(i, t, "b", True) for i, t in rows] + [(None, "z", "", False)], "doc_id bigint, text string, bucket string, copy boolean").repartition(4)
    got = {r.doc_id: r for r in winnow.compared(df).collect()}
    assert sorted(got) == ids
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1 or text != other)


def test_compared_few_rows(spark):
    assert winnow.compared(frame(spark, [])).count() == 0
    one = winnow.compared(frame(spark, [(5, "a b c d e f g")])).first()
    assert one.near_next == 1.0
    same = winnow.compared(frame(spark, [(1, "a b"), (1, "a b"), (2, None), (3, "")])).collect()
    assert len(same) == 4 and {tuple(r.marks) for r in same if r.doc_id > 1} == {tuple(same[-1].marks)}


# ---------------------------------------------------------------- quality


def test_descent_separates_and_holds_its_box():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False) + 100 * y).astype(np.int32) for y in (0, 1) * 40]
    labels = np.array([0, 1] * 40)
    model = quality.fit_rows_of(rows, labels)
    assert all((model.margin(r) > 0) == (y == 1) for r, y in zip(rows, labels))


def test_descent_reaches_the_optimum_of_its_dual():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(60)]
    labels = rng.integers(0, 2, 60)
    scale = rng.standard_normal(quality.SLOTS)
    w, b = quality.dual_descent(rows, labels, scale, passes=3000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 30] = 1
    y, share = np.where(labels == 1, 1.0, -1.0), np.bincount(labels, minlength=2) / 60
    upper = quality.COST / np.sqrt(share)[labels]
    v = np.r_[w[:30], b]
    primal = v @ v / 2 + (upper * np.maximum(0, 1 - y * (x @ v))).sum()
    for _ in range(200):  # no nearby weights do better
        u = v + 0.05 * rng.standard_normal(31)
        assert u @ u / 2 + (upper * np.maximum(0, 1 - y * (x @ u))).sum() >= primal - 1e-3


def test_quality_of_odd_rows(spark):
    docs = frame(spark, odd_rows() + [(501, "good words here"), (502, "### $$$ !!!"), (503, "more good words"), (504, "%%% ### !!!")])
    labels = frame(spark, [(501, 1), (502, 0), (503, 1), (504, 0), (99, 1), (None, 1), (501, 1), (502, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert len(got) == len(ODD) + 4 and all(0 <= s <= 1 for s in got.values())
    assert got[501] > got[502] and got[503] > got[504]
    alone = quality.fit(docs, frame(spark, [(501, 1)], "doc_id bigint, quality int"))
    assert len({r.score for r in quality.scored(docs, alone).collect()}) == 1
    none = quality.fit(docs, frame(spark, [], "doc_id bigint, quality int"))
    assert {round(r.score, 6) for r in quality.scored(docs, none).collect()} == {0.5}


# ---------------------------------------------------------------- licenses


def plain_matches(text, templates, threshold):
    out = []
    for number, line in enumerate(text.split("\n")):
        held = set(licenses.words_of(line))
        for label, wording in templates:
            words = set(licenses.words_of(wording))
            if words and len(words & held) >= threshold * len(words) - 1e-9:
                out.append((number, label, len(words & held) / len(words)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_containment_join_against_brute_force(spark, threshold):
    rng = np.random.default_rng(int(threshold * 10))
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.choice(vocabulary, rng.integers(1, 9)))) for k in range(9)] + [("none", " - ")]
    texts = ["\n".join(" ".join(rng.choice([*vocabulary, "x", "y"], rng.integers(0, 12))) for _ in range(4)) for _ in range(80)]
    df = frame(spark, list(enumerate(texts)))
    for r in licenses.scan(df, templates=templates, threshold=threshold).collect():
        assert sorted((m.line, m.label, m.containment) for m in r.matches) == plain_matches(texts[r.doc_id], templates, threshold)


def test_phrase_places(spark):
    rows = [(0, "The MIT License, mit  license. mit-LICENSE mit licenses"), (1, None), (2, "cc\nby cc BY cc"), (3, "GNU General Public License"), (3, ""), (None, "mit license")]
    got = {(r.doc_id, r.n_words): [(p.first, p.last, p.label) for p in r.places] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {
        (0, 9): [(1, 2, "mit"), (3, 4, "mit"), (5, 6, "mit")],
        (1, 0): [], (2, 5): [(0, 1, "cc-by"), (2, 3, "cc-by")], (3, 4): [(0, 3, "gpl")], (3, 0): [],
    }
    assert licenses.scan(frame(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
WRAPPED = ["Licensed under the Apache License,\nVersion 2.0", f"one\n\n{MIT}\ntwo", f"one\n{BSD}", "Licensed under " + "some other words " * 9 + "the Apache License"]


def test_wrapped_notices_are_found(spark):
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan_runs(frame(spark, list(enumerate(WRAPPED)))).collect()}
    assert got == {0: {"apache-2.0"}, 1: {"mit-notice"}, 2: {"bsd"}, 3: set()}


def plain_runs(text, templates, threshold):
    said = licenses.words_of(text)
    runs, out = [], []
    for label, wording, *must in templates:
        opening = licenses.words_of(wording)
        words, width = set(opening), max(len(opening), int(len(opening) / threshold + 1e-9))
        for a, first in enumerate(said):
            if first in words:
                window = said[a : a + width]
                b = max(window.index(w) for w in words & set(window))
                share = len(words & set(window)) / len(words)
                if share >= threshold - 1e-9 and set(" ".join(must).split()) <= set(window):
                    runs.append((-len(words & set(window)), -share, b + 1, first != opening[0], a, wording, label))
    order = [t[1] for t in templates]
    for _, share, n, _, a, wording, label in sorted(runs, key=lambda r: (*r[:5], order.index(r[5]))):
        here = set(range(a, a + n))
        own = {i for x, y, _, _, w in out if w == wording for i in range(x, y + 1)}
        others = {i for x, y, *_ in out for i in range(x, y + 1)}
        if not here & own and len(here & others) < n / 2:
            out.append((a, a + n - 1, label, -share, wording))
    return sorted(x[:4] for x in out)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_runs_against_brute_force(spark, threshold):
    rng = np.random.default_rng(int(threshold * 10))
    vocabulary = [f"w{i}" for i in range(9)]
    templates = [(f"t{k}", " ".join(rng.choice(vocabulary, rng.integers(1, 7)))) for k in range(9)] + [("none", " - ")]
    templates = [(*t, rng.choice(t[1].split())) if k % 3 == 0 else t for k, t in enumerate(templates)]
    texts = [" ".join(rng.choice([*vocabulary, "x", "y"], rng.integers(0, 50))).replace("x", "x\n") for _ in range(80)]
    for r in licenses.scan_runs(frame(spark, list(enumerate(texts))), templates=templates, threshold=threshold).collect():
        assert sorted((m.first, m.last, m.label, m.containment) for m in r.matches) == plain_runs(texts[r.doc_id], templates, threshold)


NOTICES = {
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"}, "Licensed under CC BY 4.0.": {"cc-by-4.0"}, "Licensed under CC BY-SA 4.0.": {"cc-by-sa-4.0"},
    "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa-4.0"}, "Licensed under CC BY 3.0.": set(),
    "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.": {"cc-by-4.0", "cc-by-nc-4.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
    "This program is free software under the GNU General Public License version 3.": {"gpl-3.0"},
    "This program is free software under the GNU General Public License version 2.": {"gpl-2.0"},
    "It was released under pressure of the new license": set(), "Released under the MIT License.": {"mit-notice"},
    "released " + "word " * 50 + "under the mit license": {"mit-notice"}, "released " + "word " * 50 + "under mit " + "word " * 50 + "the license": set(),
    "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
    "the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.": {"gpl-2.0-or-later"},
    "All rights reserved.": {"reserved"}, "all the rights of the reserved seats": set(),
}


def test_notices_get_their_own_label_only(spark):
    texts = list(NOTICES)
    got = {texts[r.doc_id]: {m.label for m in r.matches} for r in licenses.scan_runs(frame(spark, list(enumerate(texts)))).collect()}
    assert got == NOTICES


# ---------------------------------------------------------------- pieces


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_sampled_segmentation_is_lossless(text, key):
    pieces_of = pieces.lattice(PIECES, pieces.ALPHA, pieces.SEED)
    ids = pieces_of.sample([key], [text])[0]
    assert pieces_of.decode(ids.tolist()) == text


def test_samples_depend_on_the_row_key_only(spark):
    rows = odd_rows()
    once = pieces.sampled(frame(spark, rows).repartition(1), PIECES).collect()
    again = pieces.sampled(frame(spark, rows[::-1]).repartition(7), PIECES).collect()
    key = lambda r: (r.doc_id, bytes(r.ids))
    assert sorted(map(key, once)) == sorted(map(key, again))
    found = pieces.decoded(spark.createDataFrame(once), PIECES).collect()
    assert all(r.decoded == r.text for r in found) and len(found) == len(rows) - 1
    assert pieces.sampled(frame(spark, []), PIECES).count() == 0


def test_samples_do_not_depend_on_remembered_units(monkeypatch):
    model = tokenizer_path("piece_bpe_32k.model")
    texts = ["the cat sat on the mat", "", "ünïcode ▁ marks\n\n  and  runs", "x" * 300, "the cat sat again"] * 3
    keys = list(range(len(texts)))
    fresh = [pieces.Lattice(model).sample([k], [t])[0].tolist() for k, t in zip(keys[:5], texts[:5])]
    whole = [x.tolist() for x in pieces.Lattice(model).sample(keys, texts)]
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 1)
    monkeypatch.setattr(pieces, "KNOWN_EDGES", 40)
    assert [x.tolist() for x in pieces.Lattice(model).sample(keys, texts)] == whole
    assert whole[:5] == fresh


def test_samples_follow_the_lattice_weights():
    pieces_of = pieces.Lattice(PIECES, alpha=0.3)
    text = "▁the"
    weights = {}

    def walk(at, weight, path):
        if at == len(text):
            weights[tuple(path)] = weight
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces_of.weight:
                walk(end, weight * pieces_of.weight[text[at:end]], [*path, pieces_of.ids[text[at:end]]])

    walk(0, 1.0, [])
    n = 20_000
    found = Counter(tuple(x.tolist()) for x in pieces_of.sample(range(n), ["the"] * n))
    assert found.keys() <= weights.keys() and len(weights) > 4
    total = sum(weights.values())
    for path, weight in weights.items():
        share = weight / total
        assert abs(found[path] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-4


# ---------------------------------------------------------------- queries and pipeline


@needs_data
def test_held_out_accuracy(spark):
    from tabulens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in labels)
    assert len(labels) > 40 and right / len(labels) >= 0.9


@needs_data
def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= before
        docs, before = after, after.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packed(rows, {r.doc_id: whole_ids(r.text) for r in docs.collect()}, 2048)


@needs_data
def test_pipeline_keeps_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, _key string, keep string"
    docs = frame(spark, [(i, t, None, "s", None, 1, "k", "x") for i, t in odd_rows()], schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[-1] == "keep", name
    assert docs.where("doc_id is null").count() == 1
    empty = frame(spark, [], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    import corpus_pipeline

    long = ["the cat sat on the mat and looked at the moon", "entirely other words stand in this second text here", "a third text about rivers hills and boats"]
    rows = [(5, long[0]), (5, long[0]), (5, long[1]), (3, long[1]), (None, long[0]), (None, long[2]), (None, long[2]), (1 << 60, "x y z w")]
    docs = frame(spark, [(*r, "s") for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = [(3, long[1]), (5, long[0]), (1 << 60, "x y z w"), (None, long[2])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    packed = corpus_pipeline.pack(spark, kept, SMALL).collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in packed), key=str) == sorted(((i, crc(whole_ids(t))) for i, t in want), key=str)
