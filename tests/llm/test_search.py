"""Operators over groups of documents and vectors against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
import xxhash

from tabulens.llm import ann, lines, simhash
from tabulens.llm.components import components

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def random_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(LETTERS), 4)) for _ in range(60)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:  # a near copy
            t = texts[rng.integers(len(texts))].split(" ")
            if t and rng.random() < 0.7:
                t[rng.integers(len(t))] = str(rng.choice(words))
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(rng.choice(words, rng.integers(0, 40))))
    return texts


# ---------------------------------------------------------------- components


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.u: r.v for r in components(frame(spark, edges, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_components_without_edges(spark):
    assert components(frame(spark, [], "x bigint, y bigint"), "x", "y").count() == 0


# ---------------------------------------------------------------- simhash


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "ONE two", "É É a B c", "a b c d e f g a b c", "x\ty\nz  w"])
def test_simhash_of_one_text(text):
    assert simhash.simhash(text) % (1 << 64) == plain_simhash(text)


def test_spark_and_library_hash_agree(spark):
    from pyspark.sql import functions as F

    got = frame(spark, [(1, "one two three")]).select(F.xxhash64("text")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("leaf, low_bits", [(4096, 64), (8, 64), (2, 10)])
def test_near_links_find_every_pair(spark, leaf, low_bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << min(low_bits, 62), 60, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base[:20] for i, j in [(0, 63), (5, 6), (9, 9), (40, 41)]]
    fps = sorted({int(x) for x in [*base, *flips, 0, 3, (1 << 64) - 1]})
    rows = frame(spark, [(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(rows, 2, leaf).collect()]
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    assert all((a ^ b).bit_count() < 64 for a, b in got)
    assert classes(fps, got) == classes(fps, near)


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    # Spark sizes an explode by its input: at 0.5 GB of documents 1.2 GB went to the driver
    plans, real = {}, simhash.settled

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "settled", noted)
    rows = frame(spark, [(i * 7919,) for i in range(50)], "fp bigint")
    simhash.near_links(rows, 2, 8).count()
    assert "Generate explode" in plans["pairs"] and "Broadcast" not in plans["pairs"]


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_walk_gives_each_pair_once():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 4000, 500).astype(np.uint64))
    b = np.unique(rng.integers(0, 4000, 300).astype(np.uint64))
    for x, y, same in ((a, a, True), (a, b, False)):
        got = sorted((int(i), int(j)) for p in simhash.walk(x, y, 0, 0, 2, same) for i, j in zip(*p))
        want = [(i, j) for i in range(len(x)) for j in range(len(y)) if (not same or i < j) and int(x[i] ^ y[j]).bit_count() <= 2]
        assert got == want


def test_groups_against_brute_force(spark):
    texts = random_texts(150) + ["", " ", None, "same text here", "same text here"]
    rows = list(enumerate(texts)) + [(None, "no id"), (7, texts[7])]
    got = simhash.groups(frame(spark, rows)).collect()
    fps = {i: plain_simhash(t or "") for i, t in enumerate(texts)}
    near = [(i, j) for i, j in itertools.combinations(fps, 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = classes(fps, near)
    assert len(got) == len(rows) - 1  # the repeated row repeats, the row without id is left out
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_groups_of_an_empty_table(spark):
    assert simhash.groups(frame(spark, [])).count() == 0


def test_groups_ignores_clashing_columns(spark):
    df = frame(spark, [(1, "a b c", 5, 6, "x"), (2, "a b c", 7, 8, "y")], "doc_id bigint, text string, fp int, component_id int, rep string")
    assert {tuple(r) for r in simhash.groups(df).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}


# ---------------------------------------------------------------- lines


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_lines_against_brute_force(spark, partitions):
    rng = np.random.default_rng(partitions)
    pool = ["a line that is repeated often enough", "A LINE that is repeated often enough \t", "short", "", "the second of the repeated lines é", "x" * 20, "y" * 19]
    rows = []
    for i in range(60):
        some = [str(x) for x in rng.choice(pool, rng.integers(1, 6))] + [f"a line of document {i % 50} alone here"]
        rows.append((int(i * 3 - 20), "\n".join(some)))
    rows += [(500, None), (501, ""), (502, pool[0]), (503, "é" * 20), (504, "é" * 20)]
    df = frame(spark, rows)
    maps = lines.keep_bitmaps(df, partitions=partitions)
    got = lines.with_kept_text(df, maps, counts=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain_lines(rows)


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_stream_at_any_batch_and_cut(batch, cuts):
    """The open rows and summaries of all tasks settle what one task alone would decide."""
    rng = np.random.default_rng(batch * 10 + cuts)
    rows = sorted(
        {(int(h), 0, int(d), 0, int(p)) for h, d, p in zip(rng.integers(0, 6, 70), rng.integers(0, 5, 70), rng.integers(0, 9, 70))},
        key=lambda r: (r[0], -r[2], r[4]),
    )
    want = set()
    for h in range(6):
        docs = {r[2] for r in rows if r[0] == h}
        want |= {r for r in rows if r[0] == h and len(docs) >= 3 and r[2] != max(docs)}
    ends, dropped, opened = {}, [], []
    for part in np.array_split(np.array(rows), cuts):
        frames = [pd.DataFrame(part[i : i + batch], columns=lines.KEYS) for i in range(0, len(part), batch)]
        for out in lines._stream(3)(iter(frames)):
            for r in out.itertuples():
                row = (r.h1, r.h2, r.doc, r.text_key, r.pos)
                if r.kind == lines.SUMMARY:
                    ends.setdefault(r.h1, []).append((r.doc, r.last, r.n))
                else:
                    (dropped if r.kind == lines.DROPPED else opened).append(row)
    for h, parts in ends.items():
        parts.sort(key=lambda p: (-p[0], -p[1]))
        n = sum(p[2] for p in parts) - sum(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        if n >= 3:
            dropped += [r for r in opened if r[0] == h and r[2] != parts[0][0]]
    assert len(dropped) == len(set(dropped)) and set(dropped) == want


def test_lines_edge_rows(spark):
    long = "this line stands in three documents"
    rows = [(1, long), (2, long), (3, long), (3, long), (3, "x\n" + long), (None, long)]
    df = frame(spark, [(i, t, 5, "k") for i, t in rows], "doc_id bigint, text string, n_lines int, keep string")
    maps = lines.keep_bitmaps(df)
    assert maps.count() == 4  # one per distinct id and text
    got = lines.with_kept_text(df, maps)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted(
        [(0, long), (1, ""), (2, ""), (3, long), (3, long), (3, "x\n" + long)]
    )
    empty = frame(spark, [])
    assert lines.with_kept_text(empty, lines.keep_bitmaps(empty), counts=True).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def plain_nearest(rows, asked, k):
    valid = {i: np.asarray(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)}
    out = {}
    for q in asked:
        if q in valid:
            found = sorted(((-float(valid[i] @ valid[q]), i) for i in valid if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


SCHEMA = "vec_id bigint, embedding array<float>"


def test_nearest_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 1.0, 1.0, 0.0]) for i in range(70)]  # one vector, many rows
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None] * 3), (303, [float("nan")] * 6), (304, [float("inf")] * 6),
             (305, [1.0]), (306, [])]
    df = frame(spark, [*rows, (None, [1.0] * 6)], SCHEMA)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = answers(ann.nearest(df, df.where("vec_id % 20 = 0"), 20))
    want = plain_nearest([r for r in rows if r[0] != 305], asked, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_nearest_of_few_and_of_none(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])], SCHEMA)
    assert answers(ann.nearest(df, df.where("vec_id = 0"), 20)) == {0: [(1, 0.5), (2, -1.0)]}
    empty = frame(spark, [], SCHEMA)
    assert ann.nearest(empty, empty).count() == 0


def test_recall_with_few_probes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    x = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.standard_normal((6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows, SCHEMA)
    got = answers(ann.nearest(df, df.where("vec_id % 50 = 0"), 20, probes=8))
    x = x.astype(np.float32).astype(float)
    hit = total = 0
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        hit += len(best & {i for i, _ in got[q]})
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("dense", [0.0, 0.2, 1.1])
def test_scan_keeps_all_within_the_limit(dense, monkeypatch):
    monkeypatch.setattr(ann, "DENSE", dense)
    monkeypatch.setattr(ann, "EPSILON", 1e6)  # no partial distance abandons: only the whole distance decides
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((7, 21)), rng.standard_normal((90, 21))
    x[40:50] = x[3]  # ties
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    limits = np.full(7, np.inf)
    limits[0] = 0.0
    at, row = ann.scan(q, x, limits, 5)
    found = set(zip(at.tolist(), row.tolist()))
    cut = np.minimum(limits, np.sort(d[:, :10], 1)[:, 4])
    assert found == {(int(i), int(j)) for i, j in np.argwhere(d <= cut[:, None] + 1e-8)}
    assert not any(i == 0 for i, _ in found)
