"""Alignment, chat windows and importance resampling against plain Python."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import align, chat, resample, tokens, units
from tabulens.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "\n\n", "a \n b", "a\x1c b", "a\u3000 b", "a   b", "\t\tfoo\tbar baz  ", "<|endoftext|> <s></s>",
    "\x00 a", "a\r\n\r\nb \n\n c", "é️ 😀 日本 語", "x" * 5000, "▁ a▁b", "word " * 3000, "{\r\n}\r\n", "\u00a0 x \u2028y",
]


def plain_alignment(text):
    """Token ids of both sides and the groups, from whole-text encoding."""
    pair = align.pair(A, B)
    if not text:
        return [], [], []
    a, b = pair.a.encode(" " + text), pair.b.encode(" " + text)
    spelled = [b"".join(t.bytes_of[i] for i in ids) for t, ids in ((pair.a, a), (pair.b, b))]
    if any(s != (" " + text).encode() for s in spelled):
        return [], [], []
    ends = [np.cumsum([len(t.bytes_of[i]) for i in ids]).tolist() for t, ids in ((pair.a, a), (pair.b, b))]
    groups, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[x:p], b[y:q]))
        x, y = p, q
    return a, b, groups


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def digest_of(groups):
    said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(said.encode()).hexdigest() if groups else ""


# ---------------------------------------------------------------- alignment


@given(st.lists(st.text(alphabet=st.sampled_from("ab C.\n\r\t\u3000é日🙂▁<>s/0\x1c"), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_units_and_cuts_equal_whole_text_alignment(texts):
    ids_a, ids_b, n_a, n_b, last_a, last_b = align.pair(A, B).align(texts)
    at_a = at_b = at = 0
    for text, n, m in zip(texts, n_a, n_b):
        a, b, groups = plain_alignment(text)
        assert ids_a[at_a : at_a + n].tolist() == a and ids_b[at_b : at_b + m].tolist() == b
        ends_a, ends_b = last_a[at : at + len(groups)] + 1 - at_a, last_b[at : at + len(groups)] + 1 - at_b
        assert ends_a.tolist() == np.cumsum([len(x) for x, _ in groups]).tolist()
        assert ends_b.tolist() == np.cumsum([len(y) for _, y in groups]).tolist()
        at_a, at_b, at = at_a + n, at_b + m, at + len(groups)
    assert at == len(last_a)


@given(st.integers(1, 60), st.integers(0, 2**20), st.floats(0.05, 0.95))
@settings(max_examples=150, deadline=None)
def test_divide_and_conquer_finds_every_shared_end(length, seed, share):
    rng = np.random.default_rng(seed)
    a, b = (np.flatnonzero(np.r_[rng.random(length - 1) < share, True]) + 1 for _ in range(2))
    last_a, last_b = align.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    both = np.intersect1d(a, b)
    assert a[last_a].tolist() == both.tolist() == b[last_b].tolist()


def test_aligned_rows_of_odd_texts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(0, "a b", "clash"), (None, "left out", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a_ids string")
    wanted = ("a_ids", "b_ids", "a_ends", "b_ends", "n_a", "n_b", "n_groups", "groups_sha256")
    found = align.aligned(df, A, B, wanted).collect()
    assert len(found) == len(rows) - 1
    texts = {i: t for i, t, _ in rows[: len(ODD)]}
    for r in found:
        if r.doc_id == 0 and r.n_a:
            texts[0] = "a b"
        a, b, groups = plain_alignment(texts[r.doc_id])
        assert (ids_of(r.a_ids), ids_of(r.b_ids)) == (a, b)
        assert ids_of(r.a_ends) == np.cumsum([len(x) for x, _ in groups]).tolist()
        assert ids_of(r.b_ends) == np.cumsum([len(y) for _, y in groups]).tolist()
        assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256) == (len(a), len(b), len(groups), digest_of(groups))
        if r.doc_id == 0:
            texts[0] = None


def test_forgetting_units_changes_nothing(monkeypatch):
    monkeypatch.setattr(align, "KNOWN_CHARS", 9)
    pair = align.Pair(A, B)
    for text in ["one two three four five", "six one", "x" * 200 + " y", "one two"] * 3:
        ids_a, ids_b, *_ = pair.align([text])
        assert (ids_a.tolist(), ids_b.tolist()) == plain_alignment(text)[:2]


@pytest.mark.parametrize("bound,bits", [(0, 16), (20, 32), (2_000_000, 16)])
def test_link_counts_and_scores(spark, bound, bits):
    texts = ["the cat sat", "the cat ran", "a cat the", "", None, "Unaligned déjà vu 日本", "the cat sat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = align.aligned(df, A, B, ("links",), link_bits=bits).selectExpr("doc_id", "doc_id as row", "links")
    counts = align.link_counts(found, bits)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in align.link_scores(found, counts, bound, bits).collect()}
    links = {i: [(x[-1], y[-1]) for x, y in plain_alignment(t)[2]] for i, t in enumerate(texts)}
    n = {}
    for pair in (p for ps in links.values() for p in ps):
        n[pair] = n.get(pair, 0) + 1
    best = {b: max(c for (_, y), c in n.items() if y == b) for _, b in n}
    assert got == {i: (sum(n[p] == best[p[1]] for p in ps), sum(n[p] for p in ps)) for i, ps in links.items()}


@needs_data
def test_op11_query(spark):
    got = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    whole = {i: plain_alignment(t) for i, t in docs.items()}
    n = {}
    for _, _, groups in whole.values():
        for x, y in groups:
            n[x[-1], y[-1]] = n.get((x[-1], y[-1]), 0) + 1
    best = {}
    for (_, b), c in n.items():
        best[b] = max(best.get(b, 0), c)
    assert got.keys() == docs.keys()
    for i, (a, b, groups) in whole.items():
        links = [(x[-1], y[-1]) for x, y in groups]
        want = (len(a), len(b), len(groups), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links), digest_of(groups))
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want


def test_alignment_of_an_empty_table(spark):
    assert align.aligned_documents(spark.createDataFrame([], "doc_id bigint, text string"), A, B).collect() == []


def test_runs_that_share_a_hash_are_told_apart(monkeypatch):
    """With a hash of nothing but the salt's second value, all runs collide once and are then hashed anew."""
    hashed = units.Units._hashed

    def poor(self, chars, place, start):
        found = hashed(self, chars, place, start)
        return found if self.salt else found % np.uint64(2)

    monkeypatch.setattr(units.Units, "_hashed", poor)
    pair = align.Pair(A, B)
    for text in ["one two three four five", "two one"] * 2:
        ids_a, ids_b, *_ = pair.align([text, None, text])
        assert (ids_a.tolist(), ids_b.tolist()) == tuple(x * 2 for x in plain_alignment(text)[:2])
    assert pair.known.salt == 1


# ---------------------------------------------------------------- chat windows


def escape(text):
    return re.sub(r"(\\|<(?=/?s>)|\[(?=/?INST\]))", r"\1\\", text)


def size_of(text):
    return max(len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0b\x0c\r]", text)), len(text) // 16) + chat.TURN_TOKENS


def plain_windows(turns, budget, history):
    """(block, repeated turns, new turns) of one conversation, turn by turn."""
    sizes = [size_of(t) for _, t in turns]
    lead = turns[0][0] == chat.SYSTEM and sizes[0] <= budget // 2
    room, span = budget - history - (sizes[0] if lead else 0), chat.BLOCK * budget
    long, before, used, block, new, out = sum(sizes) > span, 0, 0, None, [], []
    for i, size in enumerate(sizes):
        own, here = 0 if lead and i == 0 else size, before // span if long else 0
        if new and (here != block or used + own > room):
            out.append((block, new))
            new, used = [], 0
        block, used, before = here, used + own, before + size
        new.append(i)
    out.append((block, new))
    windows = []
    for block, new in out:
        again, held, i = [], 0, new[0] - 1
        while i >= lead and held + sizes[i] <= history:
            again.insert(0, i)
            held, i = held + sizes[i], i - 1
        windows.append((block, ([0] if lead and new[0] else []) + again, new))
    return windows


MARKED = st.text(alphabet=st.sampled_from("\\<s>/[INST] aé\n"), max_size=24)


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    random.seed(3)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "/", "[", "INST]", "a", "\n", "é", "<\\s>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped("t").alias("e"))
    for r in df.select("t", "e", chat.unescaped("e").alias("u")).collect():
        assert r.u == r.t and r.e == escape(r.t) and not re.search(r"</?s>|\[/?INST\]", r.e)


def conversations():
    random.seed(5)
    parts = ["a", "b1", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "é", "<", "日本", "\n"]
    rows = []
    for conv in range(10):
        for turn in range(random.choice([1, 3, 40, 300])):
            role = "system" if turn == 0 and conv % 2 else random.choice(["user", "assistant", "system" if turn % 17 == 5 else "tool"])
            rows.append((conv, turn, role, " ".join(random.choices(parts, k=random.randint(0, 25)))))
    return rows


@pytest.mark.parametrize("limit", [100_000, 0])
def test_windows_equal_plain_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "BROADCAST_LONG", limit)
    budget, history, rows = 64, 16, conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = sorted(chat.formatted(df, budget, history).collect(), key=lambda r: (r.conv_id, r.block, r.window))
    said = {c: [(r, t) for x, _, r, t in rows if x == c] for c in {r[0] for r in rows}}
    want = [(c, turns, w) for c, turns in sorted(said.items()) for w in plain_windows(turns, budget, history)]
    assert len(got) == len(want) and max(r.block for r in got) > 3
    for r, (conv, turns, (block, again, new)) in zip(got, want):
        text = "".join(f"<s>[INST]{escape(turns[i][0])}[/INST]{escape(turns[i][1])}</s>" for i in again + new)
        assert (r.conv_id, r.block, r.text, r.n_repeated, r.n_turns) == (conv, block, text, len(again), len(again + new))
        assert [r.text[s.start : s.start + s.length] for s in r.loss] == [escape(turns[i][1]) for i in new if turns[i][0] == "assistant"]
        assert r.n_tokens <= budget or len(new) == 1


def check_digests(rows, found):
    said = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        said.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {r.conv_id for r in found} == said.keys()
    for r in found:
        whole = "".join(f"{role}\n{text}\n" for role, text in said[r.conv_id])
        loss = "".join(text for role, text in said[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said[r.conv_id]), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_every_target_is_read_back_once(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    check_digests(rows, chat.digests(chat.formatted(df, 64, 16)).collect())


def test_chat_edges(spark):
    big = "word " * 300_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 1, "assistant", big), (1, 2, "assistant", ""), (2, 5, "assistant", "same"),
        (2, 5, "assistant", "same"), (None, 1, "user", "left out"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, tokens string")
    found = chat.digests(chat.formatted(df)).collect()
    check_digests([(c, -1 if t is None else t, r, x) for c, t, r, x in rows], found)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted(empty).collect() == []
    with pytest.raises(ValueError):
        chat.formatted(empty, 100, 50)


def test_chat_runs_without_python(spark):
    df = spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@needs_data
def test_op12_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    check_digests(rows, QUERIES["op12_chat_windows"](spark, SMALL).collect())


# ---------------------------------------------------------------- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, max_run=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]


def plain_resampling(docs, bench, percent=10, min_words=20, max_run=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *plain_features(t, max_run)) for i, t in docs]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, _, features in found:
        np.add.at(s, [bucket(f) for f in features], 1)
    for text in bench:
        np.add.at(t, [bucket(f) for f in plain_features(text, max_run)[1]], 1)
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    gain = [math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist())]
    rows, able = [], []
    for i, words, features in found:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(features), weight, score))
        if len(words) >= min_words:
            able.append((-score, i))
    drawn = {i: r + 1 for r, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100])}
    return sorted((*r, drawn.get(r[0])) for r in rows)


def rows_of(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@given(st.lists(st.text(alphabet=st.sampled_from("aBÉ9_ -\x7f\u00a0日"), max_size=20), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_features_are_runs_of_words(texts):
    for max_run in (1, 3):
        hasher = resample.Hasher(max_run, 97)
        for text in texts:
            words, features = plain_features(text, max_run)
            n, buckets = hasher.of(text)
            assert n == len(words) and buckets.tolist() == [zlib.crc32(f.encode()) % 97 for f in features]


def test_resampling_equals_plain_ranking(spark):
    rng = random.Random(4)
    docs = [(i * 3 - 50, " ".join(rng.choices(["alpha", "Beta", "gamma", "delta", "éta"], k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(9001, None), (9002, ""), (9003, "alpha " * 200_000)]
    df = spark.createDataFrame([(*d, 7) for d in docs] + [(None, "left out", 7)], "doc_id bigint, text string, score int")
    bench = ["alpha beta", None, "alpha omega"]
    target = spark.createDataFrame([(b,) for b in bench], "text string")
    got = resample.resampled(df, target, 25, 3, 2, 50, 7)
    assert rows_of(got) == plain_resampling(docs, bench, 25, 3, 2, 50, 7)
    nothing = spark.createDataFrame([], "text string")
    assert rows_of(resample.resampled(df, nothing, min_words=3)) == plain_resampling(docs, [], min_words=3)
    assert resample.resampled(df.limit(0), target).collect() == []


def test_repeated_ids_take_ranks_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b c")] * 6 + [(2, "a b c"), (3, "a")], "doc_id bigint, text string")
    got = resample.resampled(df, df, 100, 3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 8)) and len(got) == 8


@pytest.mark.parametrize("bits,rows", [(3, 1), (4, 7), (12, 1 << 18)])
def test_radix_ranks(spark, bits, rows):
    rng = random.Random(bits)
    keys = [(rng.choice([5, rng.randint(-(1 << 40), 1 << 40)]), i) for i in range(400)] + [(-(1 << 63), 7), ((1 << 63) - 1, 7)]
    df = spark.createDataFrame(keys, "score bigint, id bigint").repartition(5)
    got = sorted((r["rank"], r.score, r.id) for r in resample.radix_ranked(df, [("score", True), ("id", False)], bits + 8, rows).collect())
    want = sorted(keys, key=lambda k: (-k[0], k[1]))
    assert got == [(n + 1, *k) for n, k in enumerate(want)]


@needs_data
def test_op13_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op13_resampling"](spark, SMALL)) == plain_resampling(docs, bench)


# ---------------------------------------------------------------- the license query


LICENSED = {
    "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "This program is free software under the GNU General Public License version 3.": "gpl,gpl-3.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "It was released under pressure of the new license": "",
    "Licensed under the Apache License,\nVersion 2.0": "apache,apache-2.0",
    "Released under the MIT License.": "mit,mit-notice",
    None: "",
}


def test_op2_query_gives_exactly_the_labels_of_a_notice(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_licenses"](spark, str(tmp_path)).collect()}
    assert [got[i].labels for i in range(len(LICENSED))] == list(LICENSED.values())
    assert [q for q in QUERIES if q.startswith("op2_")] == ["op2_licenses"]


def plain_base(text):
    """n_words, n_base, first_word, last_word, base_labels as the contract words them."""
    words = WORD.findall((text or "").translate(LOWER))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@needs_data
def test_op2_query_base_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op2_licenses"](spark, SMALL).collect()
    assert {r.doc_id for r in got} == docs.keys() and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


# ---------------------------------------------------------------- token shards


@pytest.mark.parametrize("shard_ids", [3, 40, 1 << 22])
def test_looking_up_documents_equals_reading_all(spark, shard_ids):
    rows = [(i * 7 - 30, "word " * (i % 5)) for i in range(60)] + [(5, None), (5, "again"), (5, "again"), (10**12, "far")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    manifest = tokens.write_shards(df, tokenizer_path(), shard_ids=shard_ids)
    every = sorted(tuple(r) for r in tokens.read_shards(manifest).collect())
    assert len(every) == len(rows) and [r[1] for r in every][0] == 0
    asked = [5, 5, -30, 10**12, 6, None, -(10**15), 10**15, 19]
    wanted = spark.createDataFrame([(d,) for d in asked], "doc_id bigint")
    assert sorted(tuple(r) for r in tokens.look_up(manifest, wanted).collect()) == [r for r in every if r[0] in asked]
    assert tokens.look_up(manifest.limit(0), wanted).collect() == []


@given(st.lists(st.integers(0, 1 << 34), min_size=1, max_size=900), st.integers(0, 900), st.integers(0, 400))
@settings(max_examples=80, deadline=None)
def test_runs_of_values_come_from_the_listed_bits(values, start, count):
    values = sorted(values)
    coded = tokens.EliasFano(tokens.ef_encode(np.array(values, np.uint64), values[-1]))
    assert coded.values(start, count).tolist() == values[start : start + count]
