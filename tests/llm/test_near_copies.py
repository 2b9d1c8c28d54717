"""SimHash, connected components and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from edge import documents, texts
from joeira.llm import repeats
from joeira.llm.common import Scratch
from joeira.llm.components import connected
from joeira.llm.simhash import close_links, fingerprint, fingerprints, keep_one, near_duplicates


def union(n, links):
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low
    return low


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_hash_is_that_of_spark(spark):
    word = "éin wort 日本"
    assert spark.range(1).selectExpr(f"xxhash64('{word}') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(word.encode(), 42)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(0, k) for k in range(250, 300)] + [(k, k + 1) for k in range(100, 140)]
    out = connected(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    low = union(300, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in out} == {(x, low[x]) for x in linked} and len(out) == len(linked)
    assert connected(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


def test_simhash_of_awkward_rows(spark):
    docs = documents(spark)
    got = near_duplicates(docs).collect()
    rows = texts()
    fps = [plain_fingerprint(t) for _, t in rows]
    low = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    first = {c: min((rows[k][0] for k in range(len(rows)) if low[k] == c and rows[k][0] is not None), default=None) for c in low}
    want = [(i, f"{fps[k]:016x}", first[low[k]]) for k, (i, _) in enumerate(rows)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_links_for_any_tiles_and_lanes(spark):
    rnd = np.random.default_rng(4)
    fps = rnd.integers(-(2**63), 2**63, size=(120, 2), dtype=np.int64)
    for k in range(60):  # half of them a few bits from another
        fps[60 + k] = fps[k]
        fps[60 + k, 0] ^= np.bitwise_or.reduce(np.int64(1) << rnd.integers(0, 63, rnd.integers(1, 5)))
    fps[0] = [-1, 0]
    fps[1] = [0, 0]
    rows = [(k, int(a), [int(b)]) for k, (a, b) in enumerate(fps)]
    table = spark.createDataFrame(rows, "node bigint, fp bigint, more array<bigint>")
    plain = table.withColumn("more", F.expr("CAST(array() AS array<bigint>)"))
    apart = [[(int(a) ^ int(b)) & (2**64 - 1) for a, b in zip(x, y)] for x in fps for y in fps]

    def expected(test):
        return union(120, [(k // 120, k % 120) for k, (p, q) in enumerate(apart) if test(p.bit_count(), q.bit_count())])

    def found(links):
        return union(120, [(r.a, r.b) for r in links.collect()])

    want = expected(lambda p, q: p <= 2)
    for parts, block in ((1, 32), (2, 1000), (4, 7), (8, 50)):
        assert found(close_links(plain, 2, Scratch(spark, "test"), parts=parts, block=block)) == want
    both = close_links(table, 20, Scratch(spark, "test"), lanes=2, in_all=24, block=40)
    assert found(both) == expected(lambda p, q: p <= 20 and p + q <= 24)


def test_long_texts_do_not_change_the_count():
    text = " ".join(f"w{k % 977}" for k in range(120_003))
    assert fingerprint(text.encode())[0] % 2**64 == plain_fingerprint(text)


def test_one_of_each_group_stays(spark):
    docs = documents(spark).withColumn("uid", F.lit(1)).withColumn("row", F.lit("r"))
    for how in ((2, 3), (5, 2)):
        groups = sorted(map(tuple, near_duplicates(docs, *how).select("component_id", "doc_id").collect()), key=str)
        kept = keep_one(docs, *how).collect()
        # Of a group with an identifier, the smallest one stays, once; rows without one stay only if their whole group has none.
        want = sorted({c for c, _ in groups if c is not None})
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
        assert keep_one(docs, *how).columns == docs.columns
    ids = [r.doc_id for r in kept]
    assert 1 in ids and not {2, 3} & set(ids) and len([i for i in ids if i in (4, 5, 6)]) == 1
    assert keep_one(docs.limit(0)).count() == 0 and fingerprints(docs.limit(0)).count() == 0


def plain_repeats(rows, n=50):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - n + 1):
                s = b[p : p + n]
                seen[s] = min(seen.get(s, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if i is not None and seen[b[p : p + n]] < i:
                gone[p : p + n] = [True] * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def report(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_repeats_of_awkward_rows(spark):
    docs = documents(spark)
    assert report(repeats.repeats_report(docs)) == sorted(plain_repeats(texts()), key=str)
    assert repeats.repeats_report(docs.limit(0)).count() == 0
    cut = repeats.remove_repeats(docs.drop("score"))
    assert cut.columns[: len(docs.columns) - 1] == docs.drop("score").columns and cut.count() == docs.count()
    whole = {r.doc_id: r.text for r in cut.where("n_removed = 0").collect()}
    assert all(whole[i] == (t or "") for i, t in texts() if i in whole and i not in (None, 3))


def test_repeats_of_random_texts(spark, monkeypatch):
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abé") for _ in range(rnd.randint(20, 90))) for _ in range(12)] + ["ab" * 40, "a" * 90]
    rows = [(k if k % 9 else k - 1, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for k in range(1, 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = sorted(plain_repeats(rows), key=str)
    assert report(repeats.repeats_report(docs)) == want
    for hot_runs in (0, 40):  # every prefix, or some, dealt out by whole windows
        assert report(repeats.remove_repeats(docs, with_text=False, hot_runs=hot_runs)) == want


def test_a_passage_in_very_many_contexts_fills_no_shard():
    """Runs around a shared passage spread over the shards once its prefixes are hot."""
    rnd = random.Random(3)
    passage = bytes(rnd.randrange(256) for _ in range(60))
    texts_ = [bytes(rnd.randrange(256) for _ in range(60)) + passage + bytes(rnd.randrange(256) for _ in range(60)) for _ in range(300)]
    raw = np.frombuffer(b"".join(texts_), dtype=np.uint8)
    runs = repeats.Runs(raw, np.array([len(t) for t in texts_]), np.zeros(300, dtype=bool))
    keys, times = np.unique(runs.key, return_counts=True)
    hot = np.isin(runs.key, keys[times >= 300])
    assert hot.any()
    windows = sorted((runs.start[hot][:, None] + np.arange(runs.count[hot].max()))[np.arange(runs.count[hot].max()) < runs.count[hot][:, None]].tolist())
    runs.take(hot)
    runs.split(np.ones(len(runs.key), dtype=bool), raw)
    assert sorted(runs.start.tolist()) == windows and set(runs.count.tolist()) == {1}
    by_text = {}
    for s, key in zip(runs.start.tolist(), runs.key.tolist()):
        assert by_text.setdefault(raw[s : s + 50].tobytes(), key) == key
    assert len(set(by_text.values())) == len(by_text)
    assert np.bincount(repeats.shard_of(np.array(list(by_text.values()), dtype=np.uint64), 16)).max() < len(by_text) / 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=120), min_size=1, max_size=6), st.integers(1, 300))
def test_runs_hold_each_window_once(parts, segment):
    texts_ = [p.encode() for p in parts]
    raw = np.frombuffer(b"".join(texts_), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts_])
    before, repeats.SEGMENT = repeats.SEGMENT, segment
    try:
        runs = repeats.Runs(raw, sizes, np.zeros(len(sizes), dtype=bool))
    finally:
        repeats.SEGMENT = before
    got = sorted(s + k for s, c in zip(runs.start.tolist(), runs.count.tolist()) for k in range(c))
    first = np.cumsum(sizes) - sizes
    assert got == [int(f) + k for f, n in zip(first, sizes) for k in range(n - 49)]
    same = {}
    for s, c, key in zip(runs.start.tolist(), runs.count.tolist(), runs.key.tolist()):
        for k in range(c):
            assert same.setdefault(raw[s + k : s + k + 50].tobytes(), key) == key


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=50, max_size=400))
def test_ranks_tell_strings_apart(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    every = [text[p : p + 50] for p in range(len(text) - 49)]
    for ranks in (repeats.ranked, repeats.ranked_by_sorts):
        at, rank = ranks(raw, (len(raw) - np.arange(len(raw))).astype(np.int32), 50)
        found = {}
        for p, r in zip(at.tolist(), rank.tolist()):
            assert found.setdefault(r, text[p : p + 50]) == text[p : p + 50]
        assert len(set(found.values())) == len(found)
        assert sorted(at.tolist()) == [p for p, s in enumerate(every) if every.count(s) > 1]


def test_ranks_of_equal_names_are_compared_by_bytes(monkeypatch):
    """With a hash that gives every string one name the sorts decide."""
    raw = np.frombuffer(b"ab" * 40 + b"c" * 60, dtype=np.uint8)
    room = (len(raw) - np.arange(len(raw))).astype(np.int32)
    want = repeats.ranked_by_sorts(raw, room, 50)
    monkeypatch.setattr(repeats, "_mixed", np.zeros_like)
    got = repeats.ranked(raw, room, 50)
    assert all((a == b).all() for a, b in zip(got, want))
