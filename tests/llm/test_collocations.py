"""Phrase counts and collocations against counting word by word."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from edge import documents, texts
from joeira.llm import collocations as c

UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plain_counts(rows) -> Counter:
    """Occurrences of every phrase of one to four words by language."""
    found = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            for k in range(len(words)):
                for n in range(1, min(4, len(words) - k) + 1):
                    found[lang if lang is not None else "und", tuple(words[k : k + n])] += 1
    return found


def plain(rows, least: int, covered: int, top: int) -> list[tuple]:
    f = plain_counts(rows)
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                if 100 * a >= covered * f[lang, p[k : k + m]]:
                    inside.add((lang, p[k : k + m]))
    scored = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in scored.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def in_chunks(many: list[str], overlap: int, **how) -> Counter:
    found = Counter()
    parts = [p for t in many for p in c.segments(t.encode(), overlap, how.get("size", 1 << 20))]
    _, chunks, owned = c.chunks_of([p for p, _ in parts], [o for _, o in parts], overlap, how.get("trigger", 2), how.get("longest", 5))
    for chunk, own in zip(chunks.to_pylist(), owned.tolist()):
        words = chunk.split(" ")
        for k in range(own):
            for n in range(1, min(overlap + 1, len(words) - k) + 1):
                found["und", tuple(words[k : k + n])] += 1
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abAé日 \t\n.,\x00\x1c", max_size=80), max_size=5), st.integers(4, 60))
def test_chunks_own_every_phrase_once(many, size):
    assert in_chunks(many, 3, size=size) == plain_counts([(t, None) for t in many])


def test_a_long_text_in_segments():
    rnd = random.Random(4)
    words = ["a", "bb", "x" * 300, "é", "to"]
    text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". "]) for _ in range(3000)) + " ".join(["same"] * 3000)
    for size in (20, 200, 5000):
        assert len(c.segments(text.encode(), 3, size)) > 1
        assert in_chunks([text], 3, size=size, longest=16) == plain_counts([(text, None)])


def test_equal_passages_give_equal_chunks():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rnd.choice(words) for _ in range(400))
    texts_ = [(" ".join(rnd.choice(words) for _ in range(50)) + " " + passage).encode() for _ in range(10)]
    of, chunks, _ = c.chunks_of(texts_, [False] * 10, 3)
    seen = [{x for x, k in zip(chunks.to_pylist(), of) if k == i} for i in range(10)]
    assert len(set.intersection(*seen)) > 20


def corpus(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["la", "Casa", "de", "NU", "é", "日本", "x1", "\x00", "straße"]
    fixed = ["one two three four", "de la casa", "x1 x1 x1 x1 x1"]
    rows = [(rnd.choice([".", " ", "\n", " ; "]).join(rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", None, "und", "fr"])) for _ in range(n)]
    return rows + [rows[0]] * n + [(None, "en"), ("", None)]


@pytest.mark.parametrize("seed, covered, top", [(1, 80, 2000), (2, 50, 7), (3, 100, 2000)])
def test_collocations_equal_plain_counting(spark, monkeypatch, seed, covered, top):
    rows = corpus(seed, 150)
    frame = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, f bigint, phrase string, n int")
    monkeypatch.setattr(c, "AT_ONCE", 700)
    got = sorted(map(tuple, c.collocations(frame.repartition(5), 3, 4, covered, top).collect()))
    assert got == plain(rows, 3, covered, top)


def test_a_small_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(6, 60)
    monkeypatch.setattr(c, "FILTER_BITS", 1)
    got = sorted(map(tuple, c.collocations(spark.createDataFrame(rows, "text string, lang string"), 2).collect()))
    assert got == plain(rows, 2, 80, 2000)


def test_collocations_of_awkward_rows(spark):
    docs = documents(spark)
    langs = [r.lang for r in docs.select("lang").collect()]
    got = sorted(map(tuple, c.collocations(docs, 2).collect()))
    assert got == plain([(t, g) for (_, t), g in zip(texts(), langs)], 2, 80, 2000)
    assert c.collocations(docs.limit(0)).count() == 0
    assert c.collocations(docs.where("text IS NULL")).count() == 0
