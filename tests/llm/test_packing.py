"""Packing against best-fit decreasing piece by piece, and identifiers against the tokenizer's own library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from edge import documents, texts
from joeira.llm import packing
from joeira.llm.packing import cut, pack, plan, sequences, word_ids

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE_BPE, WORD_BPE)}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def plain_best_fit(lengths: list[int], limit: int) -> int:
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(limit - x)
    return len(rooms)


def filled(slots, limit: int) -> dict[int, list[tuple[int, int]]]:
    """Offsets and lengths in each sequence."""
    held = defaultdict(list)
    for length, first, last, each, sequence, offset in slots:
        for k in range(last - first + 1):
            held[sequence + k // each].append((offset + k % each * length, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return held


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 40).flatmap(lambda limit: st.tuples(st.just(limit), st.lists(st.integers(1, limit), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    limit, lengths = case
    slots = plan(Counter(lengths), limit)
    held = filled(slots, limit)
    assert sorted(length for parts in held.values() for _, length in parts) == sorted(lengths)
    assert len(held) == plain_best_fit(lengths, limit) and sorted(held) == list(range(len(held)))
    ranks = defaultdict(list)
    for length, first, last, *_ in slots:
        ranks[length] += range(first, last + 1)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())


def test_plan_grows_with_lengths_only():
    rnd = random.Random(2)
    few = {x: rnd.randint(1, 50) for x in range(1, 1025)}
    many = plan({x: 10**7 * n for x, n in few.items()}, 1024)
    assert len(many) < 20_000
    total = sum(x * n * 10**7 for x, n in few.items())
    used = max(s + (last - first) // each for _, first, last, each, s, _ in many) + 1
    assert used <= 1.02 * total / 1024


def check(rows, docs, library, limit: int, end: int = 2):
    held = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    want = defaultdict(list)
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        first = len(ids) % limit or min(limit, len(ids))
        cuts = [0, *range(first, len(ids) + 1, limit)]
        want[i] += [(k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {i: sorted(p) for i, p in by_doc.items()} == {i: sorted(p) for i, p in want.items()}
    lengths = [p[2] for parts in want.values() for p in parts]
    assert len(held) == plain_best_fit(lengths, limit)


@pytest.mark.parametrize("limit, group", [(64, 5), (1024, 4096)])
def test_awkward_documents(spark, library, monkeypatch, limit, group):
    monkeypatch.setattr(packing, "GROUP", group)
    docs = documents(spark)
    packed = pack(cut(docs, BYTE_BPE, limit), limit)
    rows = packed.collect()
    check(rows, texts(), library, limit)
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, bytes(r.ids)))
    assert {s: b"".join(x for _, x in sorted(p)) for s, p in held.items()} == {s: bytes(r.ids) for s, r in whole.items()}
    assert all(r.length == len(r.ids) // 4 for r in whole.values())
    assert pack(cut(docs.limit(0), BYTE_BPE, limit), limit).count() == 0


def test_many_equal_rows_and_clashing_names(spark, library):
    rows = [(7, "the same", 1, 2, 3)] * 500 + [(k, "word " * (k % 40), k, k, k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int, length int, `group` int").repartition(7)
    pieces = cut(docs, BYTE_BPE, 32).selectExpr("*", "1 AS offset", "2 AS rank", "3 AS uid", "4 AS each", "'x' AS `group`", "5 AS sequence")
    out = pack(pieces, 32)
    assert out.columns == [c for c in pieces.columns if c != "offset"] + ["sequence_id", "offset"]
    check(out.collect(), [(r[0], r[1]) for r in rows], library, 32)


def test_a_length_that_cannot_be(spark):
    for length in (0, 9, None):
        with pytest.raises(ValueError):
            pack(spark.createDataFrame([(1, 3), (2, length)], "id int, length bigint"), 8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abe hnt'sSl\n\t  ▁<|>09#=é日½\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_identifiers_equal_the_library(many):
    for path in (BYTE_BPE, WORD_BPE):
        want = [np.array(e.ids, "<u4").tobytes() for e in LIBRARY[path].encode_batch(many, add_special_tokens=False)]
        assert word_ids(path).encode(many) == want


def test_every_piece_of_the_vocabulary(library):
    every = [t for t in (library.decode([k]) for k in range(50_257)) if t]
    mixed = [a + b for a, b in zip(every, random.Random(4).sample(every, len(every)))]
    for many in (every, mixed):
        assert word_ids(BYTE_BPE).encode(many) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(many, add_special_tokens=False)]


def test_identifiers_of_long_and_marked_texts(library, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 100)
    monkeypatch.setattr(packing, "KEPT_WORDS", 30)
    rnd = random.Random(3)
    parts = ["in", "the", "'s", " ", "  ", "\n", "<|endoftext|>", "<|", "é", "日本", "１", "²", "\x1c", "\x85", "\xa0", "!", "--", "0", "\x00", "'LL", " word"]
    many = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    assert word_ids(BYTE_BPE).by_part and not word_ids(WORD_BPE).by_part
    assert word_ids(BYTE_BPE).encode(many) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(many, add_special_tokens=False)]


def test_the_query(spark, library, tmp_path):
    from joeira.llm.queries import QUERIES

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_packing"](spark, str(tmp_path)).collect()
    crcs = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert crcs == want
