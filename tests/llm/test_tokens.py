"""Token counts and piece encoding against the tokenizers' own libraries."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from edge import documents, texts
from joeira.llm import pieces
from joeira.llm.token_counts import Merges, count_tokens, piece_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ANY = st.text(alphabet=st.one_of(st.sampled_from("abe hnt'sSl\n\t  ▁<|>09#=é日½\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)



def test_counts_equal_the_library_on_many(library):
    rnd = random.Random(3)
    parts = ["in", "the", "'s", " ", "  ", "\n", "<|endoftext|>", "<|", "é", "日本", "１", "²", "\x1c", "\x85", "\xa0", "!", "--", "0", "\x00", "'LL"]
    many = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    want = [len(e.ids) for e in library.encode_batch(many, add_special_tokens=False)]
    assert [piece_counts(BYTE_BPE).of_text(t) for t in many] == want


def test_merges_of_equal_rank_go_from_the_left():
    assert Merges([(1, 1, 2), (2, 2, 3)]).needed([1] * 5) == 3
    assert Merges([]).needed([1, 2]) == 0


def test_token_counts_of_awkward_rows(spark, library):
    docs = documents(spark)
    got = sorted(map(tuple, count_tokens(docs, BYTE_BPE).collect()), key=str)
    want = []
    for i, t in texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert count_tokens(docs.limit(0), BYTE_BPE).count() == 0


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_pieces_equal_the_library(text):
    lib = SentencePieceProcessor(model_file=PIECES)
    mine = pieces.model(PIECES).encode([text])
    assert mine[0].tolist() == lib.encode(text)
    assert pieces.model(PIECES).decode(mine) == [lib.decode(lib.encode(text))]


def test_pieces_of_awkward_rows(spark):
    lib = SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark)
    out = pieces.encode(docs, PIECES, decoded=True)
    got = sorted(((r.doc_id, r.n_pieces, list(r.ids), r.decoded) for r in out.collect()), key=str)
    assert got == sorted(((i, len(lib.encode(t or "")), lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t in texts()), key=str)
    assert out.where("NOT round_trip").count() == sum("▁" in (t or "") for _, t in texts())
    back = pieces.decode(out.select("doc_id", "ids"), PIECES)
    assert sorted((r.text for r in back.collect())) == sorted(x[3] for x in got)
    assert pieces.encode(docs.limit(0), PIECES).count() == 0


def test_a_word_of_many_characters():
    lib = SentencePieceProcessor(model_file=PIECES)
    word = "".join(random.Random(1).choice("abcdeéß") for _ in range(20_000))
    assert pieces.model(PIECES).encode([word])[0].tolist() == lib.encode(word)
