"""Token counts by byte-pair merging, without making any token.

A text is split into pieces by the tokenizer's own pattern.  A piece starts
as one symbol per UTF-8 byte; the lowest-ranked adjacent pair is popped from a
heap and merged in a linked list until no pair is left that has a rank.  The
count is the number of symbols at the start less the number of merges; no
identifier is ever made.  Pieces recur, so counts are kept in a bounded
dictionary per worker process.

Special strings inside a text (``<|endoftext|>``) count one token each, as the
library's default has it.

Cases: a null text counts as empty (0 bytes, 0 tokens); a null identifier is
kept; repeated rows give repeated results; any further column of the input is
left out, whatever its name; an empty table gives an empty result.  A very
long text is one row in one task and is worked through piece by piece.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 1_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes follow
    in order from code point 256.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


PAIR = 20  # bits of a symbol in the key of a pair
PLACE = 40  # bits of a place in a heap entry


class Merges:
    """The merges of a vocabulary: rank by pair, and by rank both symbols and what they become."""

    def __init__(self, triples: list[tuple[int, int, int]]):
        self.left, self.right, self.made = (list(x) for x in zip(*triples)) if triples else ([], [], [])
        self.rank = {a << PAIR | b: r for r, (a, b, _) in enumerate(triples)}

    def needed(self, symbols: list[int]) -> int:
        """How many merges byte-pair encoding makes in ``symbols``."""
        rank_of = self.rank.get
        pairs = [a << PAIR | b for a, b in zip(symbols, symbols[1:])]
        # A heap entry is the rank above the place, so the lowest rank pops first, and of equal ones the leftmost.
        heap = [r << PLACE | i for i, r in enumerate(map(rank_of, pairs)) if r is not None]
        if not heap:
            return 0
        heapify(heap)
        here = list(symbols)
        n = len(here)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left, right, made, mask = self.left, self.right, self.made, (1 << PLACE) - 1
        done = 0
        while heap:
            entry = heappop(heap)
            i = entry & mask
            r = entry >> PLACE
            if here[i] != left[r]:
                continue  # merged away meanwhile
            j = after[i]
            if j >= n or here[j] != right[r]:
                continue
            here[i] = symbol = made[r]
            here[j] = -1
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                r = rank_of(symbol << PAIR | here[k])
                if r is not None:
                    heappush(heap, r << PLACE | i)
            h = before[i]
            if h >= 0:
                r = rank_of(here[h] << PAIR | symbol)
                if r is not None:
                    heappush(heap, r << PLACE | h)
        return done


class PieceCounts(dict):
    """Tokens per piece, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        self.byte_ids = [vocabulary[c] for c in byte_symbols()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.needed = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]).needed
        special = [x["content"] for x in model["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        symbols = [self.byte_ids[b] for b in piece.encode()]
        count = len(symbols) - self.needed(symbols)
        if len(self) >= KEPT_PIECES:
            self.clear()
        if len(piece) < 100:
            self[piece] = count
        return count

    def of_text(self, text: str) -> int:
        parts = [text]
        extra = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            extra = len(parts) - 1
        return extra + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


@lru_cache(maxsize=4)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """Bytes and tokens of every text: ``id, n_bytes, n_tokens, over_limit``."""
    id_type = docs.schema[id_col].dataType

    def work(batches):
        counts = piece_counts(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n_tokens = [counts.of_text(t.as_py()) for t in texts]
            n_bytes = [t.as_buffer().size for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(work, f"id {id_type.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
