"""Best-fit packing of token sequences, planned on the histogram of lengths.

Texts become token identifiers and are cut into pieces of at most ``limit`` tokens.
How many pieces there are of each length (``limit`` numbers at most) is all that
the plan needs: from the longest length to the shortest, as many pieces as
possible go at once to the open sequences with the smallest room that is
enough, and the others open new sequences, so the plan takes as long for a
billion pieces as for a thousand.  It is a short table: pieces of this length and of these ranks
go to these sequences at this offset.  Pieces are numbered within their length,
in groups of ``GROUP`` by a hash, and take the planned slots by a join on length, group and
rank.

The plan is that of best-fit decreasing piece by piece, and so needs no more than
11/9 of the fewest possible sequences and one more; usually it needs exactly as many as there must be.

Cases: a null or empty text is one piece that holds only the end mark; repeated rows and null
identifiers are pieces of their own; pieces of equal length are alike, so
which of them takes which slot does not matter; a very long text is one row in
one task; ``pack`` hands on all other columns of its pieces, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import islice
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from joeira.llm.common import Scratch, unused
from joeira.llm.token_counts import PATTERN, byte_symbols

GROUP = 4096  # pieces of one length that are numbered together
KEPT_WORDS = 800_000
AT_ONCE = 1 << 20  # characters


class WordIds(dict):
    """Identifiers, as bytes, of the parts that a byte-level tokenizer splits a text into.

    They are the ones that the tokenizer's own library gives.  With a byte-level vocabulary whose identifiers follow its
    merges, a part is merged by the same ranks in less time.  Any other tokenizer file goes to the library, text by text.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = model["added_tokens"]
        before = model.get("pre_tokenizer") or {}
        plain = ("lstrip", "rstrip", "single_word")
        # Only such a tokenizer treats each part by itself, whatever stands beside it.
        self.by_part = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("normalizer")
            and model["model"].get("type") == "BPE" and not any(x.get(k) for x in added for k in plain) and self._ranked(model["model"])
        )
        self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in added}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.parts = regex.compile(PATTERN)
        self.update(self.special)

    def _ranked(self, model: dict) -> bool:
        """Whether the identifiers are ranks, each above those of all earlier merges; ``merge`` is set if so."""
        vocabulary = model["vocab"]
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        single = {c: vocabulary[c] for c in byte_of if c in vocabulary}
        if len(single) < 256 or made != sorted(set(made)) or (made and made[0] <= max(single.values())):
            return False
        ranks = {byte_of[c]: i for c, i in single.items()}
        ranks.update((b"".join(map(byte_of.__getitem__, t)), vocabulary[t]) for t in ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]))
        self.merge = tiktoken.Encoding("parts", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return True

    def _of_text(self, text: str):
        """The parts of a text, in lists that are not too long."""
        if self.marks is not None and self.marks.search(text):
            for k, between in enumerate(self.marks.split(text)):
                if k % 2:
                    yield [between]
                else:
                    yield from self._of_text(between)
        elif len(text) < AT_ONCE:
            yield self.parts.findall(text)
        else:
            found = (m.group() for m in self.parts.finditer(text))
            while some := list(islice(found, AT_ONCE // 8)):
                yield some

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of every text, four bytes each, the lowest first."""
        if not self.by_part:
            return self._library(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0
        for k, text in enumerate(texts):
            for parts in self._of_text(text):
                waiting.append((k, parts))
                held += len(parts)
                if held > AT_ONCE // 8:
                    self._put(waiting, out)
                    waiting, held = [], 0
        self._put(waiting, out)
        return [b"".join(ids) for ids in out]

    def __missing__(self, part: str) -> bytes:
        ids = self.merge(part)
        out = pack_ids(f"<{len(ids)}I", *ids)
        if len(part) < 100:
            self[part] = out
        return out

    def _put(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.update(self.special)
        for k, parts in waiting:
            out[k].append(b"".join(map(self.__getitem__, parts)))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text: ``id, piece, start, length, ids``.

    A text is its tokens and the identifier ``end``.  Of a longer one, all pieces but the first hold ``limit`` tokens.
    ``ids`` are unsigned 32-bit numbers, the lowest byte first.
    """
    id_type = docs.schema[id_col].dataType
    mark = np.uint32(end).tobytes()

    def work(batches):
        known = word_ids(tokenizer)
        for batch in batches:
            held = [ids + mark for ids in known.encode(batch.column(1).to_pylist())]
            n = np.array([len(h) // 4 for h in held], dtype=np.int64)
            pieces = -(-n // limit)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stop = n[row] - limit * (pieces[row] - 1 - piece)
            start = np.maximum(stop - limit, 0)
            ids = [held[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(ids, pa.binary())],
                names=["id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"id {id_type.simpleString()}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length: ``length, first, last, each, sequence, offset``.

    The pieces of ranks ``first`` to ``last`` stand ``each`` in a sequence, from ``sequence`` on, beginning at ``offset``.
    """
    rooms: list[int] = []  # that some open sequence has, ascending
    opened: dict[int, list[tuple[int, int]]] = {}  # sequences with such a room: the first, how many
    out = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = opened[room].pop()
            if not opened[room]:
                del opened[room], rooms[at]
            # One after the other, a sequence is filled up before the next, for its room stays the smallest that is enough.
            each = room // length
            full = min(n, left // each)
            offset = limit - room
            if full:
                out.append((length, rank, rank + full * each - 1, each, first, offset))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left < each:
                if left:
                    out.append((length, rank, rank + left - 1, left, first + full, offset))
                    leave(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                leave(room, first + full, n - full)
        if left:
            each = limit // length
            full, rest = divmod(left, each)
            if full:
                out.append((length, rank, rank + full * each - 1, each, sequences, 0))
                leave(limit - each * length, sequences, full)
            if rest:
                out.append((length, rank + full * each, rank + left - 1, rest, sequences + full, 0))
                leave(limit - rest * length, sequences + full, 1)
            sequences += full + (rest > 0)
    return out


def pack(pieces: DataFrame, limit: int = 1024, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: their places, without gaps, in sequences of at most ``limit`` tokens.

    Columns of these two names are replaced.  A piece of no token, of null or of more than ``limit`` is an error.
    """
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession, "packing")
    length, group, rank, uid, groups, before, first, last, each, sequence, offset, n = unused(
        pieces.columns, "length", "group", "rank", "uid", "groups", "before", "first", "last", "each", "sequence", "offset", "n"
    )
    # A written number tells equal pieces apart, also when a lost task is run again.
    rows = scratch.save(pieces.withColumn(uid, F.monotonically_increasing_id()).withColumn(length, F.col(length_col).cast("int")))
    wrong = rows.where(f"{length} IS NULL OR {length} < 1 OR {length} > {limit}").select(length).first()
    if wrong:
        raise ValueError(f"a piece of {wrong[0]} tokens where 1 to {limit} fit")
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # at most ``limit`` of them
    slots = spark.createDataFrame(plan(counts, limit), f"{length} int, {first} bigint, {last} bigint, {each} bigint, {sequence} bigint, {offset} bigint")

    # Pieces of one length are spread over groups of about ``GROUP``; the groups' sizes give the rank of their first piece.
    split = spark.createDataFrame([(x, -(-c // GROUP)) for x, c in counts.items()], f"{length} int, {groups} bigint")
    grouped = rows.join(F.broadcast(split), length).withColumn(group, F.pmod(F.xxhash64(uid), F.col(groups))).drop(groups)
    sizes = grouped.groupBy(length, group).agg(F.count("*").alias(n))
    ahead = F.sum(n).over(Window.partitionBy(length).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.withColumn(before, F.coalesce(ahead, F.lit(0)))
    # The slots that a group's ranks meet; then each group takes its own.
    taken = firsts.join(slots, length).where((F.col(last) >= F.col(before)) & (F.col(first) < F.col(before) + F.col(n))).drop(n)
    within = F.row_number().over(Window.partitionBy(length, group).orderBy(uid)) - 1
    ranked = grouped.withColumn(rank, within.cast("bigint"))
    at = F.col(before) + F.col(rank)
    placed = ranked.join(taken, [length, group]).where((at >= F.col(first)) & (at <= F.col(last)))
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")],
        F.expr(f"{sequence} + ({before} + {rank} - {first}) div {each}").alias("sequence_id"),
        F.expr(f"{offset} + ({before} + {rank} - {first}) % {each} * {length}").alias("offset"),
    )


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids``, the identifiers of their pieces one after the other."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids")))).alias("parts"))
    # A sequence holds at most ``limit`` tokens, so no group is large.
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", (F.octet_length(joined) / 4).cast("bigint").alias("length"), joined.alias("ids"))
