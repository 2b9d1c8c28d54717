"""Phrases that stand together more often than their parts, by prefix-free parsing.

Texts are cut into *chunks* where their content says so: wherever the hash of
``max_words - 1`` neighbouring words is divisible by ``TRIGGER``, a chunk ends with
those words and the next one begins with them.  Equal passages are cut alike, so
the distinct chunks form a dictionary with a frequency each, and a passage that
many texts share is in it once.  Neighbouring chunks overlap by one word less
than the longest phrase; a phrase belongs to the chunk in which it starts before
the overlap, so each occurrence counts once.

Phrases are counted inside the distinct chunks, each weighted with the frequency
of its chunk, first single words, then two words and so on.  A phrase is only
looked at if its first and its last words without one are frequent; a
filter of at most ``FILTER_BITS`` bits lets all of those pass (and some more, which
the exact counts then remove).

What grows: the dictionary is at most the texts and their overlaps; what is
shuffled are chunks and phrases with a count per task, so neither a common
chunk nor a common word is a heavy group.

Cases: a null text counts as empty, a null language as ``und``; empty texts and
pieces without words give nothing; repeated rows count again; a text of any
length is worked through in segments that overlap like chunks; phrases of equal
score and count are ordered by their bytes; other columns are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from joeira.llm.common import Scratch
from joeira.llm.licenses import mixed

TRIGGER = 8
LONGEST = 64  # words in a chunk without its overlap, where no trigger comes
AT_ONCE = 4 << 20  # bytes of text
FILTER_BITS = 1 << 28
NO_LANGUAGE = "und"
_POWERS = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))
BLANK = pa.scalar(" ", pa.large_string())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[list(b" \t")] = True
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK[list(_BREAKS)] = True
_WORD = re.compile(rb"[^ \t]+")


def segments(text: bytes, overlap: int, size: int = AT_ONCE) -> list[tuple[bytes, bool]]:
    """``text`` in parts of about ``size`` bytes, and whether the last piece of a part goes on in the next.

    If it does, the next part begins with the last ``overlap`` words of this one.
    """
    out, at, take = [], 0, size
    while len(text) - at > take:
        window = text[at : at + take]
        last = max(window.rfind(b) for b in _BREAKS)
        if last >= 0:
            out.append((window[: last + 1], False))
            at, take = at + last + 1, size
            continue
        end = max(window.rfind(b" "), window.rfind(b"\t"))
        words = [m.start() for m in _WORD.finditer(window[: max(end, 0)])]
        if len(words) <= overlap:
            take *= 2  # one very long word, or blanks
            continue
        out.append((window[:end], True))
        at, take = at + words[-overlap] if overlap else at + end, size
    out.append((text[at:], False))
    return out


def words_in(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, runs of ``inside`` that end with their row, and the place of each one's first byte."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    at = np.flatnonzero(inside & (edge[:-1] | ~before))
    sizes = np.flatnonzero(inside & (edge[1:] | ~after)) + 1 - at
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]), at


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins."""
    values = values.cast(pa.large_string() if pa.types.is_string(values.type) else values.type).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash for each text, of its bytes alone.  Equal hashes of different texts do no harm: they place cuts and let phrases pass a filter."""
    data, offsets = _bytes_of(values)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _POWERS[at % len(_POWERS)], out=sums[1:])
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]])


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``, ``sizes[0]`` of them, then those of the next."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, dtype=np.int64)


def chunks_of(texts: list[bytes], is_open: list[bool], overlap: int, trigger: int = TRIGGER, longest: int = LONGEST) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For every chunk of ``texts``: the text's number, the words with one blank between them, how many phrase starts it owns."""
    raw, offsets = _flat(texts)
    breaks = _BREAK[raw]
    words, at = words_in(_LOWER[raw], offsets, ~(breaks | _BLANK[raw]))
    n = len(at)
    if not n:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    of = np.searchsorted(offsets, at, "right") - 1
    piece = np.cumsum(breaks)[at] + of
    new = np.concatenate([[True], (np.diff(piece) > 0) | (np.diff(of) > 0)])
    first = np.flatnonzero(new)
    end_of = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))  # of each word's piece

    starts = new.copy()
    if overlap and n > overlap:
        coded = words.dictionary_encode()
        word = _hashes(coded.dictionary)[coded.indices.to_numpy()]
        near = np.zeros(n - overlap, dtype=np.uint64)
        for k in range(overlap):
            near = mixed(near + word[k : n - overlap + k])
        cuts = np.flatnonzero(near % np.uint64(trigger) == 0)
        starts[cuts[cuts + overlap < end_of[cuts]]] = True
    begins = np.flatnonzero(starts)
    sizes = np.diff(np.append(begins, n))
    pieces = -(-sizes // longest)
    begins = np.repeat(begins, pieces) + longest * ranges(np.zeros(len(pieces), dtype=np.int64), pieces)
    nexts = np.append(begins[1:], n)
    ends = np.minimum(nexts + overlap, end_of[begins])
    # A piece that goes on in the next part leaves the words of the overlap to it.
    goes_on = np.array(is_open, dtype=bool)[of[begins]] & (end_of[begins] == np.searchsorted(of, of[begins], "right"))
    owned = np.minimum(nexts, end_of[begins] - np.where(goes_on, overlap, 0)) - begins
    keep = owned > 0
    begins, ends, owned = begins[keep], ends[keep], owned[keep]
    sizes = ends - begins
    listed = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), words.take(pa.array(ranges(begins, sizes))).cast(pa.large_string()))
    return of[begins], pc.binary_join(listed, BLANK).cast(pa.string()), owned


def _grouped(rows, size_of, limit: int = AT_ONCE):
    """Lists of rows that hold about ``limit`` bytes."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += size_of(row)
        if held >= limit:
            yield kept
            kept, held = [], 0
    if kept:
        yield kept


def dictionary(docs: DataFrame, overlap: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, chunk, owned, n``: every distinct chunk with its frequency."""

    def work(batches):
        for batch in batches:
            langs = batch.column(0)
            parts = ((k, *part) for k, t in enumerate(batch.column(1).cast(pa.large_binary())) for part in segments(t.as_py(), overlap))
            for group in _grouped(parts, lambda p: len(p[1])):
                of, chunks, owned = chunks_of([p[1] for p in group], [p[2] for p in group], overlap)
                rows = np.array([p[0] for p in group], dtype=np.int64)[of]
                out = pa.table({"lang": langs.take(pa.array(rows)), "chunk": chunks, "owned": pa.array(owned.astype(np.int32))})
                yield from out.group_by(["lang", "chunk", "owned"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "owned", "n"]).combine_chunks().to_batches()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''")
    found = rows.mapInArrow(work, "lang string, chunk string, owned int, n bigint")
    return found.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


class Chunks:
    """Some chunks (or phrases) in arrays over all their words."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = _bytes_of(texts)
        words, at = words_in(data, offsets, data != ord(" "))
        coded = words.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.row = np.searchsorted(offsets, at, "right") - 1
        self.size = np.bincount(self.row, minlength=len(texts))
        self.place = np.arange(len(at)) - (np.cumsum(self.size) - self.size)[self.row]
        coded = langs.dictionary_encode()
        self.lang, self.langs = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    @cached_property
    def word_hash(self) -> np.ndarray:
        return _hashes(self.words)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the ``n`` words from each place, and the language."""
        out = _hashes(self.langs)[self.lang[self.row[at]]]
        for k in range(n):
            out = mixed(out + self.word_hash[self.ids[at + k]])
        return out

    def phrases(self, at: np.ndarray, n: int, weight: np.ndarray) -> pa.RecordBatch:
        """The distinct phrases of ``n`` words from the places ``at``, with the sum of the weights."""
        key, most = self.lang[self.row[at]], len(self.langs)
        for k in range(n):
            if most * len(self.words) >= 1 << 62:
                shown, key = np.unique(key, return_inverse=True)
                most = len(shown)
            key, most = key * len(self.words) + self.ids[at + k], most * len(self.words)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0])) if len(order) else order
        first = at[order[new]]
        sums = np.add.reduceat(weight[order], new) if len(order) else weight
        texts = [self.words.take(pa.array(self.ids[first + k])).cast(pa.large_string()) for k in range(n)]
        joined = pc.binary_join_element_wise(*texts, BLANK) if n > 1 else texts[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[self.row[first]])), joined.cast(pa.string()), pa.array(sums)], names=["lang", "phrase", "f"])


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of a filter that each hash sets."""
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def phrase_filter(phrases: DataFrame, n: int) -> np.ndarray:
    """A bitmap that holds all of ``phrases`` (``lang, phrase`` of ``n`` words each), of at most ``FILTER_BITS`` bits."""
    bits = 1 << 15
    wanted = min(FILTER_BITS, 16 * phrases.count())
    while bits < wanted:
        bits *= 2

    def work(batches):
        for batch in batches:
            rows = Chunks(batch.column(1), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(bit_places(rows.hashes(np.flatnonzero(rows.place == 0), n), bits).ravel())], names=["bit"])

    parts = phrases.select("lang", "phrase").mapInArrow(work, "bit bigint").groupBy(F.expr("shiftright(bit, 15)").alias("part"))
    out = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for r in parts.agg(F.expr("bitmap_construct_agg(bit & 32767L)").alias("map")).toLocalIterator():
        out[r.part] = np.frombuffer(r.map, dtype=np.uint8)
    return out.ravel()


def count_phrases(chunks: DataFrame, n: int, parts_of=None) -> DataFrame:
    """``lang, phrase, f``: occurrences of every phrase of ``n`` words, or of those whose two parts of ``n - 1`` words pass a filter."""

    def work(batches):
        passing = parts_of.value if parts_of is not None else None

        def passes(rows: Chunks, at: np.ndarray) -> np.ndarray:
            a, b = bit_places(rows.hashes(at, n - 1), len(passing) * 8)
            return (passing[a >> 3] >> (a & 7) & passing[b >> 3] >> (b & 7) & 1).astype(bool)

        for group in _grouped(batches, lambda b: b.column(1).nbytes):
            table = pa.Table.from_batches(group).combine_chunks()
            langs, texts, owned, freq = (c.chunk(0) for c in table.columns) if table.num_rows else [pa.array([], f.type) for f in table.schema]
            rows, freq = Chunks(texts, langs), freq.to_numpy()
            at = np.flatnonzero((rows.place < owned.to_numpy()[rows.row]) & (rows.place + n <= rows.size[rows.row]))
            if passing is not None:
                at = at[passes(rows, at)]
                at = at[passes(rows, at + 1)]
            yield rows.phrases(at, n, freq[rows.row[at]])

    found = chunks.select("lang", "chunk", "owned", "n").mapInArrow(work, "lang string, phrase string, f bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(chunks: DataFrame, min_count: int, max_words: int, scratch: Scratch) -> DataFrame:
    """``lang, phrase, f, size``: all phrases of up to ``max_words`` words that occur ``min_count`` times or more."""
    spark, passing, out = chunks.sparkSession, None, None
    for n in range(1, max_words + 1):
        found = scratch.save(count_phrases(chunks, n, passing).where(F.col("f") >= min_count).withColumn("size", F.lit(n)))
        out = found if out is None else out.unionByName(found)
        if n < max_words:
            passing = spark.sparkContext.broadcast(phrase_filter(found, n))
    return out


def collocations(
    docs: DataFrame, min_count: int = 30, max_words: int = 4, covered: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts at the cut with the lowest score, ``n`` all words of the
    language, and the score 2,000,000 a / (l + r).  Phrases that stand inside a longer one in ``covered`` percent of their
    places or more are left out.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    chunks = scratch.save(dictionary(docs, max_words - 1, lang_col, text_col))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("owned")).alias("n"))
    known = frequent_phrases(chunks, min_count, max_words, scratch)
    phrases = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))

    def part(first: str, count: str):
        return F.array_join(F.expr(f"slice(words, {first}, {count})"), " ")

    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select("lang", "phrase", "a", "k", part("1", "k").alias("left"), part("k + 1", "size - k").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))

    inner = phrases.where("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("from", F.explode(F.expr("sequence(1, size - m + 1)")))
    longer = inner.select("lang", part("from", "m").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(22,0)) * 100 < CAST(a AS DECIMAL(22,0)) * {int(covered)}")
    # Ranks are cut in each task before the shuffle, so a common language moves ``top`` rows a task.
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
