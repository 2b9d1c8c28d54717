"""License scans by diagonal voting.

Every pair of neighbouring words of every text (a rolling word 2-gram) is
hashed and joined by Spark to the places of the same 2-gram in a few known
license phrases and notices.  A hit votes for the diagonal *place in the text
less place in the template*: words that stand as in the template share one.
A phrase stands wherever a diagonal holds a vote for each of its 2-grams.  For
the longer notices neighbouring diagonals (a word put in or left out) are
merged, and a label is given when the merged span, which may not be much longer
than the notice, holds at least ``COVERAGE`` of the notice's 2-grams, and all of
those that tell the notice from its like (version 2 from version 3): these
are never made up for by others.  Each vote is
verified against the words themselves, so an equal hash alone never counts.

The templates are a fixed list, a few hundred 2-grams whatever the input, and
so may be broadcast; the text side of the join is not shuffled at all, only
the votes are.

Cases: a null text counts as empty (0 words, no label, score 0); a null
identifier is kept; repeated rows are scanned apart and give a row each; other
columns of the input are left out, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# The phrases whose every place counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices in common use, the labels that the method adds for them, and the word pairs that tell each from its like:
# a place without all of these is no place of the notice, whatever else it holds.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": ("gpl-3.0", "version 3"),
    "this work is licensed under the gnu general public license version 2": ("gpl-2.0", "version 2"),
    "this work is licensed under the gnu general public license v3": ("gpl-3.0", "license v3"),
    "this work is licensed under the gnu general public license v2": ("gpl-2.0", "license v2"),
    "licensed under the apache license version 2 0": ("apache-2.0", "apache license", "version 2", "2 0"),
    "licensed under the apache license v2 0": ("apache-2.0", "apache license", "v2 0"),
    "licensed under cc by 4 0": ("cc-by-4.0", "cc by", "by 4", "4 0"),
    "licensed under cc by sa 4 0": ("cc-by-sa-4.0", "by sa", "sa 4", "4 0"),
    "licensed under cc by nc 4 0": ("cc-by-nc-4.0", "by nc", "nc 4", "4 0"),
    "released under the mit license": ("mit-notice", "mit license"),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit-text", "hereby granted"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd-text", "binary forms"),
    "subject to the terms of the mozilla public license v 2 0": ("mpl-2.0", "mozilla public", "2 0"),
}
COVERAGE = 0.5  # of the word pairs: one replaced word costs two of them
NEAR = 3  # diagonals at most this far apart are one place
LONGER = 1.6  # a span may be this many times as long as its notice
CHUNK = 1 << 20  # bytes hashed at a time
BASE = 0x9E3779B97F4A7C15  # an odd number, so it has an inverse modulo 2**64
MARK = -1  # place of the row that stands for the text itself, and its 2-gram in the join


def _word_table() -> np.ndarray:
    """1 for bytes that belong to words: digits, letters and all of the non-ASCII."""
    word = np.zeros(256, dtype=np.int8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        word[first : last + 1] = 1
    return word


WORD = _word_table()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in lower-cased UTF-8 ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(WORD[raw], prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    size = 1 << max(10, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def two_grams(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(3) + words[1:]).view(np.int64)


def template_rows(phrases: dict[str, str], notices: dict[str, str | tuple]) -> list[tuple]:
    """``gram, pair, template, label, base, t_pos, n_grams, own, n_own`` for each 2-gram of each template.

    ``own`` says that the 2-gram tells the template from its like, ``n_own`` how many of the template's do.
    """
    rows = []
    for base, templates in ((True, phrases), (False, notices)):
        for text, label in templates.items():
            label, *own = (label,) if isinstance(label, str) else label
            data = text.encode()
            starts, ends, hashes = words_of(data)
            if len(starts) < 2:
                raise ValueError(f"a template needs two words at least: {text!r}")
            pairs = [(data[starts[i] : ends[i]] + b" " + data[starts[i + 1] : ends[i + 1]]).decode() for i in range(len(starts) - 1)]
            if not set(own) <= set(pairs):
                raise ValueError(f"not among the word pairs of {text!r}: {sorted(set(own) - set(pairs))}")
            n_own = sum(p in own for p in pairs)
            for i, (gram, pair) in enumerate(zip(two_grams(hashes).tolist(), pairs)):
                rows.append((gram, pair, f"{int(base)}{text}", label, base, i, len(pairs), pair in own, n_own))
    return rows


def _grams(batches, known: np.ndarray):
    """One row per text and one per 2-gram; the words themselves only where the hash is a template's."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        uids, ids = batch.column(0).to_numpy(), batch.column(1)
        i = 0
        while i < len(texts):
            parts, lengths, first, size = [], [], i, 0
            while i < len(texts) and (not parts or size + texts[i].as_buffer().size < CHUNK):
                parts.append(texts[i].as_py().lower())
                lengths.append(len(parts[-1]) + 1)
                size += lengths[-1]
                i += 1
            data = b" ".join(parts)  # a blank ends any word, so no word spans two texts
            starts, ends, hashes = words_of(data)
            limits = np.cumsum([0, *lengths])
            owner = np.searchsorted(limits, starts, side="right") - 1
            n_words = np.bincount(owner, minlength=len(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids[first:i]), ids.slice(first, i - first), pa.array(n_words), pa.array(np.full(len(parts), MARK, np.int64)), pa.array(np.full(len(parts), MARK, np.int64)), pa.nulls(len(parts), pa.string())],
                names=["uid", "id", "n_words", "pos", "gram", "pair"],
            )
            if len(starts) < 2:
                continue
            same = np.flatnonzero(owner[:-1] == owner[1:])
            before = np.concatenate([[0], np.cumsum(n_words)])
            grams = two_grams(hashes)[same]
            at = np.searchsorted(known, grams)
            hit = known[np.minimum(at, len(known) - 1)] == grams
            pairs = np.full(len(same), None, dtype=object)
            for k in np.flatnonzero(hit).tolist():
                w = same[k]
                pairs[k] = (data[starts[w] : ends[w]] + b" " + data[starts[w + 1] : ends[w + 1]]).decode()
            for a in range(0, len(same), 100_000):
                part = slice(a, a + 100_000)
                who = owner[same[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[first + who]), pa.nulls(len(who), ids.type), pa.nulls(len(who), pa.int64()), pa.array((same[part] - before[who]).astype(np.int64)), pa.array(grams[part]), pa.array(pairs[part], pa.string())],
                    names=["uid", "id", "n_words", "pos", "gram", "pair"],
                )


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None) -> DataFrame:
    """The places of templates, and one row without a template for each text.

    Columns: ``uid, id, n_words, template, label, base, first_word, last_word,
    coverage, found``; ``uid`` tells rows of the input apart, and ``found`` says
    that the place holds what its label asks for.
    """
    spark = docs.sparkSession
    rows = template_rows(phrases or PHRASES, notices or NOTICES)
    known = np.unique(np.array([r[0] for r in rows], dtype=np.int64))
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = (
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(lambda batches: _grams(batches, known), f"uid bigint, id {id_type}, n_words bigint, pos bigint, gram bigint, pair string")
    )
    # The row that stands for a text joins a template row of its own, so one pass over the texts gives both.
    rows.append((MARK, *[None] * 8))
    templates = spark.createDataFrame(
        rows, "gram bigint, pair string, template string, label string, base boolean, t_pos bigint, n_grams bigint, own boolean, n_own bigint"
    )
    votes = scanned.alias("s").join(
        F.broadcast(templates).alias("t"),
        F.expr(f"s.gram = t.gram AND (s.pair = t.pair OR s.pos = {MARK} AND t.template IS NULL)"),
    ).select("s.uid", "s.id", "s.n_words", "s.pos", "t.template", "t.label", "t.base", "t.t_pos", "t.n_grams", "t.own", "t.n_own")
    diagonals = votes.groupBy("uid", "template", "label", "base", "n_grams", "n_own", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("t_pos").alias("t_first"), F.max("t_pos").alias("t_last"),
        F.collect_list("t_pos").alias("t_all"), F.collect_list(F.when(F.col("own"), F.col("t_pos"))).alias("t_own"), F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"),
    )
    return _merged(diagonals)


def _merged(diagonals: DataFrame) -> DataFrame:
    """One row per place of a phrase, per place of a notice that is covered well enough, and per text."""
    by_place = Window.partitionBy("uid", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by_place) > NEAR
    # Phrases keep their diagonals apart; a text's own row has no template.
    starts = diagonals.withColumn("new", F.when(F.col("template").isNull() | F.col("base"), F.lit(1)).otherwise(F.coalesce(far, F.lit(True)).cast("int")))
    places = starts.withColumn("place", F.sum("new").over(by_place)).groupBy("uid", "template", "label", "base", "n_grams", "n_own", "place").agg(
        F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"),
        F.min(F.col("diagonal") + F.col("t_first")).alias("first_word"), (F.max(F.col("diagonal") + F.col("t_last")) + 1).alias("last_word"),
        F.max("votes").alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("t_all")))).alias("covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list("t_own")))).alias("own"),
        F.coalesce(F.max(F.when(F.size("t_own") == F.col("n_own"), F.col("votes"))), F.lit(0)).alias("best_own"),
    )
    short = F.col("last_word") - F.col("first_word") + 1 <= (F.col("n_grams") + 1) * LONGER
    coverage = F.when(F.col("base") | ~short, F.col("best")).otherwise(F.col("covered")) / F.col("n_grams")
    # Where a place is too long to be one notice, a single diagonal has to hold enough.
    enough = F.greatest("best_own", F.when(short & (F.col("own") == F.col("n_own")), F.col("covered")).otherwise(0)) / F.col("n_grams") >= COVERAGE
    found = F.when(F.col("template").isNotNull(), F.when(F.col("base"), coverage >= 1).otherwise(enough))
    return places.withColumns({"coverage": coverage, "found": F.coalesce(found, F.lit(False))}).drop("n_own", "own", "best_own")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every text.

    ``score`` is 1 where a phrase stands, else the best coverage of a notice.
    """
    places = license_spans(docs, id_col, text_col, phrases, notices)
    base = F.col("found") & F.col("base")

    def joined(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    score = F.max(F.when(base, F.lit(1.0)).when(F.col("template").isNotNull() & ~F.col("base"), F.col("coverage")))
    return places.groupBy("uid").agg(
        F.first("id", ignorenulls=True).alias(id_col),
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    ).drop("uid")
