"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where more than half of the XXH64 hashes
(seed 42) of its word shingles have it.  Equal fingerprints are taken together
first.  The distinct ones are laid out in *tiles* by the population counts of
``parts`` equal parts of the fingerprint; two fingerprints at a distance of
``radius`` have population counts that differ by no more than that in sum, so
all other pairs of tiles are skipped.  Tiles are cut into blocks of at most
``BLOCK`` fingerprints, and each pair of blocks is compared whole with numpy
exclusive-or and bit counts: the comparison is exact.  A pair of blocks emits
only as many of its links as connect what belongs together, never all pairs of
a group.

What grows: with ``parts`` fingerprint parts the share of pairs that are
compared falls (about 20 % for one part and a radius of 2, 1.4 % for four,
0.03 % for eight); ``parts_for`` takes more of them as the table grows.  The
result is the same for any number.

Cases: a null or empty text, or one without words, has the fingerprint zero,
which links like any other; repeated rows keep a row each; null identifiers
keep their rows with their fingerprint and no component of their own unless
another row shares it; other columns are left out, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from joeira.llm.common import Scratch, unused
from joeira.llm.components import connected
from joeira.llm.licenses import mixed

BITS = 64
BLOCK = 32_768
ROWS_AT_ONCE = 64  # of one block against all of the other


def word_shingles(text: bytes, size: int) -> list[bytes]:
    """Shingles of lower-cased words, repeats included; one of all words if there are fewer than ``size``."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` times 64 bits as signed numbers; the first from the XXH64 hashes, the others from those mixed anew."""
    shingles = word_shingles(text, size)
    if not shingles:
        return [0] * lanes
    set_bits = np.zeros((lanes, BITS), dtype=np.int64)
    for a in range(0, len(shingles), 50_000):
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[a : a + 50_000]], dtype="<u8")
        for lane in range(lanes):
            of_lane = mixed(hashes + np.uint64(lane)) if lane else hashes
            set_bits[lane] += np.unpackbits(of_lane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(shingles), axis=1, bitorder="little")
    return bits.view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1) -> DataFrame:
    """``id, fp, more`` for every row; ``more`` holds the lanes after the first."""

    def work(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py(), size, lanes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1:] for f in fps], pa.list_(pa.int64()))], names=["id", "fp", "more"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, fp bigint, more array<bigint>")


def parts_for(n: int, radius: int) -> int:
    """Parts of the fingerprint whose population counts make the tiles."""
    if radius > 3:
        return 1
    return 8 if n > 1 << 24 else 4 if n > 1 << 14 else 2


def _steps(parts: int, radius: int) -> list[list[int]]:
    """Half of the differences of population counts within ``radius``: those not before zero."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [list(d) for d in near if d >= (0,) * parts]


def joined(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest number that each point leads to, ``low``, with the links ``x`` to ``y`` put in."""
    roots = np.arange(len(low))
    x, y = low[x], low[y]
    while True:
        before = roots.copy()
        least = np.minimum(roots[x], roots[y])
        np.minimum.at(roots, x, least)
        np.minimum.at(roots, y, least)
        roots = roots[roots]
        if (roots == before).all():
            return roots[low]


def compare_blocks(a: np.ndarray, b: np.ndarray, radius: int, in_all: int, same: bool) -> np.ndarray:
    """Smallest place that each of ``a`` and then ``b`` (rows of lanes) leads to by links between the two blocks.

    Linked: at most ``radius`` bits apart in the first lane and ``in_all`` in all lanes.
    """
    low = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    for i in range(0, len(a), ROWS_AT_ONCE):
        first = i + 1 if same else 0
        apart = np.bitwise_count(a[i : i + ROWS_AT_ONCE, :1] ^ b[None, first:, 0])
        x, y = np.nonzero(apart <= radius)
        if a.shape[1] > 1 and len(x):
            total = apart[x, y].astype(np.int64) + np.bitwise_count(a[x + i, 1:] ^ b[y + first, 1:]).sum(axis=1, dtype=np.int64)
            x, y = x[total <= in_all], y[total <= in_all]
        if len(x):
            low = joined(low, x + i, y + first + shift)
    return low


def close_links(distinct: DataFrame, radius: int, scratch: Scratch, lanes: int = 1, in_all: int | None = None, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between ``node``s of ``distinct`` (``node, fp, more``) that connect whatever is close.

    Every pair of blocks is compared whole, but of the links in it only as many
    are emitted as join what belongs together.
    """
    parts = parts or parts_for(distinct.count(), radius)
    width = BITS // parts
    mask = (1 << width) - 1

    def ones(k: int) -> str:
        return f"bit_count(shiftrightunsigned(fp, {k * width}) & {mask}L)" if parts > 1 else "bit_count(fp)"

    tiled = distinct.select("node", "fp", "more", F.array(*[F.expr(ones(k)).cast("int") for k in range(parts)]).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    # Cuts of a tile hold about ``block`` fingerprints each, by a hash that has nothing to do with the tile.  With up to four
    # parts there are at most 17 ** 4 tiles, so their sizes may be broadcast; a shuffle by tile would gather the large ones.
    cut = tiled.join(F.broadcast(sizes) if parts <= 4 else sizes, "tile").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
    each = F.concat(F.array("node", "fp"), F.col("more"))
    blocks = scratch.save(cut.groupBy("tile", "cut").agg(F.flatten(F.collect_list(each)).alias("rows")))

    names = blocks.select("tile", "cut")
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _steps(parts, radius)])
    other = F.transform(F.arrays_zip(F.col("tile").alias("x"), F.col("step").alias("y")), lambda z: z["x"] + z["y"])
    asked = names.withColumn("step", F.explode(steps)).select(F.col("tile").alias("tile_a"), F.col("cut").alias("cut_a"), other.alias("tile"))
    pairs = asked.join(names, "tile").where("tile_a <> tile OR cut_a <= cut")
    both = pairs.join(blocks.select(F.col("tile").alias("tile_a"), F.col("cut").alias("cut_a"), F.col("rows").alias("rows_a")), ["tile_a", "cut_a"])
    # A block meets others in many pairs, so the pairs are dealt out by themselves.
    met = both.join(blocks, ["tile", "cut"]).select("rows_a", "rows", F.expr("tile_a = tile AND cut_a = cut").alias("same"))

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().reshape(-1, 1 + lanes) for c in (0, 1))
                same = batch.column(2)[k].as_py()
                low = compare_blocks(a[:, 1:].view(np.uint64), b[:, 1:].view(np.uint64), radius, radius if in_all is None else in_all, same)
                nodes = a[:, 0] if same else np.concatenate([a[:, 0], b[:, 0]])
                out = np.flatnonzero(low != np.arange(len(low)))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[low[out]])], names=["a", "b"])

    return met.mapInArrow(work, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1, in_all: int | None = None, block: int = BLOCK
) -> DataFrame:
    """``id, fingerprint, component_id`` for every row; the component is its smallest identifier.

    With more than one lane, ``radius`` holds for the first and ``in_all`` for all together.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.save(fingerprints(docs, size, id_col, text_col, lanes))
    distinct = scratch.save(found.groupBy("fp", "more").agg(F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    links = close_links(distinct.select("node", "fp", "more"), radius, scratch, lanes, in_all, block=block)
    groups = connected(links, scratch).withColumnRenamed("node", "of")
    # Components of fingerprints first; their smallest identifier then holds for all rows.
    named = distinct.join(groups, F.col("node") == F.col("of"), "left").select("fp", "more", "first", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(lowest, "component").select("fp", "more", "component_id")
    return found.join(by_fp, ["fp", "more"]).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1, in_all: int | None = None) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: the one with the smallest identifier stays."""
    uid, row = unused(docs.columns, "uid", "row")
    rows = docs.withColumn(uid, F.monotonically_increasing_id())
    # Rows are told apart by a struct that orders them by identifier first, so one of several with the same one stays.
    marked = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(uid).alias("uid")).alias(row), text_col)
    groups = near_duplicates(marked, radius, size, row, text_col, lanes, in_all)
    stays = groups.where(F.col(row) == F.col("component_id")).select(F.col(row)["uid"].alias(uid))
    return rows.join(stays, uid, "left_semi").drop(uid)
