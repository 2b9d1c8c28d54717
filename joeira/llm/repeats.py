"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a
document with a smaller identifier.  Texts are their UTF-8 bytes, strings never
cross documents, and they are judged on the input.

As in prefix doubling, positions are ranked by growing prefixes and drop out as
soon as their rank is theirs alone:

1. *Prefixes of 16 bytes.*  Every window of 50 bytes is represented by one of its
   16-byte prefixes at an inner position, the one with the smallest hash, so
   equal windows have equal representatives and about one position in 20 is
   ranked.  Spark deals their hashes out by value; a hash that no second
   document holds is unique, and all the windows it stands for drop out.
2. *Up to 50 bytes.*  What is left goes, as runs of neighbouring windows with
   their bytes, to the shard of its representative.  There positions are named
   by pairs of names at growing offsets (1 + 1, 2 + 2 ... 16 + 16, 32 + 18 bytes)
   and the windows ranked by one sort of the last names; all windows of a rank
   are compared byte by byte.  Those of any document but the one with the
   smallest identifier are covered.
3. The answers go back as bits to the packed texts, where the covered bytes are
   cut out.

Hashes only choose shards and candidates; the verdict compares the bytes
themselves, but for whole copies (equal 128-bit hash and length) and runs that
one packed batch holds twice (two equal 64-bit hashes).

Scale: texts are packed once into compressed rows of a few MB in the shared
folder.  Per byte of text the first step shuffles about 0.2 bytes, the second
only what is repeated.  A batch sends each run once however often it holds it,
so a passage that a third of all documents share is a few rows per batch, and
whole copies are set aside by their hash.  A prefix that more than ``hot_runs``
runs hold (a shared passage's ends, each in a context of its own) is dealt out
by whole windows, so it fills no single shard.  Nothing is sampled or capped.

Cases: a null text counts as empty; texts shorter than 50 bytes stay whole; a
null identifier is neither smaller nor larger than another, so its text stays
whole and covers nothing; rows that repeat an identifier do not cover each
other; an empty table gives an empty result; other columns stay with their row
in ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from joeira.llm.common import Scratch, parallelism

LENGTH = 50
PREFIX = 16
BATCH = 2 << 20  # bytes of text in a packed row
SEGMENT = 1 << 20  # bytes hashed at a time
SHARD = 32 << 20  # bytes of text for each shard of the first step, which gets a 4-byte hash for about 20 of them
RUN_SHARD = 2 << 20  # and for each shard of the second, which may get them all
HOT_RUNS = 8192  # a prefix with more runs is dealt out by whole windows
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _windows(raw: np.ndarray, room: np.ndarray, length: int, prefix: int) -> np.ndarray:
    """For each start of ``length`` bytes the smallest hash of a ``prefix`` inside; ``room``: bytes up to the end of the text."""
    n = len(raw)
    grams, done, power = raw.astype(np.uint64) + np.uint64(1), 1, BASE
    while done < prefix:  # prefix is a power of two
        grams = grams[: n - 2 * done + 1] * power + grams[done:]
        done *= 2
        with np.errstate(over="ignore"):
            power = power * power
    grams = _mixed(grams)
    grams[room[: len(grams)] < prefix] = LAST
    least, span, width = grams, 1, length - prefix + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    return least


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Runs:
    """The runs of neighbouring windows with one representative, in the texts of a batch."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, skip: np.ndarray, length: int = LENGTH, prefix: int = PREFIX):
        self.length = length
        ends = np.cumsum(sizes)
        self.first_of = ends - sizes
        starts, counts, keys = [], [], []
        for a in range(0, len(raw), SEGMENT):
            b = min(len(raw), a + SEGMENT + length - 1)
            if b - a < length:
                break
            owner = np.searchsorted(ends, np.arange(a, b), side="right")
            room = ends[owner] - np.arange(a, b)
            least = _windows(raw[a:b], room, length, prefix)
            n = len(least)
            fits = (room[:n] >= length) & ~skip[owner[:n]]
            new = fits.copy()
            new[1:] &= ~fits[:-1] | (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
            begin = np.flatnonzero(new)
            # Windows without room or of skipped texts end a run as well.
            stop = np.append(np.flatnonzero(np.append(~fits[1:], True) & fits) + 1, 0)
            limit = np.append(begin[1:], n)
            inner = np.minimum(limit, stop[np.searchsorted(stop[:-1], begin, side="right")] if len(begin) else limit)
            starts.append(begin + a)
            counts.append(inner - begin)
            keys.append(_mixed(least[begin] + BASE))  # the smallest of many hashes are small: spread them again
        self.start = np.concatenate([np.empty(0, np.int64), *starts]).astype(np.int64)
        self.count = np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)
        self.key = np.concatenate([np.empty(0, np.uint64), *keys])
        self.owner = np.searchsorted(ends, self.start, side="right")
        order = np.argsort(self.key, kind="stable")
        self.start, self.count, self.key, self.owner = self.start[order], self.count[order], self.key[order], self.owner[order]

    def split(self, hot: np.ndarray, raw: np.ndarray) -> None:
        """Marked runs become runs of one window each, whose key is a hash of the whole window."""
        each = np.where(hot, self.count, 1)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        hot = np.repeat(hot, each)
        self.start, self.owner, self.key = np.repeat(self.start, each) + place, np.repeat(self.owner, each), np.repeat(self.key, each)
        self.count = np.where(hot, 1, np.repeat(self.count, each))
        self.key = np.where(hot, _mixed(self.content(raw) + self.key * BASE), self.key)

    def take(self, which: np.ndarray) -> None:
        self.start, self.count, self.key, self.owner = self.start[which], self.count[which], self.key[which], self.owner[which]

    def gather(self, raw: np.ndarray) -> np.ndarray:
        """The bytes of the runs, one after the other."""
        size = self.count + self.length - 1
        at = np.repeat(self.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return raw[at]

    def content(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each run's bytes."""
        # A run's hash is a wrapped sum, each byte times a power of its place; undone for the start.
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(int(BASE), len(raw)), out=sums[1:])
        size = self.count + self.length - 1
        out = sums[self.start + size] - sums[self.start]
        del sums
        out *= _powers(pow(int(BASE), -1, 1 << 64), len(raw) + 1)[self.start]
        return _mixed(out + size.astype(np.uint64))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Contiguous ranges of the key's upper half."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(row["blob"]), dtype=np.uint8) if row["sizes"] else np.empty(0, np.uint8)
    return raw, np.array(row["sizes"], dtype=np.int64), np.array([i is None for i in row["id"]], dtype=bool)


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of about ``BATCH`` bytes: arrays of all columns but the text, and the texts in one compressed blob."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"o{k}") for k, c in enumerate(others)],
    )
    kept = [0, 1, *range(3, 3 + len(others))]
    names = ["uid", "id", *[f"o{k}" for k in range(len(others))]]

    def emit(parts: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = [xxhash.xxh3_128_digest(t) for t in texts]
        both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        columns = [table.column(k).combine_chunks() for k in kept]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), c) for c in (
            *columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
        )]
        blob = zstandard.compress(b"".join(texts), 3)
        return pa.RecordBatch.from_arrays([columns[0].slice(0, 1), *lists, pa.array([blob], pa.binary())], names=["batch", *names, "sizes", "key1", "key2", "blob"])

    def work(batches):
        parts, texts, size = [], [], 0
        for batch in batches:
            first = 0
            for k, t in enumerate(batch.column(2).cast(pa.large_binary())):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BATCH:
                    parts.append(batch.slice(first, k + 1 - first))
                    yield emit(parts, texts)
                    first, parts, texts, size = k + 1, [], [], 0
            if first < batch.num_rows:
                parts.append(batch.slice(first))
        if texts:
            yield emit(parts, texts)

    kinds = {f"o{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(others)} | {"uid": "bigint", "id": docs.schema[id_col].dataType.simpleString()}
    schema = "batch bigint, " + ", ".join(f"{n} array<{kinds[n]}>" for n in names) + ", sizes array<bigint>, key1 array<bigint>, key2 array<bigint>, blob binary"
    return rows.mapInArrow(work, schema)


def _copies(packed: DataFrame, length: int) -> DataFrame:
    """``batch, copies``: the rows whose whole text stands under a smaller identifier."""
    rows = packed.select("batch", F.explode(F.arrays_zip("uid", "id", "sizes", "key1", "key2")).alias("d")).select(
        "batch", "d.uid", "d.id", "d.sizes", "d.key1", "d.key2"
    ).where(f"id IS NOT NULL AND sizes >= {length}")
    least = rows.groupBy("key1", "key2", "sizes").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    return rows.join(least, ["key1", "key2", "sizes"]).where("id > least").groupBy("batch").agg(F.collect_list("uid").alias("copies"))


def _prefix_hashes(shards: int, length: int):
    """First step, texts: for each shard the sorted hashes a batch holds, which of them two of its documents hold, and in how many runs (255 at most)."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, sizes, lost = unpack(row)
                runs = Runs(raw, sizes, lost, length)
                if not len(runs.key):
                    continue
                ids = np.unique(np.array(row["id"], dtype=object)[~lost].astype(str), return_inverse=True)[1]
                who = np.full(len(sizes), -1, dtype=np.int64)
                who[~lost] = ids
                who = who[runs.owner]
                new = np.append(True, runs.key[1:] != runs.key[:-1])
                first = np.flatnonzero(new)
                shared = np.maximum.reduceat(who, first) != np.minimum.reduceat(who, first)
                keys = runs.key[first]
                times = np.minimum(np.diff(np.append(first, len(runs.key))), 255).astype(np.uint8)
                cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full), pa.array(np.full(len(full), row["batch"])),
                    pa.array([keys[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes() for s in full], pa.binary()),
                    pa.array([np.packbits(shared[cuts[s] : cuts[s + 1]]).tobytes() for s in full], pa.binary()),
                    pa.array([zstandard.compress(times[cuts[s] : cuts[s + 1]].tobytes(), 1) for s in full], pa.binary()),
                ], names=["shard", "batch", "keys", "shared", "times"])

    return work


def _repeated_hashes(hot_runs: int):
    """First step, shards: bits for the hashes that some other document holds too, and places of those in very many runs."""

    def work(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint32) for k in table.column("keys").to_pylist()]
        shared = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(table.column("shared").to_pylist(), keys)]
        times = [np.frombuffer(zstandard.decompress(t), np.uint8) for t in table.column("times").to_pylist()]
        value, place, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        often = (held > 1) | (np.bincount(place, weights=np.concatenate(shared), minlength=len(value)) > 0)
        hot = np.bincount(place, weights=np.concatenate(times), minlength=len(value)) > hot_runs
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({
            "batch": table.column("batch"), "shard": table.column("shard"),
            "bits": pa.array([np.packbits(b).tobytes() for b in np.split(often[place], cuts)], pa.binary()),
            "hot": pa.array([np.flatnonzero(b).astype(np.int32).tobytes() for b in np.split(hot[place], cuts)], pa.binary()),
        })

    return work


def _left_over(row: dict, shards: int, length: int):
    """A batch's runs that are still in the race, each content once, with the text and identifier that stand for it.

    Also the whole copies, and for every run its place among the contents.
    """
    raw, sizes, lost = unpack(row)
    copy = np.isin(np.array(row["uid"], dtype=np.int64), np.array(row["copies"] or [], dtype=np.int64))
    runs = Runs(raw, sizes, lost, length)
    keep = np.zeros(len(runs.key), dtype=bool)
    if len(runs.key):
        new = np.append(True, runs.key[1:] != runs.key[:-1])
        keys = runs.key[new]
        counts = np.bincount(shard_of(keys, shards), minlength=shards)
        often, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        before = np.concatenate([[0], np.cumsum(counts)])
        for s, bits, places in zip(row["bit_shards"] or [], row["bits"] or [], row["hot"] or []):
            often[before[s] : before[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=counts[s]).astype(bool)
            hot[before[s] + np.frombuffer(places, np.int32)] = True
        keep = often[np.cumsum(new) - 1] & ~copy[runs.owner]
        hot = hot[np.cumsum(new) - 1][keep]
    runs.take(keep)
    if len(runs.key) and hot.any():
        runs.split(hot, raw)
    content = runs.content(raw) if len(runs.key) else np.empty(0, np.uint64)
    ids = row["id"]
    order_of = {v: k for k, v in enumerate(sorted({i for i in ids if i is not None}))}
    rank = np.array([-1 if i is None else order_of[i] for i in ids], dtype=np.int64)[runs.owner]
    order = np.lexsort((rank, content, runs.key))
    runs.take(order)
    content, rank = content[order], rank[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (runs.key[1:] != runs.key[:-1]) | (content[1:] != content[:-1])
    return raw, sizes, copy, runs, np.cumsum(new) - 1, np.flatnonzero(new), rank


def _run_bytes(shards: int, run_shards: int, length: int):
    """Second step, texts: the runs of each shard with their bytes."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, _, _, runs, _, first, _ = _left_over(row, shards, length)
                if not len(first):
                    continue
                runs.take(first)
                data = runs.gather(raw)
                size = runs.count + length - 1
                at = np.concatenate([[0], np.cumsum(size)])
                cuts = np.searchsorted(shard_of(runs.key, run_shards), np.arange(run_shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                ids = [row["id"][o] for o in runs.owner]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full), pa.array(np.full(len(full), row["batch"])), pa.array([ids[cuts[s] : cuts[s + 1]] for s in full], pa.list_(batch.schema.field("id").type.value_type)),
                    pa.array([runs.count[cuts[s] : cuts[s + 1]].astype(np.int32).tobytes() for s in full], pa.binary()),
                    pa.array([zstandard.compress(data[at[cuts[s]] : at[cuts[s + 1]]].tobytes(), 1) for s in full], pa.binary()),
                ], names=["shard", "batch", "ids", "counts", "data"])

    return work


def ranked(raw: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``length`` bytes that are not unique, and their ranks.

    Prefixes are named at growing offsets (1, 2, 4 ... and ``length`` bytes) by a
    64-bit hash of the pair of names; only whole windows are sorted.  All windows
    of a name are then compared with its first, byte by byte, eight at a time;
    should two differ, ``ranked_by_sorts`` decides.
    """
    at = np.flatnonzero(room >= length)
    name, done, power = raw.astype(np.uint64) + np.uint64(1), 1, BASE
    while done * 2 <= length:
        name = name[: len(name) - done] * power + name[done:]
        done *= 2
        with np.errstate(over="ignore"):
            power = power * power
    rank, shared = _dense(_mixed(_mixed(name[at]) * BASE + name[at + (length - done)]))
    del name
    at, rank = at[shared], rank[shared]
    first = np.zeros(int(rank.max()) + 1 if len(rank) else 1, dtype=at.dtype)
    first[rank] = at  # any of them will do
    first = first[rank]
    word, done = raw.astype(np.uint64), 1
    while done < 8:
        word = word[: len(word) - done] << np.uint64(8 * done) | word[done:]
        done *= 2
    if any((word[at + k] != word[first + k]).any() for k in [*range(0, length - 8, 8), length - 8]):
        return ranked_by_sorts(raw, room, length)
    return at, rank


def ranked_by_sorts(raw: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes: prefix doubling from 8 bytes on, a sort of exact pairs of ranks for each offset."""
    value, done = raw.astype(np.uint64), 1
    while done < 8:
        value = value[: len(value) - done] << np.uint64(8 * done) | value[done:]
        done *= 2
    at = np.flatnonzero(room[: len(value)] >= 8)
    rank = np.zeros(len(raw) + 1, dtype=np.uint32)
    rank[at] = _dense(value[at])[0]
    del value
    while done < length:
        step = min(done, length - done)
        at = np.flatnonzero(room >= done + step)
        place, shared = _dense(rank[at].astype(np.uint64) << np.uint64(32) | rank[at + step])
        rank[at] = place  # the pairs are taken, so the old ranks can go
        done += step
    return at[shared], place[shared]


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the values by one sort, and which values occur more than once."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(len(values), dtype=np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1) if len(values) else rank
    shared = np.empty(len(values), dtype=bool)
    shared[order] = ~(new & np.append(new[1:], True)) if len(values) else shared
    return rank, shared


def _covered(length: int):
    """Second step, shards: a bit for each window that some document with a smaller identifier holds."""

    def work(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c, dtype=np.int32).astype(np.int64) for c in table.column("counts").to_pylist()]
        every = np.concatenate(counts)
        raw = np.frombuffer(b"".join(map(zstandard.decompress, table.column("data").to_pylist())), dtype=np.uint8)
        ids = [i for x in table.column("ids").to_pylist() for i in x]
        order_of = {v: k for k, v in enumerate(sorted(set(ids)))}
        who = np.array([order_of[i] for i in ids], dtype=np.int64)
        size = every + length - 1
        ends = np.cumsum(size)
        run = np.repeat(np.arange(len(size), dtype=np.int32), size)
        room = (ends[run] - np.arange(len(raw))).astype(np.int32)
        at, rank = ranked(raw, room, length)
        least = np.full(int(rank.max()) + 1 if len(rank) else 1, len(order_of), dtype=np.int64)
        np.minimum.at(least, rank, who[run[at]])
        hit = np.zeros(len(raw), dtype=bool)
        hit[at] = who[run[at]] > least[rank]
        hit = hit[room >= length]  # one bit for each window
        bits = np.split(hit, np.cumsum([c.sum() for c in counts])[:-1])
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "hits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return work


def _cut(shards: int, run_shards: int, length: int, names: list[str], with_text: bool):
    """Third step: the texts without the covered bytes."""

    def work(batches):
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                raw, sizes, copy, runs, content, first, rank = _left_over(row, shards, length)
                ends = np.cumsum(sizes)
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                if len(first):
                    counts = runs.count[first]
                    before = np.concatenate([[0], np.cumsum(counts)])
                    hit = np.zeros(int(before[-1]), dtype=bool)
                    cuts = np.searchsorted(shard_of(runs.key[first], run_shards), np.arange(run_shards + 1))
                    for s, bits in zip(row["hit_shards"] or [], row["hits"] or []):
                        a, b = before[cuts[s]], before[cuts[s + 1]]
                        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                    # A run has the verdict of its content; under a larger identifier of the same batch it is covered whole.
                    each = runs.count
                    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    covered = hit[np.repeat(before[content], each) + offset] | np.repeat(rank > rank[first][content], each)
                    at = (np.repeat(runs.start, each) + offset)[covered]
                    edge[at] += 1  # no window is in two runs
                    edge[at + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                gone[np.repeat(copy, sizes)] = True
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    part = gone[a:b]
                    left = raw[a:b][~part].tobytes()
                    out["n_bytes"].append(b - a)
                    out["n_removed"].append(b - a - len(left))
                    out["n_spans"].append(int(part[:1].sum()) + int((part[1:] & ~part[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        out["kept"].append(left.decode("utf-8", "ignore"))
                columns = [batch.column(n)[k].values for n in names]
                more = [pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())]
                more += [pa.array(out["kept"], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_bytes: int = SHARD, run_shard_bytes: int = RUN_SHARD, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` in front of nothing else.

    With ``with_text`` the text column holds what is left (characters cut in
    two are left out of it; ``kept_sha256`` is that of the bytes), else it is dropped.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = scratch.save(pack(docs, id_col, text_col))
    total = packed.select(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, n: x + n).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(2 * parallelism(docs.sparkSession), total // shard_bytes)
    run_shards = max(2 * parallelism(docs.sparkSession), total // run_shard_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()

    hashes = packed.select("batch", "id", "sizes", "blob").mapInArrow(_prefix_hashes(shards, length), "shard bigint, batch bigint, keys binary, shared binary, times binary")
    often = hashes.groupBy("shard").applyInArrow(_repeated_hashes(hot_runs), "batch bigint, shard bigint, bits binary, hot binary")
    bits = often.groupBy("batch").agg(F.collect_list(F.struct("shard", "bits", "hot")).alias("b")).select(
        "batch", F.col("b.shard").alias("bit_shards"), F.col("b.bits").alias("bits"), F.col("b.hot").alias("hot")
    )
    known = scratch.save(bits.join(_copies(packed.select("batch", "uid", "id", "sizes", "key1", "key2"), length), "batch", "full"))
    asked = packed.select("batch", "uid", "id", "sizes", "blob").join(known.hint("shuffle_hash"), "batch", "left")
    runs = asked.mapInArrow(_run_bytes(shards, run_shards, length), f"shard bigint, batch bigint, ids array<{id_type}>, counts binary, data binary")
    hits = runs.groupBy("shard").applyInArrow(_covered(length), "batch bigint, shard bigint, hits binary")
    answers = hits.groupBy("batch").agg(F.collect_list(F.struct("shard", "hits")).alias("h")).select(
        "batch", F.col("h.shard").alias("hit_shards"), F.col("h.hits").alias("hits")
    )
    told = scratch.save(known.join(answers, "batch", "left"))
    names = ["id", *[f"o{k}" for k in range(len(others))]]
    cut = packed.drop("key1", "key2").join(told.hint("shuffle_hash"), "batch", "left")
    kinds = {"id": id_type} | {f"o{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(others)}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_text else "")
    out = cut.mapInArrow(_cut(shards, run_shards, length, names, with_text), schema)
    back = {id_col: "id", text_col: "kept"} | {c: f"o{k}" for k, c in enumerate(others)}
    clash = {"n_bytes", "n_removed", "n_spans", "kept_sha256"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input has columns of the result: {sorted(clash)}")
    order = [c for c in docs.columns if with_text or c != text_col]
    return out.select(*[F.col(back[c]).alias(c) for c in order], "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeats_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; other columns are left out."""
    return remove_repeats(docs.select(id_col, text_col), length, id_col, text_col, with_text=False)
