"""Vectors as short codes: a codebook for each part, learned by Lloyd rounds in which the members stay where they are.

Components become integers, and a vector is cut into ``parts`` parts.  The
parts live in *blocks* that belong to an owner: a position, an entry of its
codebook, and a salt that splits entries with many members.  A block knows how
many members it has and their sums, so a new codebook is read off two short
columns, however many members there are.  Then every owner looks at its own members: those whose
nearest entry is still its own are written back in place, without a shuffle,
and only those that are nearer to another entry migrate to its owner.  After the
first round few do.

All arithmetic is on integers, and exact.  The codebooks are all that the
driver and the tasks hold in full: ``entries`` vectors.  Blocks hold about ``BLOCK``
members, however many copies of one vector there are.

Cases: a vector takes no part if it is null or empty, holds a component that is null, not
finite or of 65,536 or more in size, or has another length than the one with the
smallest identifier; null identifiers come last in the order of identifiers, equal ones by
their vectors; repeated rows keep a row each; where the length cannot be
divided, the first parts are one longer; fewer vectors than entries make a
smaller codebook; other columns are left out, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from joeira.llm.common import Scratch

BLOCK = 4096  # members
LARGEST = 65_536  # a component is smaller, so that no squared distance leaves 64 bits
HOT_LABELS = 1000
_BLOCKS = "position int, entry int, salt int, n bigint, sums array<bigint>, members binary, moved boolean"


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < LARGEST))


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Vectors of one length as rows of integers, all rounded down."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1)


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(x, parts, axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``book`` (of equal ones the first), and its squared distance."""
    best, found = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    width = x.shape[1]
    for a in range(0, len(x), 2048):
        part = x[a : a + 2048]
        largest = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
        if 4 * width * largest**2 < 1 << 53:
            # Whole numbers this small are exact in double precision.
            p, b = part.astype(np.float64), book.astype(np.float64)
            apart = ((p * p).sum(axis=1)[:, None] - 2 * (p @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
        else:
            apart = np.stack([((part - c) ** 2).sum(axis=1) for c in book], axis=1)
        best[a : a + 2048] = apart.argmin(axis=1)
        found[a : a + 2048] = apart.min(axis=1)
    return best, found


@dataclass
class Codebooks:
    """An array of integer entries for every part."""

    books: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal form, by part, entry and position, with commas between them."""
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()

    @property
    def dim(self) -> int:
        return sum(b.shape[1] for b in self.books)


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the ``entries`` smallest identifiers (of ``id, vector``)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    if first is None:
        return None
    same = rows.where(F.size("vector") == first[0])
    taken = same.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = integers(pa.array([r.vector for r in taken], pa.list_(pa.float64())), scale)
    return Codebooks([np.ascontiguousarray(p) for p in cut(x, parts)], scale)


def _block(position: int, entry: int, salt: int, x: np.ndarray, moved: bool) -> tuple:
    return position, entry, salt, len(x), x.sum(axis=0).tolist(), x.astype("<i8").tobytes(), moved


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = [("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("members", pa.binary()), ("moved", pa.bool_())]
    columns = zip(*blocks) if blocks else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[k for k, _ in kinds])


def _by_entry(position: int, x: np.ndarray, to: np.ndarray, but: int = -1):
    """Blocks on their way: the members that go to each entry other than ``but``."""
    order = np.argsort(to, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(to[order])) + 1, len(order)) if len(order) else []
    a = 0
    for b in ends:
        entry = int(to[order[a]])
        if entry != but:
            for k in range(a, b, BLOCK):
                yield _block(position, entry, 0, x[order[k : min(k + BLOCK, b)]], True)
        a = b


def settle(moving: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks on their way, gathered by their owners: a position, an entry and one of the salts that its arrivals need."""
    sent = scratch.save(moving.withColumn("uid", F.monotonically_increasing_id()))
    salts = sent.groupBy("position", "entry").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("salts"))  # an entry each
    dealt = sent.join(F.broadcast(salts), ["position", "entry"]).withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))

    def gather(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        members = np.frombuffer(b"".join(group.column("members").to_pylist()), dtype="<i8").reshape(sum(group.column("n").to_pylist()), len(first["sums"]))
        return pa.Table.from_batches([_batch([_block(first["position"], first["entry"], first["salt"], members, False)])])

    # Equal copies arrive in equal blocks; the written number, not their content, tells them apart.
    owned = dealt.select("position", "entry", "salt", "n", "sums", "members", "moved").groupBy("position", "entry", "salt")
    return scratch.save(owned.applyInArrow(gather, _BLOCKS))


def updated(books: Codebooks, residents: DataFrame) -> Codebooks:
    """Each entry moved to the mean, rounded down, of its members; without any it stays."""
    sums = residents.select("position", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books.books]
    for r in sums.where("n > 0").toLocalIterator():  # a row per component of the codebooks
        out[r.position][r.entry, r.at] = r.s // r.n
    return Codebooks(out, books.scale)


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks | None:
    """Codebooks after ``rounds`` rounds, or None if there is no vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(usable("vector"))
    books = first_books(rows, parts, entries, scale)
    if books is None:
        return None
    scratch, start = Scratch(vectors.sparkSession, "vector-codes"), books

    def arrive(batches):
        for batch in batches:
            x = integers(batch.column(0), scale)
            for position, (part, book) in enumerate(zip(cut(x, parts), start.books)):
                yield _batch(list(_by_entry(position, part, nearest(part, book)[0])))

    resident = settle(rows.where(F.size("vector") == books.dim).select("vector").mapInArrow(arrive, _BLOCKS), scratch)
    for k in range(rounds):
        if k:
            resident = _moved(resident, books, scratch)
        books = updated(books, resident)
    return books


def _moved(resident: DataFrame, books: Codebooks, scratch: Scratch) -> DataFrame:
    """The blocks after every member has gone to its nearest entry: most stay in the block they are in."""

    def look(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                book = books.books[r["position"]]
                x = np.frombuffer(r["members"], dtype="<i8").reshape(r["n"], book.shape[1])
                to, _ = nearest(x, book)
                stay = x[to == r["entry"]]
                if len(stay):
                    out.append(_block(r["position"], r["entry"], r["salt"], stay, False))
                out += _by_entry(r["position"], x, to, but=r["entry"])
            yield _batch(out)

    step = scratch.save(resident.mapInArrow(look, _BLOCKS))
    return step.where("NOT moved").unionByName(settle(step.where("moved"), scratch))


def encode(vectors: DataFrame, books: Codebooks | None, columns: list[str], vec_col: str = "embedding") -> DataFrame:
    """``columns`` of the vectors that take part, with ``codes`` (an entry for each part) and ``error`` (squared distance in integers)."""
    taken = [F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]
    rows = vectors.select(F.col(vec_col).cast("array<double>").alias("vector"), *taken).where(usable("vector")).where(F.size("vector") == (books.dim if books else -1))

    def work(batches):
        for batch in batches:
            x = integers(batch.column(0), books.scale)
            found = [nearest(p, b) for p, b in zip(cut(x, len(books.books)), books.books)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat, pa.array(sum(f[1] for f in found))], names=[*batch.schema.names[1:], "codes", "error"])

    kinds = [f"c{k} {vectors.schema[c].dataType.simpleString()}" for k, c in enumerate(columns)]
    out = rows.mapInArrow(work, ", ".join([*kinds, "codes array<int>", "error bigint"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "codes", "error")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``vector``: what its ``codes`` stand for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(v) / books.scale) for v in e]) for e in b.tolist()]) for b in books.books])
    return coded.withColumn("vector", F.flatten(F.transform("codes", lambda c, k: entries[k][c])))


def with_label_error(coded: DataFrame, label: str, scratch: Scratch) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label together; null is a label too.

    Labels that hold a thousandth of all rows or more are few, and are joined as a broadcast; the others have no large groups.
    """
    saved = scratch.save(coded)
    sums = scratch.save(saved.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    least = sums.agg(F.coalesce(F.sum("n"), F.lit(0)) / HOT_LABELS).first()[0]
    hot, rest = sums.where(F.col("n") >= least).drop("n"), sums.where(F.col("n") < least).drop("n")

    def equal(other: DataFrame) -> Column:
        return saved[label].eqNullSafe(other["of"])

    common = saved.join(F.broadcast(hot), equal(hot)).drop("of")
    other = saved.join(F.broadcast(hot), equal(hot), "left_anti").join(rest, equal(rest)).drop("of")
    return common.unionByName(other)


def code_table(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` for every vector that takes part; a code has two hex digits for each part."""
    books = train(vectors, parts, entries, rounds, scale, id_col, vec_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    coded = encode(rows, books, ["vec_id", "label"], "vector")
    digits = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    out = with_label_error(coded, "label", Scratch(vectors.sparkSession, "vector-codes"))
    return out.select(F.col("vec_id").alias(id_col), digits.alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
