"""CSV files whose quoted cells hold line breaks, read by many tasks at once.

Whether a line break ends a record depends on all quotes before it: it does if
their number is even.  One light pass counts, for every split of a file, its
quotes and the records that begin in it, once for each of the two states it may
begin in.  Prefix sums over the splits of a file then tell the true state at the
start of each split and the number of its first record, and every split is cut
into records by itself.  Only a record that runs over the end of its split is put
together from pieces, which are two rows per split at most.

Quotes must be as in RFC 4180: around a cell, and doubled inside.  A lone quote
shifts everything behind it, as it may for a reader of the whole file.  One
task holds a record whole, so an unclosed quote gathers the rest of its file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from joeira.sources import rownum

_SPLIT = ["_file", "_block"]
_COUNTS = "_file string, _block bigint, _odd int, _outside bigint, _inside bigint, _crlf boolean"
_PIECES = "_file string, _block bigint, _number bigint, _text string, _begins boolean, _whole boolean, _before bigint, _crlf boolean"


def _parts(batch: pa.RecordBatch):
    """Parts of a batch that come from one split."""
    if not batch.num_rows:
        return
    block, file = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
    ends = (np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1).tolist()
    for a, b in zip([0, *ends], [*ends, batch.num_rows]):
        yield (batch.column(0)[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _count(batches):
    """Per split: whether its quotes are odd, the records that begin in it if it begins outside or inside a cell, and how its first line ends."""
    split, odd, begun, crlf = None, 0, [0, 0], False

    def row():
        return pa.RecordBatch.from_pylist([{"_file": split[0], "_block": split[1], "_odd": odd, "_outside": begun[0], "_inside": begun[1], "_crlf": crlf}], _arrow(_COUNTS))

    for batch in batches:
        for key, part in _parts(batch):
            if key != split:
                if split:
                    yield row()
                split, odd, begun, crlf = key, 0, [0, 0], part.column(4)[0].as_py()
            quotes = part.column(2).to_numpy().astype(np.int64)
            some = ~part.column(3).to_numpy(zero_copy_only=False)
            before = (odd + np.cumsum(quotes) - quotes) & 1
            begun = [begun[0] + int((some & (before == 0)).sum()), begun[1] + int((some & (before == 1)).sum())]
            odd = int(odd + quotes.sum()) & 1
    if split:
        yield row()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _cut(batches):
    """The records of every split, numbered from 0; those that begin before the split, or end after it, are not whole."""
    split, same, number, state = None, (), 0, 0
    held: list[str] = []  # lines of a record that has not ended
    begins = False  # in this split

    def rows(texts: list | pa.Array, first: int, begins: bool, whole: bool) -> pa.RecordBatch:
        n = len(texts)
        fixed = [[v] * n for v in (begins, whole, *same)]
        columns = [[split[0]] * n, [split[1]] * n, np.arange(first, first + n), texts, *fixed]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _arrow(_PIECES))], schema=_arrow(_PIECES))

    for batch in batches:
        for key, part in _parts(batch):
            if key != split:
                if held:
                    yield rows(["\n".join(held)], number - begins, begins, False)
                split, held, begins, number = key, [], False, 0
                state, *same = (part.column(c)[0].as_py() for c in (4, 5, 6))
            lines, quotes = part.column(2).cast(pa.string()), part.column(3).to_numpy().astype(np.int64)
            after = (state + np.cumsum(quotes)) & 1
            ends = np.flatnonzero(after == 0)
            a = 0
            if state:  # inside a cell: up to the first line that ends outside, all belongs to the record before
                a = int(ends[0]) + 1 if len(ends) else len(lines)
                held += lines.slice(0, a).to_pylist()
                if len(ends):
                    yield rows(["\n".join(held)], number - begins, begins, begins)
                    held, begins, ends = [], False, ends[1:]
            if len(ends):
                starts = np.append(np.append(a, ends[:-1] + 1), ends[-1] + 1).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), lines), "\n")
                texts = texts.filter(pc.invert(pc.is_in(texts, pa.array(["", "\r"]))))
                yield rows(texts, number, True, True)
                number, a = number + len(texts), int(ends[-1]) + 1
            if a < len(lines):
                held, begins, number = lines.slice(a).to_pylist(), True, number + 1
            state = int(after[-1])
    if held:
        yield rows(["\n".join(held)], number - begins, begins, False)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, record``: the records of all files, in order, without each file's header."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("_line"),
        (F.length("value") - F.length(F.translate("value", '"', ""))).alias("_quotes"), F.monotonically_increasing_id().alias("_mid"),
    )
    light = lines.select(*_SPLIT, "_quotes", F.col("_line").isin("", "\r").alias("_blank"), F.endswith("_line", F.lit("\r")).alias("_crlf"))
    counts = light.mapInArrow(_count, _COUNTS)
    of_file = W.partitionBy("_file").orderBy("_block")
    before = F.coalesce(F.sum("_odd").over(of_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    known = counts.withColumn("_state", before.cast("int")).withColumn("_crlf", F.first("_crlf").over(of_file))
    header = F.when(F.col("_block") == 0, 1).otherwise(0)
    known = known.select(*_SPLIT, "_state", "_crlf", (F.when(F.col("_state") == 0, F.col("_outside")).otherwise(F.col("_inside")) - header).alias("_rows"))
    splits = rownum._offsets(known, *_SPLIT).drop("_rows")
    columns = [*_SPLIT, "_line", "_quotes", "_state", "_before", "_crlf"]
    if rownum._max_splits(lines) <= rownum.BROADCAST_SPLITS:
        ordered = lines.join(F.broadcast(splits), _SPLIT).select(*columns)  # which keeps the order of the lines
    else:
        ordered = lines.join(splits, _SPLIT).repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "_mid").select(*columns)
    pieces = ordered.mapInArrow(_cut, _PIECES)
    whole = pieces.where("_whole").select(*_SPLIT, "_number", "_before", "_crlf", "_text")
    # A piece that begins a record, and those that follow it up to the next such piece.
    broken = pieces.where("NOT _whole").withColumn("_group", F.sum(F.col("_begins").cast("int")).over(W.partitionBy("_file").orderBy("_block", "_begins")))
    piece = F.struct("_block", "_begins", "_number", "_before", "_crlf", "_text")
    joined = broken.groupBy("_file", "_group").agg(F.sort_array(F.collect_list(piece)).alias("_all")).select(
        "_file", *[F.col("_all")[0][c].alias(c) for c in ("_block", "_number", "_before", "_crlf")], F.array_join(F.col("_all")["_text"], "\n").alias("_text")
    )
    found = whole.unionByName(joined).where("_block > 0 OR _number > 0")
    text = F.when(F.endswith("_text", F.lit("\r")), F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text"))
    # Where lines end with both characters, they count as one line break inside cells too.
    record = F.when(F.col("_crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("_text"))
    return found.select((F.col("_before") + F.col("_number") - header).alias("row_idx"), record.alias("record"))
