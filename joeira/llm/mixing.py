"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of their identifiers, form blocks of
``block_rows``.  With integer weights ``a`` of sum ``Q``, block ``i`` of a source
is released in slot ``floor(i * Q / a)`` and due by the end of slot
``ceil((i + 1) * Q / a) - 1``.  In each slot the released block with the earliest
deadline runs.  The weights fill the slots exactly, so a released block is
always there, every deadline is met, and after any number of slots a source is
less than one block away from its share.  The schedule repeats every ``Q``
slots, so one period (a fold over ``Q`` slots in a single expression) gives the
slot of every block.  Sources of equal weight have equal releases and deadlines and
take turns, so a slot compares one block for each *distinct* weight.

No row is dropped or repeated: a source that has run dry leaves its later slots
unused and the others go on in their slots.  Positions are consecutive and come
from a closed form, the rows that all sources have placed before a slot; no
window or sort over all rows is needed for them.

Rows are numbered inside their sources by one range shuffle on (source,
identifier, row), which has no heavy key however large a source is, and a count
per written part; everything else is a projection.  With more sources or slots
than fit in the plan (``max_cells``) the period is written as a table of one row a
source and joined, and a second range shuffle, on (slot, place in the source), gives
the positions.  Any number of sources has a result; what grows with it is one row
that lists them all.

Cases: a null source is a source of its own; null identifiers come first,
repeated ones are kept and ordered by their place in the input; an empty table
gives an empty result; ``mix`` refuses an input that has one of its result
columns already, ``mix_order`` leaves all other columns out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from joeira.llm.common import Scratch, parallelism

PLACE_BITS = 33  # of ``monotonically_increasing_id``, for the place in a part
PART_ROWS = 1_000_000  # rows of a part that one task sorts
MAX_CELLS = 2_000_000  # sources times slots of a period that go into the plan; beyond, both are a table
ADDED = ("source_index", "block", "slot", "release", "deadline", "position")


def _weights(counts: DataFrame, weights: dict, default: int) -> DataFrame:
    """One row with ``s``: an array of (source, n, a) over all sources, ordered by source."""
    for k, w in [*weights.items(), ("default", default)]:
        if int(w) != w or w < 1:
            raise ValueError(f"the weight of {k} has to be a whole number of at least 1")
    a = F.lit(default)
    if weights:
        known = None
        for k, w in weights.items():
            known = F.when(F.col("source").eqNullSafe(k), w) if known is None else known.when(F.col("source").eqNullSafe(k), w)
        a = known.otherwise(default)
    one = F.struct("source", F.col("n").cast("bigint").alias("n"), a.cast("bigint").alias("a"))
    rows = counts.agg(F.sort_array(F.collect_list(one)).alias("s"))
    return rows.withColumn("q", F.aggregate("s", F.lit(0).cast("bigint"), lambda x, e: x + e["a"]))


def _ceil_div(x: str, y: str) -> str:
    return f"(({x} + {y} - 1) DIV {y})"


def edf_period(sources: DataFrame) -> DataFrame:
    """``s, q`` with ``picks``: for each slot of a period the 1-based place in ``s`` of its source."""
    members = "transform(array_distinct(transform(s, e -> e.a)), a -> struct(a, filter(sequence(1, size(s)), i -> s[i - 1].a = a) AS m))"
    # The next block of class k, whose members take turns, is block c DIV size of member c % size.
    turn = "(acc.c[k - 1] DIV size(g[k - 1].m))"
    source = "g[k - 1].m[CAST(acc.c[k - 1] % size(g[k - 1].m) AS INT)]"
    deadline = _ceil_div(f"(({turn} + 1) * q)", "g[k - 1].a")
    released = f"({turn} * q) DIV g[k - 1].a <= t"
    pick = f"array_min(transform(filter(sequence(1, size(g)), k -> {released}), k -> struct({deadline} AS d, {source} AS i, k AS k)))"
    step = (
        f"element_at(transform(array({pick}), p -> named_struct("
        "'c', transform(acc.c, (x, j) -> IF(j = p.k - 1, x + 1L, x)), 'p', array_append(acc.p, p.i))), 1)"
    )
    # Slots are folded in stretches of about the root of their number: an appended array is copied each time.
    stretch = f"aggregate(sequence(u * w, least(q, (u + 1) * w) - 1), named_struct('c', whole.c, 'p', CAST(array() AS ARRAY<INT>)), (acc, t) -> {step})"
    fold = (
        "aggregate(sequence(0L, (q - 1) DIV w), named_struct('c', transform(g, e -> 0L), 'ps', CAST(array() AS ARRAY<ARRAY<INT>>)), "
        f"(whole, u) -> element_at(transform(array({stretch}), x -> named_struct('c', x.c, 'ps', array_append(whole.ps, x.p))), 1))"
    )
    ready = sources.withColumns({"g": F.expr(members), "w": F.expr("CAST(ceil(sqrt(q)) AS BIGINT)")})
    return ready.withColumn("picks", F.expr(f"IF(size(s) = 0, CAST(array() AS ARRAY<INT>), flatten({fold}.ps))")).drop("g", "w")


def _number(rows: DataFrame, order: list[str], scratch: Scratch, n: int) -> DataFrame:
    """The ``n`` rows with ``_rank``: 0-based place in the order of ``order``, by one range shuffle."""
    parts = rows.repartitionByRange(max(1, parallelism(rows.sparkSession), n // PART_ROWS), *order).sortWithinPartitions(*order)
    # The part and the row's place in it, written as a column: how many files a part is cut into does not matter.
    kept = scratch.save(parts.withColumn("_at", F.monotonically_increasing_id()))
    placed = kept.withColumns({"_part": F.shiftright("_at", PLACE_BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_at")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_n"))).alias("m"))
    before = table.selectExpr(
        "map_from_entries(transform(map_keys(m), k -> struct(k, aggregate(filter(map_entries(m), e -> e.key < k), 0L, (x, e) -> x + e.value)))) AS b"
    )
    return placed.withColumn("_rank", F.element_at(before.scalar(), F.col("_part")) + F.col("_row")).drop("_part", "_row")


def _by_table(ranked: DataFrame, sources: DataFrame, size, block_rows: int, source_col: str, scratch: Scratch) -> DataFrame:
    """Schedule and positions with the period as a table: a row a source with its weight, first rank and slots."""
    slots = sources.select(F.posexplode("picks").alias("t", "i")).groupBy("i").agg(F.sort_array(F.collect_list(F.col("t").cast("bigint"))).alias("_slots"))
    names = sources.select(F.posexplode("s").alias("i", "e")).select((F.col("i") + 1).alias("i"), F.col("e.source").alias("_source"), F.col("e.a").alias("_a"))
    firsts = ranked.groupBy(F.col(source_col).alias("_from")).agg(F.min("_rank").alias("_first"))
    known = names.join(slots, "i").drop("i")
    # Written, so that Spark knows its size: broadcast if small, else a join whose heavy sources are split.
    table = scratch.save(known.join(firsts, known["_source"].eqNullSafe(F.col("_from"))).drop("_from"))
    out = ranked.join(table, ranked[source_col].eqNullSafe(table["_source"])).withColumn("source_index", F.col("_rank") - F.col("_first"))
    out = out.withColumn("block", F.expr(f"source_index DIV {block_rows}")).withColumns({
        "slot": F.expr(f"(block DIV _a) * {size.q}L + _slots[CAST(block % _a AS INT)]"),
        "release": F.expr(f"(block * {size.q}L) DIV _a"),
        "deadline": F.expr(_ceil_div(f"((block + 1) * {size.q}L)", "_a")),
    }).drop("_source", "_a", "_first", "_slots", "_rank")
    return _number(out, ["slot", "source_index"], scratch, size.rows).withColumnRenamed("_rank", "position")


def mix(docs: DataFrame, weights: dict, default_weight: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", max_cells: int = MAX_CELLS) -> DataFrame:
    """All columns of ``docs`` with ``source_index, block, slot, release, deadline, position``."""
    clash = [c for c in (*ADDED, "_rank", "_part", "_row", "_at", "_uid", "_source", "_slots", "_first", "_a") if c in docs.columns]
    if clash:
        raise ValueError(f"the input has columns of the result: {clash}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    sources = scratch.save(edf_period(_weights(counts, weights, default_weight)))
    size = sources.selectExpr("size(s) AS n", "coalesce(q, 0L) AS q", "aggregate(s, 0L, (x, e) -> x + e.n) AS rows").first()
    order = [source_col, id_col, "_uid"]
    ranked = _number(docs.withColumn("_uid", F.monotonically_increasing_id()), order, scratch, size.rows).drop("_uid")
    if size.n * size.q > max_cells:
        return _by_table(ranked, sources, size, block_rows, source_col, scratch).select(*docs.columns, *ADDED)
    # For each slot of a period: how many of its earlier slots each source has; and for each source its slots.
    if not size.n:
        return ranked.withColumns({c: F.lit(None).cast("bigint") for c in ADDED}).drop("_rank")
    # At most MAX_CELLS numbers: they go into the plan as constants.
    tables = sources.selectExpr(
        "s", "q",
        "transform(sequence(0, CAST(q AS INT)), t -> transform(sequence(1, size(s)), i -> size(filter(slice(picks, 1, t), p -> p = i)))) AS seen",
        "transform(sequence(1, size(s)), i -> filter(sequence(0, CAST(q AS INT) - 1), t -> picks[t] = i)) AS slots",
        "transform(sequence(1, size(s)), i -> aggregate(slice(s, 1, i - 1), 0L, (x, e) -> x + e.n)) AS first_rank",
        "transform(s, e -> coalesce('=' || CAST(e.source AS STRING), '')) AS names",
        "transform(s, e -> e.n) AS n", "transform(s, e -> e.a) AS a",
    ).first()

    def fixed(name: str, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(tables[name])), kind)

    numbers = "array<bigint>"
    place = F.array_position(fixed("names", "array<string>"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))).cast("int")
    out = ranked.withColumn("_i", place).withColumn("source_index", F.col("_rank") - F.element_at(fixed("first_rank", numbers), F.col("_i")))
    out = out.withColumn("block", F.expr(f"source_index DIV {block_rows}"))
    out = out.withColumns({"_s": F.element_at(fixed("a", numbers), F.col("_i")), "_q": F.lit(tables.q).cast("bigint")})
    out = out.withColumns({
        "slot": F.expr("(block DIV _s) * _q") + F.element_at(F.element_at(fixed("slots", "array<array<bigint>>"), F.col("_i")), (F.expr("block % _s") + 1).cast("int")),
        "release": F.expr("(block * _q) DIV _s"),
        "deadline": F.expr(_ceil_div("((block + 1) * _q)", "_s")),
    })
    periods = F.expr("slot DIV _q")
    seen = F.element_at(fixed("seen", "array<array<bigint>>"), (F.expr("slot % _q") + 1).cast("int"))
    pairs = F.arrays_zip(fixed("n", numbers).alias("n"), fixed("a", numbers).alias("a"))
    placed = F.zip_with(pairs, seen, lambda e, c: F.least(e["n"], (periods * e["a"] + c) * block_rows))
    out = out.withColumn("position", F.aggregate(placed, F.lit(0).cast("bigint"), lambda x, n: x + n) + F.expr(f"source_index % {block_rows}"))
    return out.select(*docs.columns, *ADDED)


def mix_order(docs: DataFrame, weights: dict, default_weight: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", max_cells: int = MAX_CELLS) -> DataFrame:
    """Identifier, source and place in the mixture of every row, without the other columns."""
    return mix(docs.select(id_col, source_col), weights, default_weight, block_rows, id_col, source_col, max_cells)
