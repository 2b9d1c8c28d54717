"""Number sequences per group: extent, missing numbers, gaps.

Numbers are first folded to bitmaps: a 64-bit word for every 64 consecutive
values of a group, or-ed together before and after one shuffle, so a dense
sequence moves a word for up to 64 numbers, however often each occurs.  Extent,
counts and the gaps inside a word are read off its bits.

Gaps between words come from comparing each word with the next one.  A window
over a whole group could be unbounded, so words are compared inside blocks of
2^21 consecutive values first, then block edges inside larger blocks, then the
edges of those inside the group.  Every window partition therefore holds at
most about two million rows, whatever the data looks like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from joeira.functions.ids import serial_from_id, year_prefix

# Block widths as powers of two; the last step takes the group as a whole.
BLOCK_BITS = (21, 42, None)
INT_BLOCK_BITS = (21, None)
# A word of a bitmap holds 2^6 numbers.
WORD_BITS = 6


def id_serials(df: DataFrame) -> DataFrame:
    """Year prefix and serial of every non-null ID."""
    present = df.filter(F.col("ID").isNotNull())
    return present.select(
        year_prefix(F.col("ID")).alias("year"), serial_from_id(F.col("ID")).alias("serial")
    )


def id_serials_of(counted: DataFrame, count: str = "n") -> DataFrame:
    """``id_serials`` from rows per ID, with their number; see ``duplicates.repeated_keys`` for the form of the filter."""
    rows = F.when(F.col("ID").isNotNull() & F.col("first_row").isNotNull(), F.col(count)).otherwise(0)
    return counted.filter(rows > 0).select(
        year_prefix(F.col("ID")).alias("year"), serial_from_id(F.col("ID")).alias("serial"), F.col(count).alias("_rows")
    )


def _words(df: DataFrame, group: str, number: str, weight: str | None = None) -> DataFrame:
    """``_word``, its ``_bits`` and the rows ``_n`` in it, for every group; a null number has a word of its own, without bits."""
    rows = F.count("*") if weight is None else F.sum(weight)
    n = F.col(number).cast("bigint")
    place = n.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    return (
        df.select(group, *([] if weight is None else [weight]), F.shiftright(n, WORD_BITS).alias("_word"), place.alias("_place"))
        .groupBy(group, "_word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_place"))).alias("_bits"), rows.alias("_n"))
    )


def _extent() -> tuple[Column, Column]:
    """The smallest and the largest number of a word."""
    first = F.shiftleft("_word", WORD_BITS)
    # The zeros below the lowest bit; less one is too small a number only for the highest bit alone.
    below = F.coalesce(F.bit_count(F.try_subtract("_bits", F.lit(1).cast("bigint")).bitwiseAND(F.bitwise_not("_bits"))), F.lit((1 << WORD_BITS) - 1))
    return F.when(F.col("_bits").isNotNull(), first + below), first + (F.length(F.bin("_bits")) - 1)


def sequences(df: DataFrame, group: str = "year", number: str = "serial", weight: str | None = None) -> DataFrame:
    """Rows, smallest and largest number, and how many are missing between.

    Rows are first folded to words of 64 numbers, so a group with very many rows
    costs its reducer only its words.  A group is not
    ``valid`` without any number, or if more numbers are missing than a BIGINT
    can say; its ``missing_count`` is null then.  With ``weight`` a row of ``df``
    stands for that many rows.
    """
    # Two serials may be more than a BIGINT apart.
    span = F.col("max_serial").cast("decimal(20,0)") - F.col("min_serial").cast("decimal(20,0)") + 1
    missing = span - F.col("distinct_serials")
    lo, hi = _extent()
    return (
        _words(df, group, number, weight)
        .groupBy(group)
        .agg(
            F.sum("_n").alias("count"),
            F.min(lo).alias("min_serial"),
            F.max(hi).alias("max_serial"),
            F.coalesce(F.sum(F.bit_count("_bits").cast("bigint")), F.lit(0)).alias("distinct_serials"),
        )
        .withColumns({c: F.col(c).cast(df.schema[number].dataType) for c in ("min_serial", "max_serial")})
        .select(
            group,
            "count",
            missing.try_cast("bigint").isNotNull().alias("valid"),
            "min_serial",
            "max_serial",
            missing.try_cast("bigint").alias("missing_count"),
            F.round(missing.cast("double") / span.cast("double"), 6).alias("missing_share"),
        )
    )


def gap_ranges(df: DataFrame, group: str = "year", number: str = "serial") -> DataFrame:
    """First and last missing number of every gap; ``gap_len`` is null beyond a BIGINT."""
    levels = INT_BLOCK_BITS if isinstance(df.schema[number].dataType, T.IntegerType) else BLOCK_BITS
    words = _words(df.filter(F.col(number).isNotNull()), group, number).select(group, "_word", "_bits")
    # Words move, not numbers: they are unfolded where the first windows are.
    spans = _runs(words.withColumn("_block", F.shiftright("_word", levels[0] - WORD_BITS)).repartition(group, "_block"), group)
    found = []
    for level, bits in enumerate(levels):
        order = W.partitionBy(group, *([] if bits is None else ["_block"])).orderBy("_lo")
        met = spans.withColumns({"_next": F.lead("_lo").over(order), "_first": F.first("_lo").over(order)})
        found.append(
            met.withColumn("_step", F.try_subtract("_next", "_hi"))
            .filter(F.col("_next").isNotNull() & F.coalesce(F.col("_step") > 1, F.lit(True)))
            .select(
                group,
                (F.col("_hi") + 1).alias("gap_start"),
                (F.col("_next") - 1).alias("gap_end"),
                (F.col("_step") - 1).alias("gap_len"),
            )
        )
        if bits is not None:
            # The last row of a block knows its first number: one row a block goes on.
            spans = met.filter(F.col("_next").isNull()).select(group, F.col("_first").alias("_lo"), "_hi")
            if levels[level + 1] is not None:
                spans = spans.withColumn("_block", F.shiftright("_lo", levels[level + 1]))
    return reduce(DataFrame.unionByName, found)


def _runs(words: DataFrame, group: str) -> DataFrame:
    """``_lo, _hi`` of each word without a gap inside, which most of a dense sequence are; of other words each number."""
    lo, hi = _extent()
    full = F.bit_count("_bits") == F.col("_hi") - F.col("_lo") + 1
    there = F.getbit("_bits", F.col("_n").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")) == 1
    return (
        words.withColumns({"_lo": lo, "_hi": hi})
        .withColumn("_full", full)
        .withColumn("_n", F.explode(F.when(F.col("_full"), F.array("_lo")).otherwise(F.sequence("_lo", "_hi"))))
        .filter(there)
        .select(group, "_block", F.col("_n").alias("_lo"), F.when(F.col("_full"), F.col("_hi")).otherwise(F.col("_n")).alias("_hi"))
    )


def _cut(gaps: DataFrame, width: Column) -> DataFrame:
    """Gaps cut into pieces of at most ``width`` numbers; the caller sees to it that a gap has not too many."""
    cut = F.explode(F.sequence("_from", "_to", "_width"))
    far = F.try_add("_from", F.col("_width") - 1)
    return gaps.withColumn("_width", width).withColumn("_from", cut).withColumn("_to", F.least(F.coalesce(far, F.col("_to")), "_to")).drop("_width")


def missing_numbers(gaps: DataFrame, group: str = "year") -> DataFrame:
    """Every missing number, one per row.

    The list is as long as the gaps are wide: one stray number can ask for more
    rows than any disk holds, and ``gap_ranges`` is the safe form.  A gap is cut
    into at most 2^16 pieces, which are spread over all tasks, so a long gap is
    not written out by a single task; a piece is cut again level by level, so no
    array has more than 2^16 elements and a limit on the result ends early.
    """
    spread = int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    below, above = F.col("gap_start") < 0, F.col("gap_end") >= 0
    # Halves on either side of zero: the width of each fits a BIGINT.
    halves = F.array(
        F.when(below, F.struct(F.col("gap_start").alias("a"), F.least(F.lit(-1).cast("bigint"), "gap_end").alias("b"))),
        F.when(above, F.struct(F.greatest(F.lit(0).cast("bigint"), "gap_start").alias("a"), F.col("gap_end").alias("b"))),
    )
    signed = gaps.select(group, F.explode(halves).alias("_h")).filter("_h IS NOT NULL").select(
        group, F.col("_h.a").alias("_from"), F.col("_h.b").alias("_to")
    )
    bits = F.length(F.bin(F.col("_to") - F.col("_from")))
    pieces = _cut(signed, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(16), bits - 16))).repartition(spread, "_from")
    # ``coalesce`` moves nothing here.  It keeps the levels in code of their own: fused, the inner arrays of one row would
    # all be unfolded before the next operator gets a row.
    for width in (32, 16):
        pieces = _cut(pieces, F.lit(1 << width).cast("bigint")).coalesce(spread)
    return pieces.select(group, F.explode(F.sequence("_from", "_to")).alias("missing_serial"))


def missing_preview(gaps: DataFrame, limit: int = 5, group: str = "year") -> DataFrame:
    """The first missing numbers of every group and how many more there are.

    Looks at the first ``limit`` gaps only, since every gap holds at least one
    missing number.
    """
    # Unknown as soon as one gap, or their sum, is beyond a BIGINT.
    counted = F.when(F.count("*") == F.count("gap_len"), F.try_sum("gap_len"))
    totals = gaps.groupBy(group).agg(counted.alias("missing_count"))
    order = W.partitionBy(group).orderBy("gap_start")
    first = (
        gaps.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= limit)
        .select(
            group,
            F.explode(
                F.sequence("gap_start", F.least(F.col("gap_end"), F.col("gap_start") + limit - 1))
            ).alias("number"),
        )
        .groupBy(group)
        .agg(F.slice(F.sort_array(F.collect_list("number")), 1, limit).alias("shown"))
    )
    more = F.col("missing_count") - F.size("shown")
    return first.join(totals, group).select(
        group,
        F.concat(
            F.array_join(F.col("shown").cast("array<string>"), ", "),
            F.when(more > 0, F.concat(F.lit(", ... ("), more.cast("string"), F.lit(" more)"))).otherwise(""),
        ).alias("missing_text"),
        "missing_count",
        more.alias("n_more"),
    )


def year_prefixes(df: DataFrame) -> DataFrame:
    """Distinct ID prefixes with their number, where they have one."""
    return (
        df.filter(F.col("ID").isNotNull())
        .select(year_prefix(F.col("ID")).alias("prefix"))
        .distinct()
        .withColumn("year", F.col("prefix").try_cast("int"))
    )


def unusual_years(df: DataFrame, as_of) -> DataFrame:
    """Prefixes more than a year ahead or more than ten years back."""
    current = as_of.year % 100
    kind = F.when(F.col("year") > current + 1, "future").when(F.col("year") < current - 10, "very_old")
    return year_prefixes(df).withColumn("kind", kind).filter(F.col("kind").isNotNull())
