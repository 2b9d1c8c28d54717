"""Joining rows to a table of per-key counts when one key may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A salt of a hot key gets about so many rows.
HOT_ROWS = 1_000_000
# At most so many keys are split, which bounds the list of them that is broadcast.
HOT_KEYS = 65_536


def join_counted_keys(
    rows: DataFrame, keys: DataFrame, key: str, count: str = "n", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (one row per key, with its count).

    A key with more than ``hot_rows`` rows is spread over as many salts as it
    holds that many, and its one row in ``keys`` is repeated per salt.  On a table
    where more than ``HOT_KEYS`` keys could be that large, the target rises to a
    ``HOT_KEYS``-th of all rows, so the broadcast list of hot keys stays short.
    ``rows`` must carry ``row_idx``.
    """
    total = keys.agg(F.sum(count)).scalar()
    target = F.greatest(F.lit(hot_rows).cast("double"), total / HOT_KEYS)
    portions = F.ceil(F.col(count) / target)
    hot = F.col(count) > target
    salted = keys.withColumn("_salts", F.when(hot, portions).otherwise(F.lit(1)).cast("int"))

    spread = salted.filter("_salts > 1").select(key, "_salts")
    left = rows.join(F.broadcast(spread), key, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("row_idx"), F.col("_salts")).cast("int")
        ),
    ).drop("_salts")
    right = salted.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
