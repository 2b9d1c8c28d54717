"""Repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from joeira.functions.values import share
from joeira.operators.skew import HOT_ROWS, join_counted_keys


def key_counts(df: DataFrame, key: str = "ID") -> DataFrame:
    """Rows and first position of every key, null included."""
    return df.groupBy(key).agg(F.count("*").alias(counter(key)), F.min("row_idx").alias("first_row"))


def counter(key: str) -> str:
    """Name of the column with a key's count: ``n``, unless the key is called that."""
    return "n" if key != "n" else "n_rows"


def repeated_keys(counted: DataFrame, key: str = "ID") -> DataFrame:
    """Keys of ``key_counts`` that occur more than once.

    The tests are on the counts, so that they stay above the grouping and its
    shuffle can serve every result that comes from it.
    """
    rows = F.when(F.col(key).isNotNull() & F.col("first_row").isNotNull(), F.col(counter(key))).otherwise(0)
    return counted.filter(rows > 1)


def duplicate_keys(df: DataFrame, key: str = "ID") -> DataFrame:
    """Keys that occur more than once."""
    return key_counts(df.filter(F.col(key).isNotNull()), key).filter(F.col(counter(key)) > 1)


def duplicate_rows(df: DataFrame, key: str = "ID", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row whose key is repeated, one per line, however many there are."""
    rows = df.filter(F.col(key).isNotNull()).select(key, "row_idx")
    joined = join_counted_keys(rows, duplicate_keys(df, key), key, counter(key), hot_rows=hot_rows)
    return joined.select(key, counter(key), "first_row", "row_idx", (F.col("row_idx") + 2).alias("line_no"))


def duplicate_summary(df: DataFrame, key: str = "ID") -> DataFrame:
    """Rows involved, their share of all rows, and the number of keys."""
    return summary_of(key_counts(df.select(key, "row_idx"), key), key)


def summary_of(counted: DataFrame, key: str = "ID") -> DataFrame:
    """``duplicate_summary`` from ``key_counts``."""
    n = counter(key)
    repeated = F.col(key).isNotNull() & (F.col(n) > 1) & F.col("first_row").isNotNull()
    return counted.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(repeated, F.col(n))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(repeated).alias("duplicate_keys"),
    ).withColumn("duplicate_share", F.round(share(F.col("duplicate_rows"), F.col("total_rows")), 6))


def rows_of_first_duplicates(df: DataFrame, counted: DataFrame, keys: int = 3, key: str = "ID") -> DataFrame:
    """Every row of the first repeated keys, one per line; ``place`` is that of the key.

    Only the keys, ``keys`` of them, are gathered; their rows are not.
    """
    top = repeated_keys(counted, key).orderBy("first_row").limit(keys)
    top = top.withColumn("place", F.row_number().over(W.orderBy("first_row")))
    return df.select(key, "row_idx").join(F.broadcast(top), key)


def first_duplicates(df: DataFrame, keys: int = 3, rows: int = 10, key: str = "ID") -> DataFrame:
    """The first repeated keys with their first rows, for display.

    ``n_more`` says how many rows are not shown.  The list of keys is cut
    first (a top-k), so only a handful of rows is ever gathered.
    """
    top = duplicate_keys(df, key).orderBy("first_row").limit(keys)
    order = W.partitionBy(key).orderBy("row_idx")
    return (
        df.select(key, "row_idx")
        .join(F.broadcast(top), key)
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= rows)
        .groupBy(key, counter(key), "first_row")
        .agg(F.sort_array(F.collect_list(F.col("row_idx") + 2)).alias("lines"))
        .withColumn("n_more", F.col(counter(key)) - F.size("lines"))
    )
