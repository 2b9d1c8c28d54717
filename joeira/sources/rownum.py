"""File-order row numbers without a global sort.

A split of a file is read by one task from front to back, so the position of
a row is the number of rows in earlier splits plus its position in its own
split.  The first is a count per split (one light pass), the second comes
from ``monotonically_increasing_id``.  Parquet keeps the position inside the
file itself, so there only the files are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# More splits than this are joined by shuffle instead of broadcast.
# One entry is a path and three numbers: about 20 MB at the limit.
BROADCAST_SPLITS = 100_000


def _offsets(counts: DataFrame, *order: str) -> DataFrame:
    """Rows before each split, from one small row per split."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _max_splits(df: DataFrame) -> int:
    """How many splits the scan can have at most: tasks plus files."""
    return df.rdd.getNumPartitions() + len(df.inputFiles())


def with_row_idx(df: DataFrame, name: str = "row_idx", order_column: str | None = None) -> DataFrame:
    """Add a 0-based row position as the first column.

    ``df`` must come straight from a file scan.  A table that carries a unique
    order column needs no numbering: name it and it is used as it is.
    """
    if order_column is not None:
        return df.select(F.col(order_column).cast("bigint").alias(name), *df.columns)

    columns = df.columns
    tagged = df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    counts = tagged.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.min("_mid").alias("_first")
    )
    splits = _offsets(counts, "_file", "_block")
    if _max_splits(df) <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    position = F.col("_mid") - F.col("_first")
    # A split that was cut differently in the two passes must fail, not misnumber.
    checked = F.when(position.between(0, F.col("_rows") - 1), F.col("_before") + position).otherwise(
        F.raise_error(F.lit("the file splits changed while rows were being numbered"))
    )
    return tagged.join(splits, ["_file", "_block"], "left").select(
        checked.cast("bigint").alias(name), *columns
    )


def with_parquet_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Row position of a Parquet scan: rows in earlier files plus row in file."""
    columns = df.columns
    tagged = df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        F.count("*").alias("_rows")
    )
    files = _offsets(counts, "_file").drop("_rows")
    if len(df.inputFiles()) <= BROADCAST_SPLITS:
        files = F.broadcast(files)
    return tagged.join(files, "_file", "left").select(
        (F.col("_before") + F.col("_row")).cast("bigint").alias(name), *columns
    )


def line_no(row_idx: str = "row_idx"):
    """Line of the file as a person counts it: one header, counting from one."""
    return F.col(row_idx) + 2
