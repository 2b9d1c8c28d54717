"""Content fingerprints and change tracking between loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HISTORY_SCHEMA = (
    "source_id string, sheet_name string, filename string, download_time timestamp, row_count bigint, "
    "column_count int, columns array<string>, data_hash string, revision_id string"
)

FINGERPRINT_SCHEMA = "row_count bigint, column_count int, data_hash string"

# Each row's hash is cut into lanes of 20 bits that are summed as BIGINT:
# exact up to 2^43 rows, and past that the sum fails instead of wrapping.
_LANE_BITS = 20


def row_text(columns: Sequence[str]) -> Column:
    """The row as one unambiguous text: every value with its length, null as -."""
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *cells)


def _list_text(names: Sequence[str]) -> str:
    """The names as one unambiguous text: every one with its length, unless all are plain words."""
    if all(n.isidentifier() for n in names):
        return ",".join(names)
    return ",".join(f"{len(n)}:{n}" for n in names)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
    """One row: row count, column count and a hash of the whole content.

    ``ordered`` mixes ``row_idx`` into every row, so moving a row changes the
    result; otherwise ``row_idx`` is left out, unless ``columns`` names it.  The hash is a sum over rows: it needs one pass, no sort, and no
    shuffle beyond one small row per task.
    """
    names = list(columns) if columns else [c for c in df.columns if c != "row_idx"]
    hashed = ["row_idx", *[c for c in names if c != "row_idx"]] if ordered else names
    word = F.conv(F.substring(F.md5(row_text(hashed)), 1, 15), 16, 10).cast("bigint")
    mask = (1 << _LANE_BITS) - 1
    lanes = [F.shiftright("w", _LANE_BITS * i).bitwiseAND(F.lit(mask)) for i in range(3)]
    sums = [F.coalesce(F.sum(lane), F.lit(0)).alias(f"s{i}") for i, lane in enumerate(lanes)]
    whole = F.concat_ws(
        ":", F.lit(_list_text(names)), *[F.col(c).cast("string") for c in ("row_count", "s2", "s1", "s0")]
    )
    return (
        df.select(word.alias("w"))
        .agg(F.count("*").alias("row_count"), *sums)
        .select("row_count", F.lit(len(names)).alias("column_count"), F.md5(whole).alias("data_hash"))
    )


def latest_revision(history: DataFrame) -> DataFrame:
    """Newest entry of every source."""
    entry = F.struct(*[c for c in history.columns if c != "source_id"])
    return history.groupBy("source_id").agg(F.max_by(entry, "download_time").alias("e")).select("source_id", "e.*")


def next_revision(same: Column, previous: Column, now_epoch: Column) -> Column:
    """Unchanged content keeps its revision, changed content counts up.

    Without a usable previous number the revision is the epoch second.
    """
    counted = previous.try_cast("bigint")
    return (
        F.when(same & previous.isNotNull(), previous)
        .when(counted.isNotNull(), (counted + 1).cast("string"))
        .otherwise(now_epoch.cast("string"))
    )


def change_status(current: DataFrame, previous: DataFrame, now_epoch: Column | None = None) -> DataFrame:
    """Compare new fingerprints with the last known ones, source by source.

    Both sides hold one row per source: ``source_id``, ``row_count``,
    ``data_hash``; ``previous`` also ``revision_id``.
    """
    now_epoch = F.unix_timestamp() if now_epoch is None else now_epoch
    old = previous.select(
        "source_id",
        F.col("row_count").alias("old_row_count"),
        F.col("data_hash").alias("old_hash"),
        F.col("revision_id").alias("old_revision"),
        F.lit(True).alias("_known"),
    )
    same = F.coalesce(F.col("data_hash") == F.col("old_hash"), F.lit(False))
    return current.join(old, "source_id", "left").select(
        "source_id",
        F.col("_known").isNull().alias("first_time"),
        (F.col("_known").isNotNull() & ~same).alias("content_changed"),
        "old_row_count",
        "row_count",
        (F.col("row_count") - F.col("old_row_count")).alias("row_delta"),
        "old_hash",
        "data_hash",
        "old_revision",
        next_revision(same, F.col("old_revision"), now_epoch).alias("revision_id"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The metadata history; empty before the first record."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def record_load(
    df: DataFrame, history_path: str, source_id: str, sheet_name: str, filename: str, ordered: bool = True,
    new: DataFrame | None = None,
) -> DataFrame:
    """Fingerprint the rows, carry the revision on and append to the history.

    ``new`` is the rows' fingerprint where it is known already.  Returns the new entry.  IDs should be padded first, so that every load is
    compared in the same form.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c != "row_idx"]
    new = (fingerprint(df, ordered=ordered) if new is None else new).withColumn("source_id", F.lit(source_id))
    known = latest_revision(read_history(spark, history_path).filter(F.col("source_id") == source_id))
    entry = change_status(new, known).select(
        "source_id",
        F.lit(sheet_name).alias("sheet_name"),
        F.lit(filename).alias("filename"),
        F.current_timestamp().alias("download_time"),
        "row_count",
        F.lit(len(names)).alias("column_count"),
        F.array(*[F.lit(c) for c in names]).alias("columns"),
        "data_hash",
        "revision_id",
    )
    row = entry.collect()  # a single row; evaluated once so that what is returned is what is stored
    stored = spark.createDataFrame(row, HISTORY_SCHEMA)
    stored.coalesce(1).write.mode("append").parquet(history_path)
    return stored
