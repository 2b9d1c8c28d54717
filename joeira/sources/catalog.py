"""Tables of the Spark catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def get_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


# What a number, date, flag or array element counts for.
FIXED_WIDTH = 8


def _size(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), F.size(c) * FIXED_WIDTH).otherwise(0)
    return F.when(c.isNotNull(), F.lit(FIXED_WIDTH)).otherwise(0)


def frame_stats(df: DataFrame, name: str) -> DataFrame:
    """Row count and size of the rows, in one aggregate.

    The size is that of the values whatever the file format: the characters of
    texts, and ``FIXED_WIDTH`` for everything else, array elements one by one.
    """
    width = sum((_size(f.name, f.dataType).cast("bigint") for f in df.schema), F.lit(0).cast("bigint"))
    return (
        df.select(width.alias("n"))
        .agg(F.count("*").alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
        .select(
            F.lit(name).alias("table_name"),
            "row_count",
            "size",
            F.round(F.when(F.col("row_count") > 0, F.col("size") / F.col("row_count")).otherwise(0.0), 6).alias("avg_row_size"),
        )
    )


def table_stats(spark: SparkSession, name: str) -> DataFrame:
    if not table_exists(spark, name):
        raise ValueError(f"table {name!r} does not exist")
    return frame_stats(get_table(spark, name), name)
