"""What a table looks like from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joeira.sources.text import file_lines


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Files, size, rows and columns of a table read from files."""
    files = file_lines(df)
    return files.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.count("*").alias("files"),
        F.min("file_path").alias("file_path"),
        F.round(F.sum("file_size") / 1024, 2).alias("file_size_kb"),
    ).select(
        F.lit(name).alias("table_name"),
        F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        "file_path",
        "files",
        "file_size_kb",
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def shape(df: DataFrame, name: str) -> DataFrame:
    """Row and column counts of any table."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )
