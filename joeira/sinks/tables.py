"""Table sinks: CSV, JSON lines, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joeira.functions.ids import pad_id
from joeira.sinks.files import replace
from joeira.sources.landing import FORMATS


def check_format(fmt: str) -> str:
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; allowed: {', '.join(FORMATS)}")
    return fmt


def safe_name(sheet_name: str) -> str:
    """Driver-side twin of ``sanitise_name`` for one name."""
    return sheet_name.replace(" ", "_").replace("/", "_")


def padded(df: DataFrame) -> DataFrame:
    """``ID`` as text of at least four characters; other columns untouched."""
    if "ID" not in df.columns:
        return df
    return df.withColumn("ID", pad_id(F.col("ID").cast("string")))


def write_table(df: DataFrame, out_dir: str, sheet_name: str, fmt: str = "csv") -> str:
    """Write the rows under the sheet's file-safe name; returns the path.

    A table of that name stays until the new one is whole, also if the write fails.
    """
    fmt = check_format(fmt)
    path = f"{out_dir.rstrip('/')}/{safe_name(sheet_name)}.{fmt}"
    writer = df.write
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    return replace(df.sparkSession, path, lambda staged: writer.format(fmt).save(staged))
