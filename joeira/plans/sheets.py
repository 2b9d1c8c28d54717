"""Importing exported sheets: read, pad IDs, compare with the last load, write, record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from joeira.operators.tracking import (
    FINGERPRINT_SCHEMA, change_status, fingerprint, latest_revision, read_history, record_load,
)
from joeira.sinks.tables import check_format, padded, write_table
from joeira.sources.landing import Names, Sheet, find_sheet, ingest_all, read_path


def pending_change(
    spark: SparkSession, landing: str, sheet_name: str, history: str, sheet_format: str | None = None
) -> DataFrame:
    """How the sheet in the landing directory differs from its last import.

    One row: first import or not, content changed or not, old and new row
    count.  The content hash does not depend on row order, so a re-export that
    only splits the files differently counts as unchanged.
    """
    sheet = find_sheet(spark, landing, sheet_name, sheet_format, Names(spark, history))
    now = fingerprint(padded(read_path(spark, sheet.path, sheet.format)), ordered=False)
    known = latest_revision(read_history(spark, history).filter(F.col("source_id") == sheet.target))
    return change_status(now.withColumn("source_id", F.lit(sheet.target)), known)


def _store(sheet: Sheet, rows: DataFrame, out_dir: str, history: str, fmt: str, names: Names) -> str | None:
    """Write and record one sheet under its own name: one pass to hash and count, one to write.

    The name is written down first, so that no other sheet is ever given it.
    """
    rows = padded(rows)
    new = rows.sparkSession.createDataFrame(fingerprint(rows, ordered=False).collect(), FINGERPRINT_SCHEMA)
    if new.first().row_count == 0:
        return None
    names.keep(sheet)
    path = write_table(rows, out_dir, sheet.target, fmt)
    record_load(rows, history, sheet.target, sheet.name, f"{sheet.target}.{fmt}", ordered=False, new=new)
    return path


def import_sheet(
    spark: SparkSession, landing: str, sheet_name: str, out_dir: str, history: str, fmt: str = "csv",
    sheet_format: str | None = None,
) -> str | None:
    """Import one sheet; returns its path, or None when it has no rows."""
    fmt = check_format(fmt)
    names = Names(spark, history)
    sheet = find_sheet(spark, landing, sheet_name, sheet_format, names)
    return _store(sheet, read_path(spark, sheet.path, sheet.format), out_dir, history, fmt, names)


def import_all(spark: SparkSession, landing: str, out_dir: str, history: str, fmt: str = "csv") -> DataFrame:
    """Import every sheet, going on past failures; one status row per sheet."""
    fmt = check_format(fmt)
    names = Names(spark, history)
    return ingest_all(spark, landing, lambda sheet, rows: _store(sheet, rows, out_dir, history, fmt, names), names)
