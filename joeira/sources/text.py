"""CSV scans.

Every column is read as text under the header's own names, so that leading
zeros stay and one blank cell never changes how its neighbours look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from joeira.functions.missing import NA_TOKENS, na_to_null
from joeira.sources.quoted import records
from joeira.sources.rownum import with_row_idx

CORRUPT = "_corrupt_record"

# Quotes inside a quoted cell are doubled, as in RFC 4180.
_CSV = {"header": "true", "encoding": "UTF-8", "escape": '"', "mode": "PERMISSIVE"}


def header_names(spark: SparkSession, path: str, **options: str) -> list[str]:
    """Column names of a CSV; reads the first line only."""
    return spark.read.options(**{**_CSV, **options}).csv(path).columns


def _quoted(spark: SparkSession, path: str, mark_corrupt: bool) -> DataFrame:
    """Numbered rows of files with line breaks inside quotes, however large each of them is."""
    names = header_names(spark, path, multiLine="true")
    parsed = from_csv_lines(records(spark, path), "record", names)
    return parsed if mark_corrupt else parsed.drop(CORRUPT)


def _scan(spark: SparkSession, path: str, mark_corrupt: bool) -> DataFrame:
    names = header_names(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {**_CSV, "enforceSchema": "false"}
    if mark_corrupt:
        # Lines are only compared with the full column list when none is pruned.
        schema = schema.add(CORRUPT, T.StringType())
        options |= {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
    return spark.read.options(**options).schema(schema).csv(path)


def read_quality_csv(
    spark: SparkSession,
    path: str,
    na_tokens: tuple[str, ...] = NA_TOKENS,
    multiline: bool = False,
    numbered: bool = True,
) -> DataFrame:
    """Scan for the quality checks: NA tokens become null, rows numbered.

    ``multiline`` is for quoted cells that hold line breaks; such files are read in pieces too, at the price of a pass over their quotes.
    """
    if multiline:
        df = _quoted(spark, path, mark_corrupt=False)
        df = df if numbered else df.drop("row_idx")
    else:
        df = _scan(spark, path, mark_corrupt=False)
        df = with_row_idx(df) if numbered else df
    return na_to_null(df, na_tokens)


def read_patient_csv(
    spark: SparkSession, path: str, multiline: bool = False, numbered: bool = True
) -> DataFrame:
    """Scan for validation: no NA tokens, lines of a wrong length marked."""
    if multiline:
        df = _quoted(spark, path, mark_corrupt=True)
        return df if numbered else df.drop("row_idx")
    df = _scan(spark, path, mark_corrupt=True)
    return with_row_idx(df) if numbered else df


def read_sheet_json(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """JSON records; with ``names`` no inference pass is made."""
    reader = spark.read
    if names is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return reader.option("primitivesAsString", "true").json(path)


def file_lines(df: DataFrame) -> DataFrame:
    """Rows per source file, with its path and size."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
    ).agg(F.count("*").alias("row_count"))


def to_csv_line(names: list[str]) -> Column:
    """The columns as one line of a CSV, as the CSV sink writes it."""
    return F.to_csv(F.struct(*names), {"escape": '"'})


def from_csv_lines(df: DataFrame, line: str, names: list[str], keep: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Parse lines held in a column, as ``read_patient_csv`` parses those of a file: wrong lengths are marked."""
    schema = ", ".join([*[f"`{n}` string" for n in names], f"{CORRUPT} string"])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return df.select(*keep, F.from_csv(F.col(line), F.lit(schema), options).alias("_r")).select(*keep, "_r.*")
