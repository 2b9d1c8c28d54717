"""Exported sheets in a landing directory.

A sheet is one file (``Ward A.csv``) or one folder of part files
(``Ward_A.csv/part-*``); its name is the first path component below the
landing directory without the extension.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from joeira.functions.ids import sanitise_name
from joeira.sources.text import read_quality_csv, read_sheet_json

FORMATS = ("csv", "json", "parquet")


def _roots(spark: SparkSession, landing: str) -> tuple[list[str], list[str]]:
    """The full paths that ``landing`` (a folder, relative or with ``..``, or a pattern) stands for, and their folders."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(landing)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(fs.makeQualified(where)) or [])
    if not found:
        raise FileNotFoundError(f"no landing folder {landing!r}")
    paths = [s.getPath().toString() for s in found]
    folders = [p if s.isDirectory() else s.getPath().getParent().toString() for s, p in zip(found, paths)]
    return paths, sorted(set(folders), key=len, reverse=True)


def list_sheets(spark: SparkSession, landing: str) -> DataFrame:
    """Name, format, path, size and change time of every sheet, by name.

    Only file metadata is read; the content column is pruned away.  A file
    outside the landing folder fails the listing instead of leaving it short.
    """
    paths, folders = _roots(spark, landing)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([re.sub(r"([\\{}\[\]*?^])", r"\\\1", p) for p in paths])
        .select("path", "length", "modificationTime")
    )
    # The listing carries full paths; keep what follows the landing folder.
    root = F.coalesce(
        *[F.when(F.startswith("path", F.lit(f.rstrip("/") + "/")), F.lit(f.rstrip("/") + "/")) for f in folders],
        F.raise_error(F.concat(F.lit("file outside the landing folder: "), F.col("path"))).cast("string"),
    )
    files = files.withColumn("_root", root)
    below = F.expr("substring(path, length(_root) + 1)")
    return (
        files.groupBy("_root", F.substring_index(below, "/", 1).alias("_entry"))
        .agg(
            F.sum("length").alias("size_bytes"),
            F.max("modificationTime").alias("modified_time"),
            F.count("*").alias("files"),
        )
        .select(
            F.regexp_replace("_entry", r"\.(csv|json|parquet)$", "").alias("sheet_name"),
            F.regexp_extract("_entry", r"\.(csv|json|parquet)$", 1).alias("format"),
            F.concat("_root", "_entry").alias("path"),
            "size_bytes",
            "modified_time",
            "files",
        )
        .filter(F.col("format") != "")
        .orderBy("sheet_name", "format", "path")
    )


@dataclass
class Sheet:
    """A sheet with the name its table and its history go by."""

    name: str
    format: str
    path: str
    target: str

    @property
    def key(self) -> tuple[str, str, str]:
        return self.name, self.format, self.path.rpartition("/")[0]


class Names:
    """Which table and history every sheet has once been given: by its full name, format and folder, for good.

    Kept as a small table beside the history, a row per sheet.  Loads of one landing directory do not run at the same time.
    """

    SCHEMA = "sheet_name string, format string, folder string, target string"

    def __init__(self, spark: SparkSession, history: str):
        self.spark, self.path = spark, f"{history.rstrip('/')}-names"
        try:
            rows = spark.read.schema(self.SCHEMA).parquet(self.path).collect()
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            rows = []
        self.targets = {(r.sheet_name, r.format, r.folder): r.target for r in rows}

    def keep(self, sheet: Sheet) -> None:
        """Write down the name of a sheet that is new here."""
        if sheet.key not in self.targets:
            self.spark.createDataFrame([(*sheet.key, sheet.target)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.targets[sheet.key] = sheet.target


def named_sheets(spark: SparkSession, landing: str, names: Names | None = None) -> list[Sheet]:
    """Every sheet with its target: the one in ``names`` if it has been imported, else its file-safe name.

    Where that is the target of an imported sheet, or several new sheets have it, the new ones get a mark
    of their own from name, format and folder.  What an imported sheet is called never changes.
    """
    rows = list_sheets(spark, landing).withColumn("safe", sanitise_name(F.col("sheet_name"))).collect()
    known = names.targets if names else {}
    sheets = [(r["safe"], Sheet(r["sheet_name"], r["format"], r["path"], "")) for r in rows]
    taken = set(known.values())
    times = Counter(safe for safe, sheet in sheets if sheet.key not in known)
    for safe, sheet in sheets:
        alone = times[safe] == 1 and safe not in taken
        mark = hashlib.sha256(sheet.path.encode()).hexdigest()[:8]
        sheet.target = known.get(sheet.key) or (safe if alone else f"{safe}-{mark}")
    return [sheet for _, sheet in sheets]


def find_sheet(spark: SparkSession, landing: str, sheet_name: str, sheet_format: str | None = None, names: Names | None = None) -> Sheet:
    """The one sheet of this name; ``KeyError`` if there is none, ``ValueError`` if there are several."""
    found = [s for s in named_sheets(spark, landing, names) if s.name == sheet_name and sheet_format in (None, s.format)]
    if not found:
        raise KeyError(f"no sheet named {sheet_name!r} in {landing}")
    if len(found) > 1:
        raise ValueError(f"{len(found)} sheets are named {sheet_name!r}, name a format or a folder: {[s.path for s in found]}")
    return found[0]


def read_path(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return read_quality_csv(spark, path, na_tokens=(), numbered=False)
    if fmt == "json":
        return read_sheet_json(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}; allowed: {', '.join(FORMATS)}")


def read_sheet(
    spark: SparkSession, landing: str, sheet_name: str | None = None, sheet_index: int = 0, sheet_format: str | None = None
) -> DataFrame:
    """One sheet by name, or by position in name order.

    Raises ``KeyError`` for an unknown name, ``ValueError`` for a name that
    several sheets have, and ``IndexError`` for a position outside the list.
    """
    if sheet_name is not None:
        sheet = find_sheet(spark, landing, sheet_name, sheet_format)
        return read_path(spark, sheet.path, sheet.format)
    found = list_sheets(spark, landing).offset(sheet_index).limit(1).collect() if sheet_index >= 0 else []
    if not found:
        raise IndexError(f"there is no sheet number {sheet_index} in {landing}")
    return read_path(spark, found[0]["path"], found[0]["format"])


@dataclass
class IngestedSheet:
    name: str
    status: str
    path: str | None
    error: str | None


def ingest_all(
    spark: SparkSession, landing: str, save: Callable[[Sheet, DataFrame], str | None], names: Names | None = None
) -> DataFrame:
    """Hand every sheet to ``save`` and go on past the ones that fail.

    ``save`` gets the sheet and its rows, and returns where it put them.  The
    result is one status row per sheet, with the whole text of an error.
    """
    done: list[IngestedSheet] = []
    for sheet in named_sheets(spark, landing, names):
        try:
            target = save(sheet, read_path(spark, sheet.path, sheet.format))
            done.append(IngestedSheet(sheet.name, "ok", target, None))
        except Exception as problem:  # one broken sheet must not stop the others
            done.append(IngestedSheet(sheet.name, "failed", None, str(problem)))
    return spark.createDataFrame(
        [(s.name, s.status, s.path, s.error) for s in done],
        "sheet_name string, status string, path string, error string",
    )
