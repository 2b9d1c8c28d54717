"""What the operators of this subpackage share: tables, written results, ASCII case."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where none is named and all runs in one process (tests) a temporary one is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that every executor can read and write")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="joeira-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder.

    ``save`` writes a result and reads it back, which cuts the lineage with
    files that outlive any executor.  ``drop`` deletes a table that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path is None or not path.startswith(self.base):
            return
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from all that are taken."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
