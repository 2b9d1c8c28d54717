"""Session helpers.

On a cluster the session comes from outside and is used as it is.  ``local``
is for tests, the benchmark and interactive use on one machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# The JIT leaves methods above this many bytes of code uncompiled.  A plan whose
# fused method would be longer runs faster as separate operators.
HUGE_METHOD = 8000


def tuned(spark: SparkSession) -> SparkSession:
    """Set what these jobs profit from on a running session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
    return spark


def local(cores: int | str = "*", memory: str = "16g", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("joeira")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Plans here are built from very many small expressions: recording where
        # in the Python code each was made takes longer than making it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def shared_dir(spark: SparkSession) -> str | None:
    """The folder every executor can read and write, or None if there is none.

    It is the one the cluster names in ``spark.checkpoint.dir``; a directory
    set by ``SparkContext.setCheckpointDir`` counts as well.  No machine-local
    folder is ever made up here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.sparkContext.getCheckpointDir()


def _shared_path(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    if base is None:
        raise ValueError("no shared folder: set spark.checkpoint.dir to one that every executor can read and write")
    return f"{base.rstrip('/')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and lets the later
    passes read only the columns they need.
    """
    path = _shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, name: str) -> None:
    """Delete what ``written`` wrote under this name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_shared_path(spark, name))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
