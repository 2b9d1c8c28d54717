"""From documents to a mixed, encoded training corpus, in five stages.

Each stage works on all that its predecessor kept, takes and returns the columns
of ``documents`` (the last one returns pieces and their place in the mixture), and is written as Parquet and read
again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from joeira.llm.common import Scratch, table
from joeira.llm.mixing import mix
from joeira.llm.pieces import encode
from joeira.llm.quality import score, train
from joeira.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_WEIGHTS, tokenizer_path
from joeira.llm.repeats import remove_repeats
from joeira.llm.simhash import keep_one

SHINGLE = 3  # words
RADIUS = 2  # bits


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """Columns ``names`` and a column ``row`` with all others, where they are out of the way of what an operator adds."""
    return docs.select(*names, F.struct(*[F.col(c) for c in docs.columns if c not in names]).alias("row"))


def _unwrapped(found: DataFrame, columns: list[str], *names: str, **changed: Column) -> DataFrame:
    """``columns`` again: ``names`` as they are, ``changed`` as given, the others out of ``row``."""
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in names else F.col("row")[c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier gives less than 0.5."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return _unwrapped(score(_wrapped(docs, "text"), model).where("_score >= 0.5"), docs.columns, "text")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest identifier of each group that fingerprints at most ``RADIUS`` bits apart link."""
    return keep_one(docs, RADIUS, SHINGLE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has; a document that had nothing else goes."""
    cut = remove_repeats(_wrapped(docs, "doc_id", "text"))
    left = cut.where("n_removed = 0 OR n_removed < n_bytes")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return _unwrapped(left, docs.columns, "doc_id", "text", n_chars=n_chars)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into the order of the mixture: the written files follow it, row by row."""
    mixed = mix(_wrapped(docs, "doc_id", "source"), MIX_WEIGHTS, MIX_DEFAULT, block_rows=MIX_BLOCK)
    return _unwrapped(mixed.orderBy("position"), docs.columns, "doc_id", "source")


def with_position(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: the place of a row in a written table, by the number of its file and its row there.

    Spark deals the files of a table out by size, so the order of rows read says nothing.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        rows.schema
    except AnalysisException:  # not read from Parquet files: its own order is that of its parts
        kept = Scratch(spark, "position").save(docs.withColumn("_part", F.spark_partition_id()))
        rows = kept.select(*docs.columns, F.col("_part").cast("string").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    # Spark numbers parts with five digits or more, and the files of a part that it cuts.
    name = F.regexp_extract("_file", "([^/]*)$", 1)
    numbers = [F.regexp_extract(name, p, 1).try_cast("bigint") for p in ("^(?:part-)?([0-9]+)", r"-c([0-9]+)\.")]
    # A row a file, however many rows the files have.
    before = F.sum("_n").over(Window.orderBy(*numbers, "_file").rowsBetween(Window.unboundedPreceding, -1))
    firsts = files.select("_file", F.coalesce(before, F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(firsts), "_file").select(*docs.columns, (F.col("_first") + F.col("_row")).alias("position"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode it to see that nothing was lost, and give its ``position`` in the mixture."""
    # Encoded rows keep one column beside the text.
    rows = with_position(spark, docs).select(F.struct("doc_id", "position").alias("row"), "text")
    # Executors hold what the earlier stages have left in their workers, so the encoder takes less memory than it might.
    encoded = encode(rows, tokenizer_path("piece_bpe_32k.model"), id_col="row", decoded=True, chunk=1 << 20, remember=8_000_000)
    return encoded.select("row.doc_id", *[c for c in encoded.columns if c not in ("row", "decoded")], "row.position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("simhash", simhash),
    ("repeats", repeats),
    ("mixing", mixing),
    ("pieces", pieces),
]

# The classifier and the encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
