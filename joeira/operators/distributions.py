"""Value frequencies, histograms and the statistics read off them.

Ages and stays are small whole numbers: counting each value first leaves a
short table from which mean, exact median and extremes follow.  All columns of
a run are counted together in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from joeira.functions.dates import age_decade, decade_label
from joeira.functions.missing import is_present
from joeira.functions.values import share


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every present value, most frequent first."""
    counts = df.filter(is_present(column)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("value", "count", F.round(F.col("count") / total, 6).alias("share")).orderBy(
        F.col("count").desc(), "value"
    )


def count_values(df: DataFrame, texts: Mapping[str, Column], numbers: Mapping[str, Column]) -> DataFrame:
    """Counts of several columns in long form: kind, value or number, n."""
    entries = [
        F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value"), F.lit(None).cast("bigint").alias("number"))
        for k, c in texts.items()
    ] + [
        F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("value"), c.cast("bigint").alias("number"))
        for k, c in numbers.items()
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("kind", "value", "number")
        .agg(F.count("*").alias("n"))
        .filter(is_present("value") | F.col("number").isNotNull())
    )


def frequencies(counted: DataFrame, kinds: list[str]) -> DataFrame:
    """Frequencies of several text columns from ``count_values``."""
    # The test is on the counts, so it stays above the grouping, whose shuffle then serves the statistics as well.
    mine = counted.filter(F.when(F.col("kind").isin(*kinds) & F.col("value").isNotNull(), F.col("n")).otherwise(0) > 0)
    totals = mine.groupBy("kind").agg(F.sum("n").alias("total"))
    # One total per column name, so the small side has at most len(kinds) rows.
    return mine.join(F.broadcast(totals), "kind").select(
        F.col("kind").alias("column"), "value", F.col("n").alias("count"),
        (F.col("n") / F.col("total")).alias("share"),
    )


def summarise(counted: DataFrame) -> DataFrame:
    """Per kind: number of different texts, and the statistics of its numbers.

    Both come from one grouping, since filtering the counts twice would read
    the rows behind them twice.
    """
    n = F.when(F.col("number").isNotNull(), F.col("n"))
    texts = F.count("value") if "value" in counted.columns else F.lit(0)
    return (
        counted.groupBy("kind")
        .agg(
            texts.alias("unique_count"),
            F.sum(n).alias("count"),
            (F.sum(F.col("number") * n) / F.sum(n)).alias("mean"),
            F.percentile("number", F.lit(0.5), F.col("n")).alias("median"),
            F.min("number").alias("min"),
            F.max("number").alias("max"),
        )
        .withColumn("mean", F.round("mean", 6))
    )


def number_stats(counted: DataFrame) -> DataFrame:
    """Count, mean, exact median and extremes of every kind that has numbers."""
    return summarise(counted).filter("count > 0").drop("unique_count")


def number_counts(df: DataFrame, kind: str, number: Column) -> DataFrame:
    """``count_values`` for a single number column.

    The null group counts zero and is dropped afterwards: a filter before the
    grouping would be pushed to the scan with all the parsing inside it.
    """
    return (
        df.select(number.cast("bigint").alias("number"))
        .groupBy("number")
        .agg(F.count("number").alias("n"))
        .filter("n > 0")
        .withColumn("kind", F.lit(kind))
    )


def age_histogram(counted: DataFrame) -> DataFrame:
    """Patients per ten-year age bucket, youngest first."""
    return (
        counted.groupBy(age_decade(F.col("number")).alias("decade"))
        .agg(F.sum("n").alias("count"))
        .select("decade", decade_label(F.col("decade")).alias("label"), "count")
        .orderBy("decade")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and present counts per column, of any type, in one pass."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    counters = [F.count_if(is_present(c) if c in text else F.col(c).isNotNull()).alias(c) for c in columns]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns])
    missing = F.col("_rows") - F.col("present")
    return (
        df.agg(F.count("*").alias("_rows"), *counters)
        .select("_rows", F.inline(rows))
        .select(
            "column",
            F.col("_rows").alias("total_rows"),
            missing.alias("missing_count"),
            F.round(share(missing, F.col("_rows")), 6).alias("missing_share"),
        )
    )
