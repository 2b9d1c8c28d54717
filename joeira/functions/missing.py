"""What counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The texts that a pandas CSV load turns into a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def is_missing(c: str | Column) -> Column:
    """Null or empty text; never null itself."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == F.lit(""))


def is_present(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != F.lit(""))


def any_missing(*columns: str) -> Column:
    test = is_missing(columns[0])
    for c in columns[1:]:
        test = test | is_missing(c)
    return test


def na_to_null(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Turn every listed token in a text column into null (one projection)."""
    if not tokens:
        return df
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
