"""Year filter on the ID prefix."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from joeira.functions.ids import year_from_id, year_prefix
from joeira.functions.values import share


@dataclass(frozen=True)
class YearRange:
    """Inclusive range of two-digit years, newest first."""

    newest: int
    oldest: int

    @property
    def bounds(self) -> tuple[int, int]:
        return self.newest, self.oldest

    @property
    def is_single(self) -> bool:
        return self.newest == self.oldest


def parse_year_filter(text: str | None, strict: bool = False) -> YearRange | None:
    """``YY`` or ``YY-YY``; reversed bounds are swapped.

    Strict: exactly two digits each, anything else is a ``ValueError``.
    Lenient: any digit count, anything else means no filter.
    """
    if not text:
        return None
    digits = "[0-9]{2}" if strict else "[0-9]+"
    match = re.fullmatch(f"({digits})(?:-({digits}))?", text)
    if match is None:
        if strict:
            raise ValueError(f"invalid year filter {text!r}; expected 'YY' or 'YY-YY'")
        return None
    first = int(match[1])
    second = first if match[2] is None else int(match[2])
    return YearRange(max(first, second), min(first, second))


def in_year_range(id_column: Column, years: YearRange | None) -> Column:
    """True for IDs of the range; a missing or odd prefix is outside it."""
    if years is None:
        return F.lit(True)
    return F.coalesce(year_from_id(id_column).between(years.oldest, years.newest), F.lit(False))


def in_year_filter(id_column: Column, text: str) -> Column:
    """Predicate of the quality run: one year by prefix, a range by number."""
    years = parse_year_filter(text, strict=True)
    if "-" not in text:
        test = id_column.startswith(text)
    else:
        test = id_column.rlike("^[0-9]{2}") & year_prefix(id_column).try_cast("int").between(
            years.oldest, years.newest
        )
    return F.coalesce(test, F.lit(False))


def filter_by_year(df: DataFrame, text: str | None) -> DataFrame:
    """Rows of the wanted years; unchanged without a filter or an ID column."""
    if not text or "ID" not in df.columns:
        return df
    return df.filter(in_year_filter(F.col("ID"), text))


def filter_label(text: str | None) -> tuple[str, str | None]:
    """Kind of a filter (none, single or range) and what a report calls it."""
    if not text:
        return "none", None
    years = parse_year_filter(text, strict=True)
    if "-" in text:
        return "range", f"20{years.newest:02d} to 20{years.oldest:02d}"
    return "single", f"20{years.newest:02d}"


def filter_summary(df: DataFrame, text: str | None) -> DataFrame:
    """What the filter keeps: one row, one pass, no filter needed first."""
    text = text if "ID" in df.columns else None
    kind, label = filter_label(text)
    test = in_year_filter(F.col("ID"), text) if text else F.lit(True)
    return df.agg(
        F.count("*").alias("total_records"), F.count_if(test).alias("filtered_records")
    ).select(
        F.lit(kind != "none").alias("is_filtered"),
        F.lit(kind).alias("filter_type"),
        F.lit(label).cast("string").alias("filter_value"),
        "total_records",
        "filtered_records",
        F.round(share(F.col("filtered_records"), F.col("total_records")), 6).alias("kept_share"),
    )
