"""Patient IDs: two year digits followed by a serial number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: a well-formed ID.
ID_PATTERN = r"^[0-9]{3,5}$"
# What counts as a number when a serial is not plain digits.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def pad_id(c: Column, width: int = 4) -> Column:
    """Left-pad with zeros up to ``width``; longer IDs stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def year_prefix(c: Column) -> Column:
    return F.substring(c, 1, 2)


def year_from_id(c: Column) -> Column:
    """Two-digit year as a number; null when too short or not a number."""
    return F.when(F.length(c) >= 2, year_prefix(c).try_cast("int"))


def serial_from_id(c: Column) -> Column:
    """The part after the year as a number.

    Leading zeros go first, so a serial of only zeros has no number left and
    is null.  A decimal serial keeps its whole part.
    """
    text = F.trim(F.ltrim(F.substring(c, 3, 2_147_483_647), F.lit("0")))
    number = F.when(text.rlike(NUMBER_PATTERN), text)
    return F.coalesce(number.try_cast("bigint"), number.try_cast("double").try_cast("bigint"))


def sanitise_name(c: Column) -> Column:
    """File-safe sheet name."""
    return F.translate(c, " /", "__")
