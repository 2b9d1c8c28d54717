"""Record numbers, sex codes and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: a record number, digits with optional spaces or dashes.
RECORD_NO_PATTERN = r"^[0-9\s-]+$"
# Fixed pattern: text that reads as a whole number.
WHOLE_NUMBER_PATTERN = r"^[+-]?[0-9]+([.]0*)?$"
# Characters cut from both ends of a value.
WHITESPACE = " \t\n\r\f\v"
# The accepted sex codes.
SEX_CODES = ("M", "F")


def parse_record_no(c: Column) -> Column:
    """Whole number from text such as ``12``, `` 12 ``, ``+12`` or ``12.0``."""
    text = F.trim(c, F.lit(WHITESPACE))
    return F.when(
        text.rlike(WHOLE_NUMBER_PATTERN),
        F.substring_index(text, ".", 1).try_cast("bigint"),
    )


def digits_only(c: Column) -> Column:
    """Keep the digits; null when none are left."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def normalise_sex(c: Column) -> Column:
    code = F.upper(F.trim(c, F.lit(WHITESPACE)))
    return F.when(code.isin(*SEX_CODES), code)


def share(part: Column, whole: Column) -> Column:
    """Ratio, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(ratio: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", ratio * 100)
