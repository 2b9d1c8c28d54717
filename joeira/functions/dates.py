"""Dates written as day-month-year text.

Parsing re-orders the parts to year-month-day and casts: Spark's cast to DATE
is cheaper than a formatter-based parse, takes one- and two-digit parts and
gives null on an impossible day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Fixed pattern: day-month-year, one or two digits, one or two digits, four digits.
DATE_PATTERN = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"

_DAY_MONTH = r"^\s*[+]?0*([0-9]{1,2})\s*-\s*[+]?0*([0-9]{1,2})\s*-"
_SHORT_YEAR = _DAY_MONTH + r"([0-9]{2})$"
_ANY_YEAR = _DAY_MONTH + r"(?!.{2}$)\s*[+]?0*([1-9][0-9]{0,3})\s*$"


def has_date_format(c: Column) -> Column:
    """True only for present text of the expected shape."""
    return F.coalesce(c.rlike(DATE_PATTERN), F.lit(False))


def day_text(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def month_text(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "-", 2), "-", -1)


def year_text(c: Column) -> Column:
    return F.substring_index(c, "-", -1)


def day_of(c: Column) -> Column:
    return day_text(c).try_cast("int")


def month_of(c: Column) -> Column:
    return month_text(c).try_cast("int")


def year_of(c: Column) -> Column:
    return year_text(c).try_cast("int")


def parse_formatted(c: Column, well_formed: Column) -> Column:
    """Date of text already known to have the right shape; null on a day that does not exist."""
    iso = F.concat_ws("-", year_text(c), month_text(c), day_text(c))
    return F.when(well_formed & ~c.endswith("-0000"), iso.try_cast("date"))


def parse_date(c: Column) -> Column:
    """Strict parse: the right shape and a day that exists, else null."""
    return parse_formatted(c, c.rlike(DATE_PATTERN))


def parse_date_lenient(c: Column) -> Column:
    """Three dash-separated numbers; a two-character year means 20yy.

    Signs, spaces and leading zeros around the numbers do not matter.  A date
    cast takes years of four to seven digits, so zeros in front are harmless.
    Text of the strict shape, nearly all of it, never reaches those patterns.
    """
    iso = F.concat_ws("-", year_text(c), month_text(c), day_text(c))
    return (
        F.when(c.rlike(DATE_PATTERN) & ~c.endswith("-0000"), iso.try_cast("date"))
        .when(c.rlike(_SHORT_YEAR), F.regexp_replace(c, _SHORT_YEAR, "20$3-$2-$1").try_cast("date"))
        .when(c.rlike(_ANY_YEAR), F.regexp_replace(c, _ANY_YEAR, "000$3-$2-$1").try_cast("date"))
    )


def format_date(d: Column) -> Column:
    return F.date_format(d, "dd-MM-yyyy")


def year_suffix(d: Column) -> Column:
    """Last two digits of the year, as text."""
    return F.lpad((F.year(d) % 100).cast("string"), 2, "0")


def whole_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def age_from_text(admission: Column, birth: Column) -> Column:
    """Age in whole years from the text parts of two well-formed dates.

    The parts are compared as numbers, so the days need not exist.
    """
    before_birthday = (month_of(admission) * 100 + day_of(admission)) < (month_of(birth) * 100 + day_of(birth))
    return year_of(admission) - year_of(birth) - before_birthday.cast("int")


def age_decade(age: Column) -> Column:
    """First age of the ten-year bucket; the cast drops towards zero."""
    return (age / 10).cast("int") * 10


def decade_label(decade: Column) -> Column:
    return F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string"))


def as_of_date(as_of: dt.date | str | None) -> dt.date:
    """The date the checks call today: an argument, else the driver's date."""
    if as_of is None:
        return dt.date.today()
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
