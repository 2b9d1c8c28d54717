"""Columns that several checks need, worked out once per row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from joeira.functions.dates import age_from_text, has_date_format, parse_formatted, whole_days, year_of
from joeira.functions.ids import year_prefix

DATE_COLUMNS = ("data_ent", "data_alta", "data_nasc")
# Birth years before this one are too old to be true.
OLDEST_BIRTH_YEAR = 1900


def derive(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Add the helper columns (all named ``q_*``) the present columns allow."""
    have = set(df.columns)
    out = df
    if "ID" in have:
        out = out.withColumn("q_prefix", year_prefix(F.col("ID")))

    well_formed = {f"q_{c}_ok": has_date_format(F.col(c)) for c in DATE_COLUMNS if c in have}
    out = out.withColumns(well_formed) if well_formed else out

    dates = {f"q_{c}": parse_formatted(F.col(c), F.col(f"q_{c}_ok")) for c in ("data_ent", "data_alta") if c in have}
    if "data_nasc" in have:
        dates["q_birth_year"] = F.when(F.col("q_data_nasc_ok"), year_of(F.col("data_nasc")))
    out = out.withColumns(dates) if dates else out

    derived = {}
    if {"data_ent", "data_alta"} <= have:
        derived["q_days"] = whole_days(F.col("q_data_alta"), F.col("q_data_ent"))
    if {"data_ent", "data_nasc"} <= have:
        believable = F.col("q_birth_year").between(OLDEST_BIRTH_YEAR, as_of.year)
        derived["q_age"] = F.when(
            F.col("q_data_ent_ok") & believable,
            age_from_text(F.col("data_ent"), F.col("data_nasc")),
        )
    return out.withColumns(derived) if derived else out
