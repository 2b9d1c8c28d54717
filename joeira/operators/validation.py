"""Rows to typed patient records, with a reason for every rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joeira.functions.dates import parse_date_lenient
from joeira.functions.missing import is_present
from joeira.functions.values import digits_only, normalise_sex, parse_record_no
from joeira.operators.filters import YearRange, in_year_range
from joeira.sources.text import CORRUPT

DATES = ("data_ent", "data_alta", "data_nasc")
NO_ID, NO_NAME, BAD_RECORD_NO = "id_missing", "nome_missing", "processo_invalid"


def _raw(df: DataFrame, name: str) -> Column:
    """The column as text; an absent one is null."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _blank_if_empty(df: DataFrame, name: str) -> Column:
    """Undo the CSV reader's null for an empty cell.

    On a line of full length a null cell was empty text; on a line marked as
    too short it was not there at all and stays null.
    """
    c = _raw(df, name)
    if CORRUPT not in df.columns or name not in df.columns:
        return c
    return F.when(c.isNull() & F.col(CORRUPT).isNull(), F.lit("")).otherwise(c)


def _named(tests: list[tuple[Column, str]]) -> Column:
    """Names of the tests that hold, in order."""
    names = [F.when(test, F.lit(name)).otherwise(F.lit("")) for test, name in tests]
    return F.array_remove(F.array(*names), "")


def validate(
    df: DataFrame,
    years: YearRange | None = None,
    blank_as_null: bool = False,
    clean_digits: bool = False,
) -> DataFrame:
    """Typed fields, ``reasons`` (empty when accepted), ``warnings`` and ``in_filter``.

    ``blank_as_null`` accepts an empty record number; ``clean_digits`` keeps
    the digits of one that is not a number instead of rejecting the row.
    """
    patient_id = _raw(df, "ID")
    if "_id" in df.columns:
        patient_id = F.coalesce(F.col("_id").cast("string"), patient_id)
    name = _blank_if_empty(df, "nome") if "nome" in df.columns else F.lit("")
    record_no = _blank_if_empty(df, "processo")

    number = parse_record_no(record_no)
    if clean_digits:
        number = F.coalesce(number, digits_only(record_no).try_cast("bigint"))
    acceptable = record_no.isNull() | number.isNotNull()
    if blank_as_null:
        acceptable = acceptable | (record_no == "")
    if clean_digits:
        acceptable = acceptable | (record_no.isNotNull() & digits_only(record_no).isNull())

    typed = df.select(
        "row_idx",
        patient_id.alias("ID"),
        number.alias("processo"),
        name.alias("nome"),
        *[parse_date_lenient(_raw(df, c)).alias(c) for c in DATES],
        _blank_if_empty(df, "destino").alias("destino"),
        normalise_sex(_raw(df, "sexo")).alias("sexo"),
        _blank_if_empty(df, "origem").alias("origem"),
        (~acceptable).alias("_bad_number"),
        *[is_present(_raw(df, c)).alias(f"_{c}") for c in (*DATES, "sexo")],
    )
    reasons = [
        (~is_present("ID"), NO_ID),
        (F.col("nome").isNull(), NO_NAME),
        (F.col("_bad_number"), BAD_RECORD_NO),
    ]
    warnings = [(F.col(f"_{c}") & F.col(c).isNull(), f"{c}_unreadable") for c in (*DATES, "sexo")]
    return typed.select(
        "row_idx", "ID", "processo", "nome", "data_ent", "data_alta", "destino", "sexo", "data_nasc", "origem",
        _named(reasons).alias("reasons"),
        _named(warnings).alias("warnings"),
        in_year_range(F.col("ID"), years).alias("in_filter"),
    )


def _has_key() -> Column:
    """Rows the scan keeps: ID and name are there and the year is wanted."""
    return (
        F.col("in_filter")
        & ~F.array_contains("reasons", NO_ID)
        & ~F.array_contains("reasons", NO_NAME)
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter((F.size("reasons") == 0) & F.col("in_filter")).drop("reasons", "in_filter")


def rejected(validated: DataFrame) -> DataFrame:
    """Rows that the filter keeps and that are in error: as many as ``errors`` counts."""
    return validated.filter(_has_key() & (F.size("reasons") > 0)).drop("in_filter")


def skipped(validated: DataFrame) -> DataFrame:
    """Rows that are left out before they are looked at, for want of a key or by the filter: as many as ``skipped`` counts."""
    return validated.filter(~_has_key())


def validation_counts(validated: DataFrame) -> DataFrame:
    """How many rows were read, skipped, kept by the filter, processed and in error."""
    ok = F.size("reasons") == 0
    return validated.agg(
        F.count("*").alias("total"),
        F.count_if(_has_key()).alias("filtered"),
        F.count_if(_has_key() & ok).alias("processed"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"),
    ).select(
        "total",
        (F.col("total") - F.col("filtered")).alias("skipped"),
        "filtered",
        "processed",
        (F.col("filtered") - F.col("processed")).alias("errors"),
        "with_warnings",
    )


def written_count(patients: DataFrame) -> DataFrame:
    """Documents after repeated IDs have replaced each other."""
    return patients.select("ID").distinct().agg(F.count("*").alias("written"))
