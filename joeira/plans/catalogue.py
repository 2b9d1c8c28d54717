"""Every operator as a named query over the driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from joeira.functions.dates import format_date, parse_date, parse_date_lenient, year_suffix
from joeira.functions.ids import pad_id, sanitise_name, serial_from_id, year_from_id
from joeira.functions.missing import NA_TOKENS, na_to_null
from joeira.functions.values import digits_only, normalise_sex, parse_record_no
from joeira.operators.checks import Check, count_checks, first_examples, list_issues
from joeira.operators.distributions import (
    age_histogram, distinct_values, frequency, number_counts, number_stats, presence,
)
from joeira.operators.duplicates import duplicate_keys, duplicate_rows, duplicate_summary, first_duplicates
from joeira.operators.filters import filter_by_year, filter_summary, in_year_range, parse_year_filter
from joeira.operators.profile import shape, table_profile
from joeira.operators.sequences import gap_ranges, missing_numbers, missing_preview, sequences, unusual_years
from joeira.operators.tracking import change_status, fingerprint, latest_revision
from joeira.operators.validation import validate
from joeira.plans.encounters import COLUMNS, encounters
from joeira.plans.patients import PatientJob, first_record
from joeira.plans.quality import QualityResult
from joeira.sinks.documents import latest_per_id, to_json_text
from joeira.sources.catalog import get_table, list_tables, table_exists, table_stats
from joeira.sources.landing import list_sheets
from joeira.sources.rownum import with_parquet_row_idx
from joeira.sources.text import CORRUPT, from_csv_lines, to_csv_line

AS_OF = dt.date(2000, 6, 30)
ID_AS_OF = dt.date(2025, 6, 30)
NOW_EPOCH = 1_750_000_000
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str, *columns: str, as_of: dt.date = AS_OF) -> QualityResult:
    """A quality run over the wanted columns only."""
    if columns:
        return QualityResult(encounters(spark, sf_dir, ("row_idx", *columns)), as_of)
    return QualityResult(encounters(spark, sf_dir), as_of)


def patients(spark: SparkSession, sf_dir: str, year_filter: str | None = None) -> PatientJob:
    return PatientJob(validate(encounters(spark, sf_dir), parse_year_filter(year_filter)))


def _only(checks: list[Check], *names: str) -> list[Check]:
    return [c for c in checks if c.name in names]


def counted(*names: str, columns: tuple[str, ...]) -> Query:
    """Scope and failures of the named checks."""

    def run(spark, sf_dir):
        q = quality(spark, sf_dir, *columns)
        return count_checks(q.rows, _only(q.checks, *names))

    return run


def exemplified(*names: str, columns: tuple[str, ...]) -> Query:
    """First examples of the named checks."""

    def run(spark, sf_dir):
        q = quality(spark, sf_dir, *columns)
        wanted = _only(q.checks, *names)
        return first_examples(list_issues(q.rows, wanted), wanted)

    return run


def listed(*names: str, columns: tuple[str, ...]) -> Query:
    """Every failing row of the named checks."""

    def run(spark, sf_dir):
        q = quality(spark, sf_dir, *columns)
        return list_issues(q.rows, _only(q.checks, *names))

    return run


# Filters.


def year_filter_single(spark, sf_dir):
    return filter_by_year(encounters(spark, sf_dir), "99")


def year_filter_range(spark, sf_dir):
    return filter_by_year(encounters(spark, sf_dir), "97-99")


def year_filter_patients(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "ID"))
    years = parse_year_filter("1-0", strict=False)
    return df.filter(in_year_range(F.col("ID"), years)).withColumn("year", year_from_id(F.col("ID")))


def year_filter_summary(spark, sf_dir):
    return filter_summary(encounters(spark, sf_dir, ("row_idx", "ID")), "99-97")


def patients_over_50(spark, sf_dir):
    q = quality(spark, sf_dir, "ID", "data_ent", "data_nasc")
    return q.rows.filter(F.col("q_age") > 50).select("row_idx", "ID", F.col("q_age").alias("age"))


# Ids.


def id_pattern_examples(spark, sf_dir):
    """First badly formed IDs, each with the first row that holds it."""
    q = quality(spark, sf_dir, "ID")
    wanted = _only(q.checks, "id_pattern")
    found = first_examples(list_issues(q.rows, wanted), wanted)
    return found.select("rank", "id", F.col("row_idx").alias("first_row"))


def id_year_prefixes(spark, sf_dir):
    return quality(spark, sf_dir, "ID").year_prefixes


def id_year_outliers(spark, sf_dir):
    return unusual_years(encounters(spark, sf_dir, ("row_idx", "ID")), ID_AS_OF)


def q_duplicate_ids(spark, sf_dir):
    return duplicate_keys(encounters(spark, sf_dir, ("row_idx", "ID")))


def q_duplicate_id_rows(spark, sf_dir):
    return duplicate_rows(encounters(spark, sf_dir, ("row_idx", "ID")))


def q_duplicate_summary(spark, sf_dir):
    return duplicate_summary(encounters(spark, sf_dir, ("row_idx", "ID")))


def q_first_duplicates(spark, sf_dir):
    found = first_duplicates(encounters(spark, sf_dir, ("row_idx", "ID")))
    return found.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ", "))


def duplicate_conversations(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("row_idx", F.col("turn"))
    return duplicate_keys(df, "conv_id")


def id_sequences(spark, sf_dir):
    return quality(spark, sf_dir, "ID").sequences


def missing_serials(spark, sf_dir):
    return quality(spark, sf_dir, "ID").missing_serials


def serial_gaps(spark, sf_dir):
    return quality(spark, sf_dir, "ID").gaps


def missing_serials_preview(spark, sf_dir):
    return missing_preview(quality(spark, sf_dir, "ID").gaps)


def turn_sequences(spark, sf_dir):
    return sequences(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def line_sequences(spark, sf_dir):
    return sequences(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def line_gaps(spark, sf_dir):
    return gap_ranges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def missing_lines(spark, sf_dir):
    return missing_numbers(line_gaps(spark, sf_dir), "l_orderkey")


# Dates, stays, ages.


def parsed_dates(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "data_ent", "data_alta"))
    ent = parse_date(F.col("data_ent"))
    return df.select(
        "row_idx", ent.alias("admission"), parse_date(F.col("data_alta")).alias("discharge"),
        format_date(ent).alias("admission_text"), year_suffix(ent).alias("year_suffix"),
    )


def stay_days(spark, sf_dir):
    return quality(spark, sf_dir, "data_ent", "data_alta").rows.select("row_idx", F.col("q_days").alias("days"))


def stay_stats(spark, sf_dir):
    q = quality(spark, sf_dir, "data_ent", "data_alta")
    return number_stats(number_counts(q.rows, "stay", F.col("q_days")))


def ship_lag_stats(spark, sf_dir):
    """Days from order to shipment: the stay statistics on the order tables."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    lags = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.datediff("l_shipdate", "o_orderdate").alias("days")
    )
    return number_stats(number_counts(lags, "ship_lag", F.col("days")))


def age_at_admission(spark, sf_dir):
    return quality(spark, sf_dir, "data_ent", "data_nasc").rows.select("row_idx", F.col("q_age").alias("age"))


def age_counts(spark, sf_dir):
    return number_counts(quality(spark, sf_dir, "data_ent", "data_nasc").rows, "age", F.col("q_age"))


def age_stats(spark, sf_dir):
    return number_stats(age_counts(spark, sf_dir))


def q_age_histogram(spark, sf_dir):
    return age_histogram(age_counts(spark, sf_dir))


# Values.


def missing_values(spark, sf_dir):
    q = quality(spark, sf_dir)
    return count_checks(q.rows, [c for c in q.checks if c.name.endswith("_missing")])


def present(name: str) -> Query:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return presence(df, df.columns)

    return run


def frequency_of(column: str) -> Query:
    return lambda spark, sf_dir: frequency(encounters(spark, sf_dir, ("row_idx", column)), column)


def frequency_in(name: str, column: str) -> Query:
    return lambda spark, sf_dir: frequency(table(spark, sf_dir, name), column)


def all_frequencies(spark, sf_dir):
    return quality(spark, sf_dir, "sexo", "destino", "origem").value_frequencies


def distinct_ids(spark, sf_dir):
    return distinct_values(encounters(spark, sf_dir, ("row_idx", "ID")), "ID")


# Whole run.


def all_issues(spark, sf_dir):
    return quality(spark, sf_dir).issues


def check_examples(spark, sf_dir):
    return quality(spark, sf_dir).examples


def findings(spark, sf_dir):
    found = quality(spark, sf_dir).findings
    return found.withColumn("value", F.round("value", 6))


def report_lines(spark, sf_dir):
    return quality(spark, sf_dir).report("orders", dt.datetime(2000, 6, 30))


def report_filtered(spark, sf_dir):
    """The report on some years, with the profile of a file in its file section (less its path and size)."""
    profile = table_profile(table(spark, sf_dir, "orders"), "orders").withColumns(
        {"file_path": F.lit("orders"), "file_size_kb": F.lit(0.0)}
    )
    q = QualityResult(encounters(spark, sf_dir), AS_OF, "97-99", profile)
    return q.report("orders", dt.datetime(2000, 6, 30))


# Projections.


def pad_ids(spark, sf_dir):
    """Record numbers of any length, padded like short IDs."""
    df = encounters(spark, sf_dir, ("row_idx", "processo"))
    return df.select("row_idx", pad_id(F.col("processo")).alias("padded"))


def id_parts(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "ID"))
    return df.select("row_idx", year_from_id(F.col("ID")).alias("year"), serial_from_id(F.col("ID")).alias("serial"))


def parse_dates_lenient(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "data_ent", "data_alta", "data_nasc"))
    return df.select(
        "row_idx", *[parse_date_lenient(F.col(c)).alias(c) for c in ("data_ent", "data_alta", "data_nasc")]
    )


def q_normalise_sex(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "sexo"))
    return df.select("row_idx", normalise_sex(F.col("sexo")).alias("sexo"))


def q_parse_record_no(spark, sf_dir):
    df = encounters(spark, sf_dir, ("row_idx", "processo"))
    return df.select(
        "row_idx", parse_record_no(F.col("processo")).alias("number"), digits_only(F.col("processo")).alias("digits")
    )


def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sanitise_name(F.col("p_name")).alias("safe_name"))


def na_values(spark, sf_dir):
    """Text columns with NA tokens taken out; the sex code F counts as one here."""
    df = encounters(spark, sf_dir, ("row_idx", "data_ent", "sexo", "nome"))
    return na_to_null(df, (*NA_TOKENS, "F"))


def row_numbers(spark, sf_dir):
    """File-order positions."""
    return with_parquet_row_idx(table(spark, sf_dir, "events")).select("row_idx", "event_id")


# Lines of text.

CELLS = list(COLUMNS[1:])


def csv_lines(spark, sf_dir):
    """The admissions as lines of a CSV; some are cut short, some have a cell too many."""
    k = F.col("row_idx")
    whole, short, least = (to_csv_line(c) for c in (CELLS, CELLS[:7], CELLS[:2]))
    line = F.when(k % 43 == 0, least).when(k % 13 == 0, short).when(k % 17 == 0, F.concat(whole, F.lit(",more"))).otherwise(whole)
    return encounters(spark, sf_dir).select("row_idx", line.alias("line"))


def csv_cells(spark, sf_dir):
    """The lines parsed: blank cells are null, lines of a wrong length are marked."""
    parsed = from_csv_lines(csv_lines(spark, sf_dir), "line", CELLS)
    return parsed.withColumn("wrong_length", F.col(CORRUPT).isNotNull()).drop(CORRUPT)


def csv_validated(spark, sf_dir):
    """The lines validated: a blank cell is an empty text, a cell that is not there is missing."""
    job = PatientJob(validate(from_csv_lines(csv_lines(spark, sf_dir), "line", CELLS)))
    return _flat(job.validated).select("row_idx", "ID", "nome", "processo", "destino", "reasons")


def json_lines(spark, sf_dir):
    """The admissions as JSON records, as the JSON sink writes them, and read back."""
    record = F.to_json(F.struct(*CELLS), {"ignoreNullFields": "false"})
    schema = ", ".join(f"{c} string" for c in CELLS)
    rows = encounters(spark, sf_dir).select("row_idx", record.alias("json"))
    return rows.select("row_idx", F.length("json").alias("json_chars"), F.from_json("json", schema).alias("r")).select("row_idx", "json_chars", "r.*")


# Validation.


def _flat(df: DataFrame) -> DataFrame:
    lists = [c for c in ("reasons", "warnings") if c in df.columns]
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


def validated_patients(spark, sf_dir):
    return _flat(patients(spark, sf_dir).patients)


def rejected_patients(spark, sf_dir):
    return _flat(patients(spark, sf_dir).rejected).select("row_idx", "ID", "nome", "reasons")


def rejected_patients_filtered(spark, sf_dir):
    """Rows of the wanted years that are in error."""
    return _flat(patients(spark, sf_dir, "97-99").rejected).select("row_idx", "ID", "nome", "reasons")


def skipped_patients_filtered(spark, sf_dir):
    """Rows of other years, and rows without an ID or name."""
    return _flat(patients(spark, sf_dir, "97-99").skipped).select("row_idx", "ID", "nome", "in_filter", "reasons")


def q_validation_counts(spark, sf_dir):
    return patients(spark, sf_dir, "99-97").counts


def written_documents(spark, sf_dir):
    return patients(spark, sf_dir).written


def q_latest_per_id(spark, sf_dir):
    return latest_per_id(patients(spark, sf_dir).patients).drop("warnings")


def patient_json(spark, sf_dir):
    return patients(spark, sf_dir).patients.select("row_idx", to_json_text().alias("json"))


def preview_record(spark, sf_dir):
    return first_record(patients(spark, sf_dir, "99").validated, pretty=True).select("row_idx", "ID", "json")


# Tables, tracking.


def q_table_profile(spark, sf_dir):
    """Files, rows and columns; where the files lie and how large they are depends on the place."""
    profiles = [table_profile(table(spark, sf_dir, t), t) for t in TABLES]
    return reduce(DataFrame.unionByName, profiles).drop("file_path", "file_size_kb")


def table_shapes(spark, sf_dir):
    return reduce(DataFrame.unionByName, [shape(table(spark, sf_dir, t), t) for t in TABLES])


def _with_views(spark, sf_dir, names, use) -> DataFrame:
    """``use`` on every table while it is in the catalog."""
    parts = []
    for name in names:
        view = f"joeira_{name}"
        table(spark, sf_dir, name).createOrReplaceTempView(view)
        try:
            parts.append(use(name, view))
        finally:
            spark.catalog.dropTempView(view)
    return reduce(DataFrame.unionByName, parts)


def q_table_stats(spark, sf_dir):
    """Statistics of tables looked up in the catalog."""
    return _with_views(spark, sf_dir, TABLES, lambda name, view: table_stats(spark, view))


def catalog_lookup(spark, sf_dir):
    """Which of the tables the catalog lists and knows, with the columns it reports."""

    def found(name, view):
        facts = {"known": F.lit(table_exists(spark, view)), "listed": F.lit(view in list_tables(spark))}
        return shape(get_table(spark, view), name).withColumns(facts)

    return _with_views(spark, sf_dir, TABLES, found)


def sheet_list(spark, sf_dir):
    return list_sheets(spark, sf_dir).select("sheet_name", "format", "files")


def _numbered(spark, sf_dir, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).withColumnRenamed(key, "row_idx")


def fingerprint_of(name: str, key: str, ordered: bool) -> Query:
    return lambda spark, sf_dir: fingerprint(_numbered(spark, sf_dir, name, key), ordered=ordered)


def fingerprint_conversations(spark, sf_dir):
    """All columns, in whatever order the rows stand."""
    return fingerprint(table(spark, sf_dir, "conversations"), ordered=False)


def fingerprint_encounters(spark, sf_dir):
    return fingerprint(encounters(spark, sf_dir))


def _loads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three sources as first loaded, and as they look now."""
    docs = _numbered(spark, sf_dir, "documents", "doc_id")
    pages = _numbered(spark, sf_dir, "pages", "page_id")
    items = _numbered(spark, sf_dir, "benchmark", "item_id")
    shorter = docs.filter(F.col("lang") != "de")
    edited = pages.withColumn("url", F.when(F.col("row_idx") == 0, F.lit("moved")).otherwise(F.col("url")))

    def entry(df, source, revision):
        return fingerprint(df).select(
            F.lit(source).alias("source_id"), "row_count", "data_hash", F.lit(revision).alias("revision_id")
        )

    before = [entry(docs, "documents", "7"), entry(pages, "pages", "first"), entry(items, "benchmark", "12")]
    now = [entry(shorter, "documents", None), entry(edited, "pages", None), entry(items, "benchmark", None),
           entry(_numbered(spark, sf_dir, "labels", "doc_id"), "labels", None)]
    return reduce(DataFrame.unionByName, before), reduce(DataFrame.unionByName, now).drop("revision_id")


def q_change_status(spark, sf_dir):
    before, now = _loads(spark, sf_dir)
    return change_status(now, before, F.lit(NOW_EPOCH))


def revision_info(spark, sf_dir):
    """Newest entry per source of a history with two loads of each."""
    before, now = _loads(spark, sf_dir)
    first = before.withColumn("download_time", F.timestamp_seconds(F.lit(NOW_EPOCH - 60)))
    second = change_status(now, before, F.lit(NOW_EPOCH)).select(
        "source_id", "row_count", "data_hash", "revision_id",
        F.timestamp_seconds(F.lit(NOW_EPOCH)).alias("download_time"),
    )
    newest = latest_revision(first.unionByName(second))
    return newest.select("source_id", "row_count", "data_hash", "revision_id")


_STAYS = ("ID", "data_ent", "data_alta")
_BIRTHS = ("ID", "data_ent", "data_nasc")
_DATES = ("data_ent", "data_alta", "data_nasc")
_AGES = ("age_very_young", "age_very_old", "age_negative")

QUERIES: dict[str, Query] = {
    "encounters": encounters,
    "year_filter_single": year_filter_single,
    "year_filter_range": year_filter_range,
    "year_filter_patients": year_filter_patients,
    "year_filter_summary": year_filter_summary,
    "patients_over_50": patients_over_50,
    "missing_values": missing_values,
    "missing_values_customer": present("customer"),
    "missing_values_documents": present("documents"),
    "missing_rows": listed("id_missing", "admission_missing", "birth_missing", columns=("ID", "data_ent", "data_nasc")),
    "id_pattern": counted("id_pattern", columns=("ID",)),
    "id_pattern_examples": id_pattern_examples,
    "id_year_prefixes": id_year_prefixes,
    "id_year_outliers": id_year_outliers,
    "duplicate_ids": q_duplicate_ids,
    "duplicate_id_rows": q_duplicate_id_rows,
    "duplicate_summary": q_duplicate_summary,
    "first_duplicates": q_first_duplicates,
    "duplicate_conversations": duplicate_conversations,
    "distinct_ids": distinct_ids,
    "id_sequences": id_sequences,
    "serial_gaps": serial_gaps,
    "missing_serials": missing_serials,
    "missing_serials_preview": missing_serials_preview,
    "turn_sequences": turn_sequences,
    "line_sequences": line_sequences,
    "line_gaps": line_gaps,
    "missing_lines": missing_lines,
    "date_format_check": counted("admission_format", "discharge_format", "birth_format", columns=_DATES),
    "date_format_examples": exemplified("admission_format", "discharge_format", "birth_format", columns=("ID", *_DATES)),
    "date_pairs": counted("admission_unparseable", "stay_unparseable", columns=_STAYS),
    "impossible_dates": listed("admission_unparseable", "stay_unparseable", columns=_STAYS),
    "parsed_dates": parsed_dates,
    "year_consistency": counted("year_mismatch", columns=("ID", "data_ent")),
    "year_mismatch_rows": listed("year_mismatch", columns=("ID", "data_ent")),
    "year_mismatch_examples": exemplified("year_mismatch", columns=("ID", "data_ent")),
    "chronology": counted("discharge_before_admission", columns=_STAYS),
    "chronology_examples": exemplified("discharge_before_admission", columns=_STAYS),
    "stay_days": stay_days,
    "stay_stats": stay_stats,
    "ship_lag_stats": ship_lag_stats,
    "long_stay_count": counted("long_stay", columns=_STAYS),
    "long_stays": exemplified("long_stay", columns=_STAYS),
    "birth_validity": counted("birth_too_old", "birth_in_future", columns=("data_nasc",)),
    "birth_validity_examples": exemplified("birth_too_old", "birth_in_future", columns=("ID", "data_nasc")),
    "age_at_admission": age_at_admission,
    "age_stats": age_stats,
    "age_histogram": q_age_histogram,
    "unusual_ages": counted(*_AGES, columns=_BIRTHS),
    "unusual_age_examples": exemplified(*_AGES, columns=_BIRTHS),
    "processo_invalid": counted("processo_invalid", columns=("processo",)),
    "processo_invalid_examples": exemplified("processo_missing", "processo_invalid", columns=("ID", "processo")),
    "value_frequency_sexo": frequency_of("sexo"),
    "value_frequency_destino": frequency_of("destino"),
    "value_frequency_origem": frequency_of("origem"),
    "value_frequencies": all_frequencies,
    "event_type_frequency": frequency_in("events", "event_type"),
    "lang_frequency": frequency_in("documents", "lang"),
    "unexpected_values": counted("sexo_unexpected", columns=("sexo",)),
    "unexpected_value_rows": listed("sexo_unexpected", columns=("ID", "sexo")),
    "check_examples": check_examples,
    "issues": all_issues,
    "findings": findings,
    "report_lines": report_lines,
    "report_filtered": report_filtered,
    "pad_ids": pad_ids,
    "id_parts": id_parts,
    "parse_dates_lenient": parse_dates_lenient,
    "normalise_sex": q_normalise_sex,
    "parse_record_no": q_parse_record_no,
    "safe_names": safe_names,
    "na_values": na_values,
    "row_numbers": row_numbers,
    "csv_lines": csv_lines,
    "csv_cells": csv_cells,
    "csv_validated": csv_validated,
    "json_lines": json_lines,
    "validated_patients": validated_patients,
    "rejected_patients": rejected_patients,
    "rejected_patients_filtered": rejected_patients_filtered,
    "skipped_patients_filtered": skipped_patients_filtered,
    "validation_counts": q_validation_counts,
    "written_documents": written_documents,
    "latest_per_id": q_latest_per_id,
    "patient_json": patient_json,
    "preview_record": preview_record,
    "table_profile": q_table_profile,
    "table_shapes": table_shapes,
    "table_stats": q_table_stats,
    "table_stats_all": q_table_stats,
    "catalog_lookup": catalog_lookup,
    "sheet_list": sheet_list,
    "fingerprint_documents": fingerprint_of("documents", "doc_id", ordered=True),
    "fingerprint_conversations": fingerprint_conversations,
    "fingerprint_encounters": fingerprint_encounters,
    "change_status": q_change_status,
    "revision_info": revision_info,
}
