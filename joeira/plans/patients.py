"""CSV to patient documents: scan, filter, validate, write, count."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from joeira.operators.filters import parse_year_filter
from joeira.operators.validation import accepted, rejected, skipped, validate, validation_counts, written_count
from joeira.sinks.documents import to_json_text, write_documents
from joeira.sources.text import read_patient_csv


@dataclass
class PatientJob:
    """The frames of one validation run; nothing runs until one is used."""

    validated: DataFrame

    @property
    def patients(self) -> DataFrame:
        return accepted(self.validated)

    @property
    def rejected(self) -> DataFrame:
        return rejected(self.validated)

    @property
    def skipped(self) -> DataFrame:
        return skipped(self.validated)

    @property
    def counts(self) -> DataFrame:
        return validation_counts(self.validated)

    @property
    def written(self) -> DataFrame:
        return written_count(self.patients)

    def preview(self) -> str:
        """First kept record as indented JSON."""
        row = first_record(self.validated).head()
        if row is None or row["reasons"]:
            return "Unable to generate preview"
        return json.dumps(json.loads(row["json"]), indent=2)

    def write(self, out_dir: str, by_year: bool = False) -> str:
        """Put the documents into those in ``out_dir``; the ones of other IDs stay."""
        return write_documents(self.patients, out_dir, by_year)


def first_record(validated: DataFrame, pretty: bool = False) -> DataFrame:
    """The first row, in file order, that the scan keeps, as a document."""
    kept = validated.filter(
        "in_filter AND NOT array_contains(reasons, 'id_missing') AND NOT array_contains(reasons, 'nome_missing')"
    )
    return kept.orderBy("row_idx").limit(1).select(
        "row_idx", "ID", "reasons", to_json_text(pretty).alias("json")
    )


def validate_table(df: DataFrame, year_filter: str | None = None, **options: bool) -> PatientJob:
    """Validate a table that has a ``row_idx`` column."""
    return PatientJob(validate(df, parse_year_filter(year_filter), **options))


def csv_to_documents(
    spark: SparkSession, csv_path: str, year_filter: str | None = None, multiline: bool = False, **options: bool
) -> PatientJob:
    return validate_table(read_patient_csv(spark, csv_path, multiline), year_filter, **options)
