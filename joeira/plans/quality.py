"""The quality run: load, filter, check, collect, report."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from joeira.functions.dates import as_of_date
from joeira.operators.checks import (
    Broken, Check, broken_checks, count_checks, first_examples, list_issues, standard_checks, working_checks,
)
from joeira.operators.derive import derive
from joeira.operators.distributions import age_histogram, count_values, frequencies, number_stats, summarise
from joeira.operators.duplicates import (
    duplicate_keys, duplicate_rows, key_counts, rows_of_first_duplicates, summary_of,
)
from joeira.operators.profile import table_profile
from joeira.operators.filters import filter_by_year, filter_summary
from joeira.operators.sequences import (
    gap_ranges, id_serials, id_serials_of, missing_numbers, sequences, unusual_years, year_prefixes,
)
from joeira.session import drop, written
from joeira.sources.text import read_quality_csv

CATEGORIES = ("sexo", "destino", "origem")
# Fixed as the numbers a run measures: column of the table, name in count_values.
STATISTICS = {"stay": ("data_alta", "q_days"), "age": ("data_nasc", "q_age")}


def _metric(column, check, metric, value):
    return F.struct(
        column.alias("column"), check.alias("check"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
    )


@dataclass
class QualityResult:
    """Every result of a run as a lazy frame.

    Five passes over the rows give the report: one aggregate for all checks, one
    grouped count for all frequencies and statistics, one grouping by ID for
    repeated IDs and sequences, one listing of the failing rows, and one for the
    rows of the first repeated IDs.
    """

    source: DataFrame
    as_of: dt.date
    year_filter: str | None = None
    profile: DataFrame | None = None
    copy: str | None = None
    own_checks: Sequence[Check] = ()

    @cached_property
    def rows(self) -> DataFrame:
        """The filtered rows with the helper columns."""
        return derive(filter_by_year(self.source, self.year_filter), self.as_of)

    @cached_property
    def checks(self) -> list[Check]:
        return [*standard_checks(self.source.columns, self.as_of), *self._tried[0]]

    @cached_property
    def _tried(self) -> tuple[list[Check], list[Broken]]:
        """The caller's checks, tried in a pass of their own: one that fails must not end the run."""
        return working_checks(self.rows, self.own_checks) if self.own_checks else ([], [])

    @cached_property
    def errors(self) -> DataFrame:
        """``column, check, error``: the caller's checks that could not be run."""
        return broken_checks(self.source.sparkSession, self._tried[1])

    @cached_property
    def filter_info(self) -> DataFrame:
        return filter_summary(self.source, self.year_filter)

    @cached_property
    def check_counts(self) -> DataFrame:
        return count_checks(self.rows, self.checks)

    @cached_property
    def issues(self) -> DataFrame:
        return list_issues(self.rows, self.checks)

    @cached_property
    def examples(self) -> DataFrame:
        return first_examples(self.issues, self.checks)

    def _has(self, *columns: str) -> bool:
        return set(columns) <= set(self.source.columns)

    @cached_property
    def value_counts(self) -> DataFrame:
        texts = {c: F.col(c) for c in CATEGORIES if self._has(c)}
        numbers = {k: F.col(q) for k, (_, q) in STATISTICS.items() if q in self.rows.columns}
        return count_values(self.rows, texts, numbers)

    @cached_property
    def value_frequencies(self) -> DataFrame:
        return frequencies(self.value_counts, [c for c in CATEGORIES if self._has(c)])

    @cached_property
    def statistics(self) -> DataFrame:
        return number_stats(self.value_counts)

    @cached_property
    def age_histogram(self) -> DataFrame:
        return age_histogram(self.value_counts.filter("kind = 'age'"))

    @cached_property
    def id_counts(self) -> DataFrame:
        """Rows and first row of every ID, from which the results on IDs are read."""
        return key_counts(self.rows.select("ID", "row_idx"))

    @cached_property
    def duplicate_ids(self) -> DataFrame:
        return duplicate_keys(self.rows)

    @cached_property
    def duplicate_rows(self) -> DataFrame:
        return duplicate_rows(self.rows)

    @cached_property
    def duplicate_summary(self) -> DataFrame:
        return summary_of(self.id_counts)

    @cached_property
    def first_duplicates(self) -> DataFrame:
        """Every row of the first three repeated IDs."""
        return rows_of_first_duplicates(self.rows, self.id_counts)

    @cached_property
    def sequences(self) -> DataFrame:
        return sequences(id_serials_of(self.id_counts), weight="_rows")

    @cached_property
    def gaps(self) -> DataFrame:
        return gap_ranges(id_serials(self.rows))

    @cached_property
    def missing_serials(self) -> DataFrame:
        return missing_numbers(self.gaps)

    @cached_property
    def year_prefixes(self) -> DataFrame:
        return year_prefixes(self.rows)

    @cached_property
    def unusual_years(self) -> DataFrame:
        return unusual_years(self.rows, self.as_of)

    @cached_property
    def findings(self) -> DataFrame:
        """Every figure of the run: column, check, metric, value."""
        c, k = F.col("column"), F.col("check")
        parts = [
            self.check_counts.select(
                F.inline(
                    F.array(*[_metric(c, k, m, F.col(m)) for m in ("scope_count", "failed_count", "failed_share")])
                )
            )
        ]
        counted = {c: (c, "frequency") for c in CATEGORIES if self._has(c)}
        counted |= {kind: (column, f"{kind}_stats") for kind, (column, q) in STATISTICS.items() if q in self.rows.columns}
        if counted:
            of, by = (
                F.element_at(F.create_map(*[F.lit(x) for kind, place in counted.items() for x in (kind, place[i])]), F.col("kind"))
                for i in (0, 1)
            )
            metrics = [_metric(of, by, m, F.col(m)) for m in ("count", "mean", "median", "min", "max")]
            unique = F.when(F.col("kind").isin(*CATEGORIES), F.col("unique_count"))
            metrics.append(_metric(of, by, "unique_count", unique))
            parts.append(
                summarise(self.value_counts).select(F.inline(F.array(*metrics))).filter(F.col("value").isNotNull())
            )
        if self._has("ID"):
            parts.append(
                self.duplicate_summary.select(
                    F.inline(
                        F.array(
                            *[
                                _metric(F.lit("ID"), F.lit("duplicates"), m, F.col(m))
                                for m in ("duplicate_rows", "duplicate_share", "duplicate_keys")
                            ]
                        )
                    )
                )
            )
        if self._tried[1]:
            parts.append(self.errors.select("column", "check", F.lit("error").alias("metric"), F.lit(1.0).alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def exit_code(self) -> int:
        """0, or 1 when the year filter leaves no rows."""
        return 0 if self.filter_info.first().filtered_records else 1

    def close(self) -> None:
        """Delete the copy of the rows that ``reuse`` wrote."""
        if self.copy:
            drop(self.source.sparkSession, self.copy)
            self.copy = None

    def report(self, file_name: str = "", written_at: dt.datetime | None = None) -> DataFrame:
        from joeira.plans.report import report_lines

        return report_lines(self, file_name, written_at)


def run_quality(
    source: DataFrame,
    as_of: dt.date | str | None = None,
    year_filter: str | None = None,
    reuse: bool = False,
    profile: DataFrame | None = None,
    checks: Sequence[Check] = (),
) -> QualityResult:
    """Plan a quality run over a table that has ``row_idx``.

    ``reuse`` writes the filtered rows with their helper columns to the
    session's shared folder first, so that the passes read columns instead of
    parsing text again; worth it for CSV sources.  It fails without such a
    folder; ``close`` deletes the copy.  ``checks`` are run beside the standard
    ones; each that cannot be run has a row in ``errors`` and a metric ``error``
    among the findings, and all others go on.
    """
    result = QualityResult(source, as_of_date(as_of), year_filter, profile, own_checks=tuple(checks))
    if reuse:
        result.copy = f"quality_rows_{uuid.uuid4().hex}"
        result.rows = written(result.rows, result.copy)
    return result


def run_quality_csv(
    spark: SparkSession, path: str, as_of: dt.date | str | None = None, year_filter: str | None = None, multiline: bool = False, **options
) -> QualityResult:
    profile = table_profile(read_quality_csv(spark, path, na_tokens=(), multiline=multiline, numbered=False), path)
    return run_quality(read_quality_csv(spark, path, multiline=multiline), as_of, year_filter, profile=profile, **options)
