"""The Markdown report as an ordered table of lines.

Every line carries ``section``, ``part`` and ``rank``; sorting by them gives
the report.  Lines come from the small result tables of a run, never from the
rows themselves.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from joeira.functions.values import percent, share
from joeira.operators.filters import filter_label

# Fixed texts of the report: these titles, and the labels and headings in the line functions below, are what its readers
# look for and have to stay as they are.
TITLES = {
    "file": "File Analysis",
    "ID": "ID Analysis",
    "data_ent": "Admission Date Analysis",
    "data_alta": "Discharge Date Analysis",
    "data_nasc": "Birth Date Analysis",
    "processo": "Processo Analysis",
    "nome": "Nome Analysis",
    "sexo": "Sexo Analysis",
    "destino": "Destino Analysis",
    "origem": "Origem Analysis",
}
SECTION = {name: i for i, name in enumerate(TITLES, start=1)}

# Parts inside a section, in reading order.
TITLE, MISSING, MISSING_ROWS, SECOND, SECOND_LIST, THIRD, THIRD_LIST, FOURTH, FOURTH_LIST, TABLE, TAIL, TAIL_LIST = range(12)

_MISSING_CHECKS = {
    "id_missing": ("ID", "Missing IDs"),
    "admission_missing": ("data_ent", "Missing Dates"),
    "birth_missing": ("data_nasc", "Missing Dates"),
    "processo_missing": ("processo", "Missing Values"),
    "nome_missing": ("nome", "Missing Values"),
    "sexo_missing": ("sexo", "Missing Values"),
    "destino_missing": ("destino", "Missing Values"),
    "origem_missing": ("origem", "Missing Values"),
}
# Check, where its examples go, and how an example reads.
_EXAMPLES = {
    "admission_format": ("data_ent", SECOND_LIST, "date"),
    "discharge_format": ("data_alta", SECOND_LIST, "date"),
    "birth_format": ("data_nasc", SECOND_LIST, "date"),
    "birth_too_old": ("data_nasc", THIRD_LIST, "date"),
    "birth_in_future": ("data_nasc", FOURTH_LIST, "date"),
    "discharge_before_admission": ("data_alta", THIRD_LIST, "pair"),
    "processo_invalid": ("processo", SECOND_LIST, "value"),
    "sexo_unexpected": ("sexo", TAIL_LIST, "value"),
    "id_pattern": ("ID", TAIL_LIST, "row"),
}


def _line(section: int, part: int, text: Column, rank: int = 0) -> Column:
    return F.struct(
        F.lit(section).alias("section"), F.lit(part).alias("part"),
        F.lit(rank).cast("bigint").alias("rank"), text.alias("text"),
    )


class _Figures:
    """Figures of the run by check and metric, on a one-row frame."""

    def __init__(self, have: set[str]):
        self.have = have

    def get(self, check: str, metric: str) -> Column:
        return F.coalesce(F.try_element_at("figures", F.lit(f"{check}.{metric}")), F.lit(0.0))

    def count(self, check: str, metric: str = "failed_count") -> Column:
        return self.get(check, metric).cast("bigint")

    def percent_of(self, part: Column, whole: Column) -> Column:
        return percent(share(part, whole))

    def counted(self, label: str, check: str, none_line: bool = True, with_share: bool = False) -> Column:
        """``- **label:** n (p)``; ``None`` or no line at all when n is 0."""
        n = self.count(check)
        shown = F.concat(F.lit(f"- **{label}:** "), n.cast("string"))
        if with_share:
            shown = F.concat(shown, F.lit(" ("), self.percent_of(n, self.count(check, "scope_count")), F.lit(")"))
        nothing = F.lit(f"- **{label}:** None") if none_line else F.lit(None).cast("string")
        return F.when(n > 0, shown).otherwise(nothing)


def _figure_lines(f: _Figures) -> list[Column]:
    out = []
    for check, (column, label) in _MISSING_CHECKS.items():
        if column in f.have:
            out.append(_line(SECTION[column], MISSING, f.counted(label, check, with_share=True)))

    if "ID" in f.have:
        n = f.count("duplicates", "duplicate_rows")
        p = f.percent_of(n, f.count("id_missing", "scope_count"))
        out.append(
            _line(
                SECTION["ID"], SECOND,
                F.when(n > 0, F.concat(F.lit("- **Duplicate IDs:** "), n.cast("string"), F.lit(" ("), p, F.lit(")")))
                .otherwise("- **Duplicate IDs:** None"),
            )
        )
        for rank, text in enumerate(
            (
                "", "**ID Sequence Analysis by Year:**", "| Year | Count | Min Serial | Max Serial | Missing Values |",
                "|------|-------|------------|------------|----------------|",
            )
        ):
            out.append(_line(SECTION["ID"], THIRD, F.lit(text), rank))
        bad = f.count("id_pattern")
        out.append(_line(SECTION["ID"], TAIL, F.lit(""), 0))
        out.append(_line(SECTION["ID"], TAIL, F.lit("**ID Pattern Consistency:**"), 1))
        out.append(
            _line(
                SECTION["ID"], TAIL,
                F.when(bad > 0, F.concat(F.lit("- Invalid IDs: "), bad.cast("string")))
                .otherwise("- All IDs follow the expected pattern."),
                2,
            )
        )

    for column, label in (("data_ent", "admission"), ("data_alta", "discharge"), ("data_nasc", "birth")):
        if column in f.have:
            out.append(_line(SECTION[column], SECOND, f.counted("Invalid Date Formats", f"{label}_format")))
    if "data_nasc" in f.have:
        s = SECTION["data_nasc"]
        out.append(_line(s, THIRD, f.counted("Unusually Old Dates", "birth_too_old", none_line=False)))
        out.append(_line(s, FOURTH, f.counted("Future Dates", "birth_in_future", none_line=False)))
        some = f.count("age_stats", "count") > 0
        ages = [
            F.lit(""), F.lit("**Age Statistics:**"),
            F.format_string("- Mean Age: %.1f", f.get("age_stats", "mean")),
            F.format_string("- Median Age: %.1f", f.get("age_stats", "median")),
            F.concat(F.lit("- Min Age: "), f.count("age_stats", "min").cast("string")),
            F.concat(F.lit("- Max Age: "), f.count("age_stats", "max").cast("string")),
        ]
        out += [_line(s, TAIL, F.when(some, text), rank) for rank, text in enumerate(ages)]
    if {"data_ent", "data_alta"} <= f.have:
        out.append(
            _line(
                SECTION["data_alta"], THIRD,
                f.counted("Chronology Errors", "discharge_before_admission", none_line=False),
            )
        )
    if "processo" in f.have:
        out.append(_line(SECTION["processo"], SECOND, f.counted("Invalid Values", "processo_invalid", with_share=True)))
    if "sexo" in f.have:
        unexpected = f.counted("Unexpected Values", "sexo_unexpected", none_line=False, with_share=True)
        out.append(_line(SECTION["sexo"], TAIL, F.when(unexpected.isNotNull(), F.lit("")), 0))
        out.append(_line(SECTION["sexo"], TAIL, F.regexp_replace(unexpected, "^- ", ""), 1))
    for column in ("sexo", "destino", "origem"):
        if column in f.have:
            any_value = f.count("frequency_" + column, "unique_count") > 0
            out.append(_line(SECTION[column], SECOND, F.when(any_value, F.lit("")), 0))
            out.append(_line(SECTION[column], SECOND, F.when(any_value, F.lit("**Value Frequencies:**")), 1))
    for column in f.have & set(TITLES):
        out.append(_line(SECTION[column], TITLE, F.lit(""), 0))
        out.append(_line(SECTION[column], TITLE, F.lit(f"## {TITLES[column]}"), 1))
        out.append(_line(SECTION[column], TITLE, F.lit(""), 2))
    return out


def _by_check(places: dict[str, tuple], index: int) -> Column:
    pairs = [F.lit(x) for check, place in places.items() for x in (check, place[index])]
    return F.try_element_at(F.create_map(*pairs), F.col("check"))


def _example_lines(examples: DataFrame) -> DataFrame:
    """Lines showing examples, all from one look at the example table.

    The few rows of a check are already in one task, so listing their line
    numbers beside them moves nothing.
    """
    line = (F.col("row_idx") + 2).cast("string")
    in_check = W.partitionBy("check").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shown = examples.withColumn("lines", F.slice(F.collect_list(line).over(in_check), 1, 5))
    places = {check: (SECTION[column], part, shape) for check, (column, part, shape) in _EXAMPLES.items()}
    places |= {check: (SECTION[column], MISSING_ROWS, "rows") for check, (column, _) in _MISSING_CHECKS.items()}
    shape, who = _by_check(places, 2), F.concat(F.lit("  - ID '"), F.coalesce("id", F.lit("")), F.lit("'"))
    text = (
        F.when(shape == "date", F.concat(who, F.lit(" has date '"), F.col("value"), F.lit("'")))
        .when(shape == "value", F.concat(who, F.lit(" has value '"), F.col("value"), F.lit("'")))
        .when(shape == "row", F.concat(who, F.lit(" in row "), line))
        .otherwise(
            F.concat(
                who, F.lit(" has admission '"), F.col("against"), F.lit("' and discharge '"), F.col("value"), F.lit("'")
            )
        )
    )
    row_list = F.concat(F.lit("  - Examples: Rows "), F.array_join("lines", ", "))
    wanted = F.when(shape == "rows", F.col("rank") == 1).otherwise(F.col("rank") <= 3)
    return shown.filter(wanted).select(
        _by_check(places, 0).alias("section"), _by_check(places, 1).alias("part"),
        F.col("rank").cast("bigint").alias("rank"), F.when(shape == "rows", row_list).otherwise(text).alias("text"),
    ).filter(F.col("section").isNotNull())


def _head_lines(file_name: str, written_at: dt.datetime) -> list[Column]:
    n = F.format_string("%,d", F.col("filtered_records"))
    total = F.format_string("%,d", F.col("total_records"))
    span = (
        F.when(F.col("filter_type") == "single", F.concat(F.lit("from year "), F.col("filter_value"), F.lit(" only")))
        .otherwise(F.concat(F.lit("from years "), F.col("filter_value")))
    )
    filtered = F.col("is_filtered")
    texts = [
        F.lit(f"# Quality Control Report - {written_at:%Y-%m-%d %H:%M}"),
        F.lit(""),
        F.lit(f"**File:** {file_name}"),
        F.lit(""),
        F.when(filtered, F.concat(F.lit("**Filter:** Showing records "), span)),
        F.when(
            filtered,
            F.concat(F.lit("**Records:** "), n, F.lit(" of "), total, F.lit(" total ("),
                     percent(F.col("kept_share"), 1), F.lit(")")),
        ).otherwise("**Scope:** Full database (no filters applied)"),
    ]
    return [_line(0, 0, t, i) for i, t in enumerate(texts)]


def _with_totals(q, figures: DataFrame) -> DataFrame:
    """The figures with what the heading tells: read off them, as far as they know it."""
    whole = next((c.name for c in q.checks if c.scope is None), None)
    shown = q.year_filter if q.year_filter and "ID" in q.source.columns else None
    p = None
    if q.profile is not None:
        p = q.profile.select(F.struct("file_name", "file_path", "file_size_kb", "row_count").alias("p")).scalar()
    if whole is None:
        known = q.filter_info.select(F.struct("*").alias("known")).scalar()
        figures = figures.withColumn("known", known).select("figures", "known.*")
    else:
        kept = _Figures(set()).count(whole, "scope_count")
        if not shown:
            total = kept
        elif p is not None:
            total = p["row_count"]
        else:
            total = q.source.select(F.lit(1)).agg(F.count("*")).scalar()
        kind, label = filter_label(shown)
        figures = figures.withColumns({"filtered_records": kept, "total_records": total}).withColumns({
            "is_filtered": F.lit(bool(shown)), "filter_type": F.lit(kind), "filter_value": F.lit(label).cast("string"),
            "kept_share": F.round(share(F.col("filtered_records"), F.col("total_records")), 6),
        })
    return figures if p is None else figures.withColumn("p", p).select("*", "p.file_name", "p.file_path", "p.file_size_kb")


def _opening_lines(q, file_name: str, written_at: dt.datetime) -> list[Column]:
    """Heading and file section."""
    s, p = SECTION["file"], q.profile
    names = [c for c in q.source.columns if c != "row_idx"]
    texts = [F.lit(""), F.lit(f"## {TITLES['file']}"), F.lit("")]
    if p is not None:
        texts += [
            F.concat(F.lit("- **File Name:** "), F.col("file_name")),
            F.concat(F.lit("- **File Path:** "), F.col("file_path")),
            F.format_string("- **File Size:** %.2f KB", F.col("file_size_kb")),
        ]
    texts += [
        F.concat(F.lit("- **Total Rows:** "), F.col("filtered_records").cast("string")),
        F.lit(f"- **Total Columns:** {len(names)}"),
        F.lit(""),
        F.lit(f"**Columns:** {', '.join(names)}"),
    ]
    return [*_head_lines(file_name, written_at), *[_line(s, 0, t, i) for i, t in enumerate(texts)]]


# Rows of one ID follow each other in the report: below this many fit between two IDs.
ROWS_OF_ID = 1 << 50


def _id_lines(q) -> list[DataFrame]:
    s = SECTION["ID"]
    repeated = q.first_duplicates.select(
        F.lit(s).alias("section"), F.lit(SECOND_LIST).alias("part"), (F.col("place") * ROWS_OF_ID + F.col("row_idx")).alias("rank"),
        F.concat(F.lit("  - ID '"), F.col("ID"), F.lit("' in row "), (F.col("row_idx") + 2).cast("string")).alias("text"),
    )

    def cell(c: str, absent: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(absent))

    cells = [F.col("year"), cell("count", "0"), cell("min_serial", "N/A"), cell("max_serial", "N/A"), cell("missing_count", "0")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    # The year is the sort key as text: its character codes, so that no window is needed.
    rank = F.ascii("year").cast("bigint") * 1_200_000 + F.ascii(F.substring("year", 2, 1))
    years = q.sequences.select(
        F.lit(s).alias("section"), F.lit(TABLE).alias("part"), rank.alias("rank"), row.alias("text")
    )
    return [repeated, years]


def _frequency_lines(q) -> DataFrame:
    places = F.create_map(*[F.lit(x) for c in ("sexo", "destino", "origem") for x in (c, SECTION[c])])
    return q.value_frequencies.select(
        places[F.col("column")].alias("section"), F.lit(SECOND_LIST).alias("part"), (-F.col("count")).alias("rank"),
        F.concat(
            F.lit("- "), F.col("value"), F.lit(": "), F.col("count").cast("string"),
            F.lit(" ("), percent(F.col("share")), F.lit(")"),
        ).alias("text"),
    )


def report_lines(q, file_name: str = "", written_at: dt.datetime | None = None) -> DataFrame:
    """All lines of the report of a ``QualityResult``, in order."""
    have = set(q.source.columns)
    written_at = written_at or dt.datetime.now()
    check = F.when(F.col("check") == "frequency", F.concat(F.lit("frequency_"), F.col("column"))).otherwise(F.col("check"))
    # One row per figure goes in: their number depends on the checks, not on the data.
    figures = q.findings.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(".", check, "metric").alias("k"), F.coalesce("value", F.lit(0.0)).alias("v")))
        ).alias("figures")
    )
    lines = [*_opening_lines(q, file_name, written_at), *_figure_lines(_Figures(have))]
    parts = [_with_totals(q, figures).select(F.inline(F.array(*lines)))]
    if q.checks:
        parts.append(_example_lines(q.examples))
    if "ID" in have:
        parts += _id_lines(q)
    if have & {"sexo", "destino", "origem"}:
        parts.append(_frequency_lines(q))
    return (
        reduce(DataFrame.unionByName, parts)
        .filter(F.col("text").isNotNull())
        .orderBy("section", "part", "rank", "text")
    )
