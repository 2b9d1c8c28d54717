"""Row-level checks.

A ``Check`` is a predicate with a scope.  One aggregate counts all checks at
once (``count_checks``); one projection lists every failing row of every check
(``list_issues``); ``first_examples`` keeps the first few per check.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from joeira.functions.ids import ID_PATTERN
from joeira.functions.dates import year_suffix
from joeira.functions.missing import is_missing, is_present
from joeira.functions.values import RECORD_NO_PATTERN, SEX_CODES, share
from joeira.operators.derive import OLDEST_BIRTH_YEAR

LONG_STAY_DAYS = 60
VERY_YOUNG, VERY_OLD = 5, 100
# How Spark names the condition of an error of an expression.
_CONDITION = re.compile(r"\[[A-Z][A-Z0-9_]+(\.[A-Z0-9_]+)*\]")


@dataclass(frozen=True)
class Check:
    """A condition no row should meet.

    ``failed`` is looked at only where ``scope`` holds.  ``value``, ``number``
    and ``against`` describe the failing row; ``rank_key`` (smallest first,
    then file order) decides which rows are the first examples.
    """

    name: str
    column: str
    failed: Column
    scope: Column | None = None
    examples: int = 10
    value: Column | None = None
    number: Column | None = None
    against: Column | None = None
    rank_key: Column | None = None
    first_row_of_id: bool = False  # an example shows the first row that holds its ID

    def in_scope(self) -> Column:
        return F.lit(True) if self.scope is None else F.coalesce(self.scope, F.lit(False))

    def fails(self) -> Column:
        failed = F.coalesce(self.failed, F.lit(False))
        return failed if self.scope is None else self.in_scope() & failed

    def issue(self) -> Column:
        def text(c: Column | None) -> Column:
            return F.lit(None).cast("string") if c is None else c.cast("string")

        def whole(c: Column | None, default=None) -> Column:
            return F.lit(default).cast("bigint") if c is None else c.cast("bigint")

        return F.struct(
            F.lit(self.name).alias("check"),
            F.lit(self.column).alias("column"),
            text(self.value).alias("value"),
            whole(self.number).alias("number"),
            text(self.against).alias("against"),
            whole(self.rank_key, 0).alias("rank_key"),
        )


def missing_check(column: str, name: str | None = None, null_only: bool = False, examples: int = 10) -> Check:
    test = F.col(column).isNull() if null_only else is_missing(column)
    return Check(name or f"{column}_missing", column, test, examples=examples)


def pattern_check(
    column: str, pattern: str, name: str, null_only: bool = False, examples: int = 10, first_row_of_id: bool = False
) -> Check:
    scope = F.col(column).isNotNull() if null_only else is_present(column)
    return Check(name, column, ~F.col(column).rlike(pattern), scope, examples, value=F.col(column), first_row_of_id=first_row_of_id)


def allowed_check(column: str, allowed: Sequence[str], name: str | None = None, examples: int = 10) -> Check:
    return Check(
        name or f"{column}_unexpected", column, ~F.col(column).isin(*allowed),
        is_present(column), examples, value=F.col(column),
    )


def _date_checks(have: set[str]) -> list[Check]:
    out = []
    for column, label in (("data_ent", "admission"), ("data_alta", "discharge"), ("data_nasc", "birth")):
        if column not in have:
            continue
        if column != "data_alta":
            out.append(missing_check(column, f"{label}_missing"))
        out.append(
            Check(
                f"{label}_format", column, ~F.col(f"q_{column}_ok"), is_present(column),
                value=F.col(column),
            )
        )
    return out


def _birth_checks(as_of: dt.date) -> list[Check]:
    year, text = F.col("q_birth_year"), F.col("data_nasc")
    return [
        Check("birth_too_old", "data_nasc", year < OLDEST_BIRTH_YEAR, year.isNotNull(), value=text, number=year),
        Check("birth_in_future", "data_nasc", year > as_of.year, year.isNotNull(), value=text, number=year),
    ]


def _age_checks() -> list[Check]:
    age = F.col("q_age")
    limits = {"age_very_young": age < VERY_YOUNG, "age_very_old": age > VERY_OLD, "age_negative": age < 0}
    return [
        Check(
            name, "data_nasc", failed, age.isNotNull(), 5,
            value=F.col("data_nasc"), number=age, against=F.col("data_ent"),
        )
        for name, failed in limits.items()
    ]


def _stay_checks() -> list[Check]:
    """Pairs of well-formed dates, and among them the pairs that can be read."""
    days = F.col("q_days")
    shown = {"value": F.col("data_alta"), "number": days, "against": F.col("data_ent")}
    both = F.col("q_data_ent_ok") & F.col("q_data_alta_ok")
    return [
        Check(
            "stay_unparseable", "data_alta", days.isNull(), both,
            value=F.col("data_alta"), against=F.col("data_ent"),
        ),
        Check("discharge_before_admission", "data_alta", days < 0, days.isNotNull(), 15, **shown),
        Check("long_stay", "data_alta", days > LONG_STAY_DAYS, days.isNotNull(), 5, rank_key=-days, **shown),
    ]


def standard_checks(columns: Sequence[str], as_of: dt.date) -> list[Check]:
    """The checks of the quality run that the present columns allow.

    They refer to the columns that ``derive`` adds.
    """
    have = set(columns)
    out: list[Check] = []
    if "ID" in have:
        out.append(missing_check("ID", "id_missing", null_only=True))
        out.append(pattern_check("ID", ID_PATTERN, "id_pattern", null_only=True, examples=5, first_row_of_id=True))
    out += _date_checks(have)
    if {"ID", "data_ent"} <= have:
        date = F.col("q_data_ent")
        out.append(
            Check(
                "admission_unparseable", "data_ent", date.isNull(),
                F.col("q_data_ent_ok") & is_present("ID"), value=F.col("data_ent"),
            )
        )
        out.append(
            Check(
                "year_mismatch", "data_ent", year_suffix(date) != F.col("q_prefix"),
                date.isNotNull() & is_present("ID"), 20,
                value=F.col("data_ent"), number=F.year(date), against=F.col("q_prefix"),
            )
        )
    if {"data_ent", "data_alta"} <= have:
        out += _stay_checks()
    if "data_nasc" in have:
        out += _birth_checks(as_of)
        if "data_ent" in have:
            out += _age_checks()
    if "processo" in have:
        out.append(missing_check("processo"))
        out.append(pattern_check("processo", RECORD_NO_PATTERN, "processo_invalid"))
    for column in ("nome", "sexo", "destino", "origem"):
        if column in have:
            out.append(missing_check(column))
    if "sexo" in have:
        out.append(allowed_check("sexo", SEX_CODES))
    return out


def count_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Scope and failures of every check: one row each, one pass in all."""
    counters = [F.count("*").alias("rows")]
    for i, c in enumerate(checks):
        if c.scope is not None:
            counters.append(F.count_if(c.in_scope()).alias(f"s{i}"))
        counters.append(F.count_if(c.fails()).alias(f"f{i}"))
    rows = [
        F.struct(
            F.lit(c.column).alias("column"),
            F.lit(c.name).alias("check"),
            F.col("rows" if c.scope is None else f"s{i}").alias("scope_count"),
            F.col(f"f{i}").alias("failed_count"),
        )
        for i, c in enumerate(checks)
    ]
    return (
        df.agg(*counters)
        .select(F.inline(F.array(*rows)))
        .withColumn("failed_share", F.round(share(F.col("failed_count"), F.col("scope_count")), 6))
    )


@dataclass(frozen=True)
class Broken:
    """A check that cannot be run, and why."""

    check: Check
    error: str


def working_checks(df: DataFrame, checks: Sequence[Check]) -> tuple[list[Check], list[Broken]]:
    """The checks that run over all rows of ``df``, and those that do not, kept apart so that one cannot stop the others.

    A check that does not fit the columns is found without a job.  An error that only some row raises takes running it: one pass
    tries all checks together with what they would list, and only if that fails are halves tried, so that a broken
    check costs a pass for each halving.  A failure that is no error of an expression, such as a lost store, is raised.
    """
    fit: list[Check] = []
    broken: list[Broken] = []
    for c in checks:
        try:
            df.select(c.fails(), c.issue()).schema
            fit.append(c)
        except AnalysisException as problem:
            broken.append(Broken(c, _reason(problem)))
    good: list[Check] = []
    waiting = [fit] if fit else []
    while waiting:
        some = waiting.pop()
        # The sums keep the plan from leaving any of the expressions out.
        tried = [x for i, c in enumerate(some) for x in (F.count_if(c.in_scope()).alias(f"s{i}"), F.bit_xor(F.when(c.fails(), F.xxhash64(c.issue()))).alias(f"f{i}"))]
        try:
            df.agg(*tried).collect()
            good += some
        except Exception as problem:
            if not _CONDITION.search(str(problem)):
                raise
            if len(some) == 1:
                broken.append(Broken(some[0], _reason(problem)))
            else:
                half = len(some) // 2
                waiting += [some[:half], some[half:]]
    place = {id(c): i for i, c in enumerate(checks)}
    return sorted(good, key=lambda c: place[id(c)]), sorted(broken, key=lambda b: place[id(b.check)])


def _reason(problem: Exception) -> str:
    """The first line of an error that names its condition."""
    lines = str(problem).splitlines()
    return next((x.strip() for x in lines if _CONDITION.search(x)), lines[0] if lines else type(problem).__name__)


def broken_checks(spark: SparkSession, broken: Sequence[Broken]) -> DataFrame:
    """``column, check, error``: one row for each check that cannot be run."""
    return spark.createDataFrame([(b.check.column, b.check.name, b.error) for b in broken], "column string, check string, error string")


def list_issues(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per failed check and source row; a projection, no shuffle.

    A check that holds unfolds to a row of nulls, which is dropped: removing
    it from the array first would take the array out of generated code.
    """
    found = F.array(*[F.when(c.fails(), c.issue()) for c in checks])
    shown_id = F.col("ID") if "ID" in df.columns else F.lit("Unknown")
    return (
        df.select("row_idx", shown_id.alias("id"), F.inline(found))
        .filter(F.col("check").isNotNull())
        .select("check", "column", "row_idx", "id", "value", "number", "against", "rank_key")
    )


def first_examples(issues: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The first rows of every check, as many as the check asks for.

    The rank filter is pushed into every task before the shuffle, so a check
    that very many rows fail still moves only a few rows per task.  Where the
    check says so, an example shows the first row of its ID: if one of an ID's
    failing rows is among the first, so is the first of them.
    """
    limits = F.create_map(*[F.lit(x) for c in checks for x in (c.name, c.examples)])
    order = W.partitionBy("check").orderBy("rank_key", "row_idx")
    most = max(c.examples for c in checks)
    first = (
        issues.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
        .filter(F.col("rank") <= limits[F.col("check")])
        .drop("rank_key")
    )
    by_id = [c.name for c in checks if c.first_row_of_id]
    if not by_id:
        return first
    earliest = F.min("row_idx").over(W.partitionBy("check", "id"))
    return first.withColumn("row_idx", F.when(F.col("check").isin(*by_id), earliest).otherwise(F.col("row_idx")))
