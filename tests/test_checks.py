import datetime as dt

import pytest
from pyspark.sql import functions as F

from joeira.operators.checks import allowed_check, count_checks, first_examples, list_issues, pattern_check
from joeira.plans.quality import run_quality

AS_OF = dt.date(2025, 6, 30)


def counts(q):
    return {r["check"]: (r.scope_count, r.failed_count) for r in q.check_counts.collect()}


def figures(q):
    return {(r["check"], r.metric): r.value for r in q.findings.collect()}


def test_dirty_ids(frame):
    q = run_quality(frame("ID", ["2501", "2501", "2503", None, "ab1", "2", "25000", "251234"]), AS_OF)
    found = counts(q)
    assert found["id_missing"] == (8, 1)
    assert found["id_pattern"] == (7, 3)
    assert sorted(r.prefix for r in q.year_prefixes.collect()) == ["2", "25", "ab"]
    assert [(r.ID, r.n, r.first_row) for r in q.duplicate_ids.collect()] == [("2501", 2, 0)]
    assert sorted((r.ID, r.row_idx, r.line_no) for r in q.duplicate_rows.collect()) == [("2501", 0, 2), ("2501", 1, 3)]
    summary = q.duplicate_summary.first()
    assert (summary.total_rows, summary.duplicate_rows, summary.duplicate_keys, summary.duplicate_share) == (8, 2, 1, 0.25)


def test_unusual_years(frame):
    q = run_quality(frame("ID", ["1401", "1501", "2601", "2701", "xx1"]), AS_OF)
    assert {(r.prefix, r.kind) for r in q.unusual_years.collect()} == {("27", "future"), ("14", "very_old")}


def test_date_format(frame):
    q = run_quality(frame("data_ent", ["1-2-2025", "01-02-2025", "31-02-2025", "1/2/2025", "5-5-25", "", None]), AS_OF)
    found = counts(q)
    assert found["admission_missing"] == (7, 2)
    assert found["admission_format"] == (5, 2)
    shown = [(r.rank, r.value) for r in q.examples.filter("check = 'admission_format'").orderBy("rank").collect()]
    assert shown == [(1, "1/2/2025"), (2, "5-5-25")]


def test_year_match(frame):
    q = run_quality(frame("ID data_ent", [("2501", "1-1-2025"), ("2401", "1-1-2025"), ("2501", "31-02-2025")]), AS_OF)
    assert counts(q)["year_mismatch"] == (2, 1)
    assert counts(q)["admission_unparseable"] == (3, 1)
    issue = q.issues.filter("check = 'year_mismatch'").first()
    assert (issue.row_idx, issue.id, issue.value, issue.number, issue.against) == (1, "2401", "1-1-2025", 2025, "24")


def test_one_impossible_date_does_not_spoil_the_others(frame):
    q = run_quality(frame("ID data_ent data_alta", [("2501", "31-02-2025", "1-3-2025"), ("2502", "1-1-2025", "2-1-2025")]), AS_OF)
    f = figures(q)
    assert counts(q)["stay_unparseable"] == (2, 1) and counts(q)["discharge_before_admission"] == (1, 0)
    assert f["stay_stats", "mean"] == 1.0


def test_stays(frame):
    rows = [("1-1-2025", "11-1-2025"), ("10-1-2025", "8-1-2025"), ("1-1-2025", "11-3-2025"), ("1-1-2025", None)]
    q = run_quality(frame("data_ent data_alta", rows), AS_OF)
    f, found = figures(q), counts(q)
    assert found["stay_unparseable"] == (3, 0)
    assert found["discharge_before_admission"] == (3, 1) and found["long_stay"] == (3, 1)
    stats = {m: f["stay_stats", m] for m in ("count", "mean", "median", "min", "max")}
    assert stats == {"count": 3, "mean": 25.666667, "median": 10, "min": -2, "max": 69}


def test_longest_stays_come_first(frame):
    rows = [("1-1-2025", f"{d}-{m}-2025") for d, m in ((10, 3), (1, 4), (1, 6), (2, 6), (1, 5), (5, 5), (1, 4))]
    shown = run_quality(frame("data_ent data_alta", rows), AS_OF).examples.filter("check = 'long_stay'").orderBy("rank").collect()
    assert [r.row_idx for r in shown] == [3, 2, 5, 4, 1]


def test_births(frame):
    q = run_quality(frame("data_nasc", ["1-1-1899", "1-1-1900", "31-12-2025", "1-1-2026"]), AS_OF)
    found = counts(q)
    assert found["birth_too_old"] == (4, 1) and found["birth_in_future"] == (4, 1)


def test_ages(frame):
    rows = [("2-6-2000", "1-6-2025"), ("1-6-2000", "1-6-2025"), ("1-1-2025", "1-1-2015"), ("1-1-1910", "1-1-2025"), ("1-1-1899", "1-1-2025")]
    q = run_quality(frame("data_nasc data_ent", rows), AS_OF)
    found = counts(q)
    assert (found["age_very_young"], found["age_negative"], found["age_very_old"]) == ((4, 1), (4, 1), (4, 1))
    assert [(r.label, r["count"]) for r in q.age_histogram.collect()] == [("-10--1", 1), ("20-29", 2), ("110-119", 1)]
    f = figures(q)
    assert (f["age_stats", "median"], f["age_stats", "mean"]) == (24.5, 38.5)


def test_processo_and_sex(frame):
    q = run_quality(frame("processo", ["123", "12-3", "1 2", "12a", "12.0", "", None]), AS_OF)
    assert counts(q) == {"processo_missing": (7, 2), "processo_invalid": (5, 2)}
    q = run_quality(frame("sexo", ["M", "F", "m", " F ", "X", "", None]), AS_OF)
    assert counts(q) == {"sexo_missing": (7, 2), "sexo_unexpected": (5, 3)}
    assert {(r["column"], r.value): (r["count"], r.share) for r in q.value_frequencies.collect()}["sexo", "M"] == (1, 0.2)


def test_every_missing_row_is_listed(frame):
    q = run_quality(frame("ID", [None] * 40 + ["2501"]), AS_OF)
    assert q.issues.filter("check = 'id_missing'").count() == 40
    assert q.examples.filter("check = 'id_missing'").count() == 10


def test_examples_without_an_id_column(frame):
    q = run_quality(frame("destino", ["", "Home"]), AS_OF)
    assert q.examples.first().id == "Unknown"


def test_empty_table(frame, spark):
    q = run_quality(frame("ID sexo data_ent data_alta data_nasc", [("2501", "M", "1-1-2025", "1-1-2025", "1-1-1990")]).limit(0), AS_OF)
    assert set(r.failed_share for r in q.check_counts.collect()) == {0.0}
    assert q.statistics.count() == 0
    assert q.duplicate_summary.first().duplicate_share == 0.0
    assert any("Missing IDs:** None" in r.text for r in q.report().collect())


def test_own_checks_on_any_table(frame):
    df = frame("ID code colour", [("a", "12", "red"), ("b", "x", "blue"), ("c", "", "pink")])
    mine = [pattern_check("code", "^[0-9]+$", "code_format"), allowed_check("colour", ["red", "blue"])]
    assert [(r.scope_count, r.failed_count) for r in count_checks(df, mine).collect()] == [(2, 1), (3, 1)]
    rows = first_examples(list_issues(df, mine), mine).orderBy("check").collect()
    assert [(r["check"], r.id, r.value) for r in rows] == [("code_format", "b", "x"), ("colour_unexpected", "c", "pink")]


def test_input_is_not_changed(frame):
    """The second look at missing IDs sees what the first one saw."""
    q = run_quality(frame("ID", ["2501", None]), AS_OF)
    assert counts(q) == counts(q) and counts(q)["id_missing"] == (2, 1)


def test_year_filter_applies_to_everything_but_the_summary(frame):
    q = run_quality(frame("ID", ["2501", "2501", "2401", None]), AS_OF, "25")
    assert q.filter_info.first().total_records == 4
    assert q.exit_code() == 0 and run_quality(frame("ID", ["2501"]), AS_OF, "19").exit_code() == 1
    assert counts(q)["id_missing"] == (2, 0)
    with pytest.raises(ValueError):
        run_quality(frame("ID", ["2501"]), AS_OF, "x").rows


def test_reuse_gives_the_same_figures(frame):
    rows = [("2501", "1-1-2025", "M"), ("2401", "1-1-2025", "x"), (None, "", "F")]
    plain, reused = (run_quality(frame("ID data_ent sexo", rows), AS_OF, reuse=r) for r in (False, True))
    assert figures(plain) == figures(reused)
    assert "parquet" in reused.rows._jdf.queryExecution().toString().lower()


def test_a_broken_check_stops_no_other(frame):
    from joeira.operators.checks import Check, working_checks
    from joeira.plans.quality import run_quality

    rows = frame("ID nome sexo data_ent", [("2501", "Ana", "M", "1-1-2025"), ("2502", "x7", "F", "2-1-2025"), ("25", "12", "?", "x")])
    number = F.col("nome").cast("int")
    own = [
        Check("long_name", "nome", F.length("nome") > 2, value=F.col("nome")),
        Check("no_number", "nome", number > 3),  # raises for names that are none
        Check("no_column", "lost", F.col("lost") > 1),
        Check("bad_listing", "nome", F.lit(True), number=F.col("nome")),  # fails only in what it would list
        Check("no_condition", "nome", F.col("nome") + F.array(F.lit(1))),
        Check("by_zero", "ID", F.lit(1) / (F.length("ID") - 2) > 5),
        Check("short_id", "ID", F.length("ID") < 4),
    ]
    good, broken = working_checks(rows, own)
    assert [c.name for c in good] == ["long_name", "short_id"]
    assert [b.check.name for b in broken] == ["no_number", "no_column", "bad_listing", "no_condition", "by_zero"]
    run = run_quality(rows, "2025-06-30", checks=own)
    found = {(r.check, r.metric): r.value for r in run.findings.collect()}
    assert found["long_name", "failed_count"] == 1 and found["short_id", "failed_count"] == 1 and found["sexo_missing", "scope_count"] == 3
    assert {c for c, m in found if m == "error"} == {b.check.name for b in broken}
    errors = {r.check: r.error for r in run.errors.collect()}
    assert "CAST_INVALID_INPUT" in errors["no_number"] and "DIVIDE_BY_ZERO" in errors["by_zero"] and "lost" in errors["no_column"]
    assert run.issues.where("check = 'short_id'").count() == 1


def test_a_failure_that_is_none_of_the_checks_is_raised(frame, monkeypatch):
    from joeira.operators.checks import Check, working_checks

    rows = frame("ID", ["1"])
    monkeypatch.setattr(type(rows), "agg", lambda *a: (_ for _ in ()).throw(OSError("the store is gone")))
    with pytest.raises(OSError):
        working_checks(rows, [Check("any", "ID", F.lit(True))])


def test_nothing_to_try(frame):
    from joeira.operators.checks import working_checks

    assert working_checks(frame("ID", ["1"]), []) == ([], [])
