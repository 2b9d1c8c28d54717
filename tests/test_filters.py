import pytest
from pyspark.sql import functions as F

from joeira.operators.filters import filter_by_year, filter_summary, in_year_range, parse_year_filter


def kept(df):
    return [r["ID"] for r in df.orderBy("row_idx").collect()]


@pytest.mark.parametrize("text, bounds", [("25", (25, 25)), ("25-20", (25, 20)), ("20-25", (25, 20)), ("5", (5, 5)), ("2025", (2025, 2025))])
def test_lenient_parse(text, bounds):
    assert parse_year_filter(text).bounds == bounds


@pytest.mark.parametrize("text", ["invalid", "25-", "-25", "25-20-15", "", None])
def test_lenient_parse_without_meaning_is_no_filter(text):
    assert parse_year_filter(text) is None


@pytest.mark.parametrize("text", ["5", "2025", "25-5", "ab", "25-20-15", "25-"])
def test_strict_parse_refuses(text):
    with pytest.raises(ValueError):
        parse_year_filter(text, strict=True)


def test_range_membership(frame):
    df = frame("ID", ["2501", "2401", "2301", "2201", "x1", "2", None])
    one, many = parse_year_filter("25"), parse_year_filter("25-23")
    tests = [in_year_range(F.col("ID"), y).alias(n) for n, y in (("one", one), ("many", many), ("all", None))]
    rows = df.select("row_idx", *tests).orderBy("row_idx").collect()
    assert [r["one"] for r in rows] == [True] + [False] * 6
    assert [r["many"] for r in rows] == [True, True, True, False, False, False, False]
    assert all(r["all"] for r in rows)


def test_quality_filter(frame):
    df = frame("ID", ["2501", "2401", "9901", "0101", "ab", None, "25"])
    assert kept(filter_by_year(df, "25")) == ["2501", "25"]
    assert kept(filter_by_year(df, "24-25")) == ["2501", "2401", "25"]
    assert filter_by_year(df, None) is df
    with pytest.raises(ValueError):
        filter_by_year(df, "2x")


def test_range_has_no_century(frame):
    df = frame("ID", ["2501", "2401", "9801", "9901", "6001"])
    assert kept(filter_by_year(df, "25-98")) == ["2501", "9801", "6001"]


def test_filter_needs_an_id_column(frame):
    df = frame("nome", ["a"])
    assert filter_by_year(df, "25") is df


def test_summary(frame):
    df = frame("ID", ["2501", "2401", "2301", None])
    row = filter_summary(df, "24-25").first()
    assert (row.filter_type, row.filter_value, row.total_records, row.filtered_records, row.kept_share) == ("range", "2025 to 2024", 4, 2, 0.5)
    row = filter_summary(df, "23").first()
    assert (row.filter_type, row.filter_value, row.filtered_records) == ("single", "2023", 1)
    row = filter_summary(df, None).first()
    assert (row.is_filtered, row.filter_value, row.filtered_records) == (False, None, 4)
    assert filter_summary(df.limit(0), "23").first().kept_share == 0.0
