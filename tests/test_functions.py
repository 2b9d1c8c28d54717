import datetime as dt

from pyspark.sql import functions as F

from joeira.functions import dates, ids, missing, values


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_pad_id(frame):
    df = frame("ID", ["25", "251", "2501", "25012", None])
    assert column(df, ids.pad_id(F.col("ID"))) == ["0025", "0251", "2501", "25012", None]


def test_serial_drops_zeros_and_other_text(frame):
    df = frame("ID", ["2501", "25000", "ab1", "2", "251234", "25x", "25-3", "251e2", "25012345678901"])
    assert column(df, ids.serial_from_id(F.col("ID"))) == [1, None, 1, None, 1234, None, -3, 100, 12345678901]


def test_year_from_id(frame):
    df = frame("ID", ["2501", "2", "ab12", None, "07"])
    assert column(df, ids.year_from_id(F.col("ID"))) == [25, None, None, None, 7]


def test_date_format_and_strict_parse(frame):
    df = frame("d", ["1-2-2025", "01-02-2025", "31-02-2025", "1/2/2025", "5-5-25", "", None, " 1-2-2025", "1-1-0000"])
    assert column(df, dates.has_date_format(F.col("d"))) == [True, True, True, False, False, False, False, False, True]
    feb = dt.date(2025, 2, 1)
    assert column(df, dates.parse_date(F.col("d"))) == [feb, feb, None, None, None, None, None, None, None]


def test_lenient_parse(frame):
    df = frame("d", ["1-2-2025", "5-5-25", "31-02-2025", "1/2/2025", "1-2-3-4", "not-a-date", None, "", "1-1-99999", "1-2-850", "1-13-2025"])
    expected = [dt.date(2025, 2, 1), dt.date(2025, 5, 5), *[None] * 7, dt.date(850, 2, 1), None]
    assert column(df, dates.parse_date_lenient(F.col("d"))) == expected


def test_strict_parse_of_every_day_agrees_with_the_calendar(spark):
    """All day/month pairs of a leap and a common year against Python's calendar."""
    cases = [(d, m, y) for y in (2023, 2024) for m in range(0, 14) for d in range(0, 33)]

    def real(d, m, y):
        try:
            return dt.date(y, m, d)
        except ValueError:
            return None

    df = spark.createDataFrame([(f"{d}-{m}-{y}",) for d, m, y in cases], "d string")
    expected = [real(*c) for c in cases]
    assert column(df, dates.parse_date(F.col("d"))) == expected
    assert column(df, dates.parse_date_lenient(F.col("d"))) == expected


def test_age_and_decade(frame):
    df = frame("born admitted", [("2-6-2000", "1-6-2025"), ("1-6-2000", "1-6-2025"), ("1-1-2025", "1-1-2015"), ("1-1-1910", "1-1-2025")])
    age = dates.age_from_text(F.col("admitted"), F.col("born"))
    assert column(df, age) == [24, 25, -10, 115]
    assert column(df, dates.decade_label(dates.age_decade(age))) == ["20-29", "20-29", "-10--1", "110-119"]


def test_decade_drops_towards_zero(spark):
    df = spark.createDataFrame([(-9,), (-1,), (0,), (9,), (10,)], "a int")
    assert column(df, dates.age_decade(F.col("a"))) == [0, 0, 0, 0, 10]


def test_format_and_suffix(spark):
    df = spark.createDataFrame([(dt.date(2005, 1, 9),), (None,)], "d date")
    assert column(df, dates.format_date(F.col("d"))) == ["09-01-2005", None]
    assert column(df, dates.year_suffix(F.col("d"))) == ["05", None]


def test_record_number(frame):
    df = frame("p", ["12", " 12 ", "+12", "-3", "12.0", "12.", "12.5", "12-3", "12a", "1_0", "", None])
    assert column(df, values.parse_record_no(F.col("p"))) == [12, 12, 12, -3, 12, 12, *[None] * 6]
    assert column(df, values.digits_only(F.col("p"))) == ["12", "12", "12", "3", "120", "12", "125", "123", "12", "10", None, None]


def test_sex(frame):
    df = frame("s", ["M", "F", "m", " F ", "X", "", None, "f\t"])
    assert column(df, values.normalise_sex(F.col("s"))) == ["M", "F", "M", "F", None, None, None, "F"]


def test_missing_and_na_tokens(frame):
    df = frame("c", ["a", "", None, "NA", "null", "nil"])
    assert column(df, missing.is_missing("c")) == [False, True, True, False, False, False]
    assert column(missing.na_to_null(df), F.col("c")) == ["a", None, None, None, None, "nil"]
    assert missing.na_to_null(df, ()) is df


def test_any_missing(frame):
    df = frame("a b", [("x", "y"), ("x", ""), (None, "y")])
    assert column(df, missing.any_missing("a", "b")) == [False, True, True]


def test_names_and_shares(frame):
    df = frame("n", ["Ward A/B 1"])
    assert column(df, ids.sanitise_name(F.col("n"))) == ["Ward_A_B_1"]
    assert column(df, values.share(F.lit(1), F.lit(0))) == [0.0]
    assert column(df, values.percent(F.lit(0.0104))) == ["1.04%"]
