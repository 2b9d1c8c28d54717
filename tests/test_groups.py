"""Duplicates, sequences and frequencies, also against brute force and with a hot key."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from joeira.operators import sequences as seq
from joeira.operators.distributions import distinct_values, frequency, presence
from joeira.operators.duplicates import duplicate_rows, first_duplicates
from joeira.operators.profile import shape


def test_sequence(frame):
    df = frame("ID", ["2501", "2502", "2505", "2509", "25000"])
    serials = seq.id_serials(df)
    row = seq.sequences(serials).first()
    assert (row.year, row["count"], row.min_serial, row.max_serial, row.missing_count, row.missing_share) == ("25", 5, 1, 9, 5, 0.555556)
    gaps = seq.gap_ranges(serials)
    assert sorted((r.gap_start, r.gap_end, r.gap_len) for r in gaps.collect()) == [(3, 4, 2), (6, 8, 3)]
    assert sorted(r.missing_serial for r in seq.missing_numbers(gaps).collect()) == [3, 4, 6, 7, 8]
    assert seq.missing_preview(gaps, 3).first().missing_text == "3, 4, 6, ... (2 more)"
    assert seq.missing_preview(gaps, 5).first().missing_text == "3, 4, 6, 7, 8"


def test_group_without_numbers_is_not_valid(frame):
    row = seq.sequences(seq.id_serials(frame("ID", ["ab", "abx"]))).first()
    assert (row.valid, row["count"], row.missing_count) == (False, 2, None)


def brute_gaps(numbers):
    ordered = sorted(set(numbers))
    return [(a + 1, b - 1) for a, b in zip(ordered, ordered[1:]) if b - a > 1]


@pytest.mark.parametrize("seed", range(3))
def test_gaps_over_block_edges_agree_with_brute_force(spark, seed):
    """Numbers around the edges of the small and the large blocks, and far outliers."""
    rng = random.Random(seed)
    edges = [0, 1 << 21, 5 << 21, 1 << 42, 3 << 42, -(1 << 21), (1 << 62)]
    groups = {g: [e + rng.randint(-4, 4) for e in edges for _ in range(rng.randint(0, 5))] + [0] for g in "ab"}
    df = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "year string, serial bigint")
    got = {(r.year, r.gap_start, r.gap_end) for r in seq.gap_ranges(df).collect()}
    assert got == {(g, a, b) for g, ns in groups.items() for a, b in brute_gaps(ns)}


def test_a_long_gap_is_listed_whole(spark):
    df = spark.createDataFrame([("25", 1), ("25", 200_003)], "year string, serial bigint")
    listed = seq.missing_numbers(seq.gap_ranges(df))
    assert (listed.count(), listed.distinct().count()) == (200_001, 200_001)
    sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200_001


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30))
def test_missing_numbers_property(spark, numbers):
    df = spark.createDataFrame([("y", n) for n in numbers], "year string, serial bigint")
    got = sorted(r.missing_serial for r in seq.missing_numbers(seq.gap_ranges(df)).collect())
    assert got == sorted(set(range(min(numbers), max(numbers) + 1)) - set(numbers))


def test_duplicates_with_a_hot_key_split_over_salts(frame):
    keys = ["hot"] * 400 + [f"k{i % 150}" for i in range(300)] + [f"single{i}" for i in range(300)] + [None] * 50
    random.Random(1).shuffle(keys)
    df = frame("ID", keys)
    counts = Counter(k for k in keys if k is not None)
    expected = {(k, counts[k], i) for i, k in enumerate(keys) if k is not None and counts[k] > 1}
    for hot_rows in (10, 1_000_000):
        got = duplicate_rows(df, hot_rows=hot_rows).collect()
        assert len(got) == len(expected)
        assert {(r.ID, r.n, r.row_idx) for r in got} == expected
        assert all(r.first_row == keys.index(r.ID) for r in got)


def test_first_duplicates_say_how_many_are_hidden(frame):
    df = frame("ID", ["b", "a", "a", "b", "c", "c", "d", "d"] + ["a"] * 20)
    rows = {r.ID: r for r in first_duplicates(df).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].lines == [3, 4] + list(range(10, 18)) and rows["a"].n_more == 12
    assert rows["b"].lines == [2, 5] and rows["b"].n_more == 0


def test_frequency_order_and_ties(frame):
    df = frame("c", ["x", "b", "a", "x", "", None])
    assert [(r.value, r["count"], r.share) for r in frequency(df, "c").collect()] == [("x", 2, 0.5), ("a", 1, 0.25), ("b", 1, 0.25)]
    assert frequency(frame("c", [None, ""]), "c").count() == 0


def test_presence_distinct_and_shape(frame):
    df = frame("a b", [("x", ""), ("x", None), ("y", "z")])
    assert {(r["column"], r.missing_count) for r in presence(df, ["a", "b"]).collect()} == {("a", 0), ("b", 2)}
    assert sorted(r.a for r in distinct_values(df, "a").collect()) == ["x", "y"]
    assert shape(df, "t").first()[0:3] == ("t", 3, 3)


def test_serials_further_apart_than_a_number_can_say(frame, spark):
    from joeira.operators.sequences import gap_ranges, id_serials, missing_numbers, missing_preview, sequences

    df = frame("ID", ["25-9223372036854775800", "259223372036854775800", "2601", "2604"])
    found = {r.year: r for r in sequences(id_serials(df)).collect()}
    assert not found["25"].valid and found["25"].missing_count is None and found["25"].missing_share == 1.0
    assert found["26"].valid and found["26"].missing_count == 2
    gaps = gap_ranges(id_serials(df))
    assert {(r.year, r.gap_len) for r in gaps.collect()} == {("25", None), ("26", 2)}
    assert len(missing_numbers(gaps).limit(3).collect()) == 3
    assert {r.year: r.missing_count for r in missing_preview(gaps).collect()} == {"25": None, "26": 2}


def test_a_gap_longer_than_any_array(frame):
    from joeira.operators.sequences import gap_ranges, id_serials, missing_numbers

    gaps = gap_ranges(id_serials(frame("ID", ["2501", "2599999999999999999"])))
    assert gaps.first().gap_len == 99999999999999999 - 2
    assert len(missing_numbers(gaps).limit(3).collect()) == 3


def test_missing_numbers_across_pieces_and_zero(spark):
    from joeira.operators.sequences import gap_ranges, missing_numbers, sequences

    far = spark.createDataFrame([("a", -70_000), ("a", 140_000), ("b", -2_000_000_000), ("b", 2_000_000_000)], "g string, n int")
    rows = sequences(far, "g", "n").orderBy("g").collect()
    assert [r.missing_count for r in rows] == [209_999, 3_999_999_999]
    listed = missing_numbers(gap_ranges(far.filter("g = 'a'"), "g", "n"), "g")
    one = listed.selectExpr("count(*) AS n", "count(DISTINCT missing_serial) AS d", "min(missing_serial) AS lo", "max(missing_serial) AS hi").first()
    assert tuple(one) == (209_999, 209_999, -69_999, 139_999)


def test_a_key_called_n(spark):
    from joeira.operators.duplicates import duplicate_keys, duplicate_rows, duplicate_summary

    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "row_idx int, n string")
    assert [tuple(r) for r in duplicate_keys(df, "n").collect()] == [("x", 2, 0)]
    assert duplicate_rows(df, "n").count() == 2 and duplicate_summary(df, "n").first().duplicate_rows == 2


def test_bitmaps_are_shared_by_all_levels(spark):
    """Numbers at both ends of words, and one word read by windows, block edges and all levels."""
    from joeira.operators.sequences import gap_ranges

    numbers = [-(1 << 63), -65, -64, -1, 0, 63, 64, 127, 191, (1 << 63) - 1]
    df = spark.createDataFrame([("a", n) for n in numbers * 3], "g string, n bigint")
    gaps = gap_ranges(df, "g", "n")
    assert sorted((r.gap_start, r.gap_end) for r in gaps.collect()) == brute_gaps(numbers)
    plan = gaps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("- Exchange ") <= 4 and plan.count("- ReusedExchange ") >= 2
