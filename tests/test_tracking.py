import time

from pyspark.sql import functions as F

from joeira.operators.tracking import change_status, fingerprint, latest_revision, read_history, record_load


def hash_of(df, **options):
    return fingerprint(df, **options).first().data_hash


def test_fingerprint_sees_values_nulls_names_and_order(frame):
    base = hash_of(frame("a b", [("x", "y"), (None, "z")]))
    assert base == hash_of(frame("a b", [("x", "y"), (None, "z")]).repartition(5))
    for other in (
        frame("a b", [("x", "y"), ("", "z")]),
        frame("a b", [("x", "y"), ("-", "z")]),
        frame("a b", [(None, "z"), ("x", "y")]),
        frame("a b", [("x|1:y", None), (None, "z")]),
        frame("a c", [("x", "y"), (None, "z")]),
        frame("a b", [("x", "y")]),
    ):
        assert hash_of(other) != base


def test_unordered_fingerprint(frame):
    one, two = frame("a", ["x", "y", "y"]), frame("a", ["y", "x", "y"])
    assert hash_of(one) != hash_of(two)
    assert hash_of(one, ordered=False) == hash_of(two, ordered=False)
    assert hash_of(frame("a", ["x", "x", "y"]), ordered=False) != hash_of(one, ordered=False)


def test_change_status(spark):
    now = spark.createDataFrame([("same", 3, "h"), ("edited", 5, "h2"), ("named", 5, "h2"), ("new", 1, "h")], "source_id string, row_count bigint, data_hash string")
    old = spark.createDataFrame([("same", 3, "h", "r1"), ("edited", 4, "h", "41"), ("named", 5, "h", "r1")], "source_id string, row_count bigint, data_hash string, revision_id string")
    got = {r.source_id: (r.first_time, r.content_changed, r.row_delta, r.revision_id) for r in change_status(now, old, F.lit(99)).collect()}
    assert got == {"same": (False, False, 0, "r1"), "edited": (False, True, 1, "42"), "named": (False, True, 0, "99"), "new": (True, False, None, "99")}


def test_history(frame, spark, tmp_path):
    path = str(tmp_path / "history")
    assert read_history(spark, path).count() == 0
    first_data, second_data = frame("ID", ["2501", "2502"]), frame("ID", ["2501", "2503", "2504"])
    before = int(time.time())
    first = record_load(first_data, path, "sheet-1", "Ward A", "Ward_A.csv").first()
    assert int(first.revision_id) >= before and first["columns"] == ["ID"] and first.row_count == 2
    assert record_load(first_data, path, "sheet-1", "Ward A", "Ward_A.csv").first().revision_id == first.revision_id
    changed = record_load(second_data, path, "sheet-1", "Ward A", "Ward_A.csv").first()
    assert int(changed.revision_id) == int(first.revision_id) + 1
    record_load(second_data, path, "sheet-2", "Ward B", "Ward_B.csv")
    history = read_history(spark, path)
    assert history.count() == 4
    newest = {r.source_id: (r.sheet_name, r.row_count, r.revision_id) for r in latest_revision(history).collect()}
    assert newest["sheet-1"] == ("Ward A", 3, changed.revision_id) and newest["sheet-2"][0] == "Ward B"


def test_every_column_counts(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b")], "conv_id bigint, turn bigint, role string, text string")
    whole = fingerprint(df, ordered=False).first()
    for c in df.columns:
        changed = df.withColumn(c, F.lit(0).cast(df.schema[c].dataType))
        assert fingerprint(changed, ordered=False).first().data_hash != whole.data_hash
    moved = df.withColumnRenamed("conv_id", "row_idx")
    assert fingerprint(moved, moved.columns, ordered=False).first().data_hash != fingerprint(moved.withColumn("row_idx", F.lit(0)), moved.columns, ordered=False).first().data_hash


def test_names_with_commas_are_told_apart(spark):
    one = spark.createDataFrame([("a", "b")], "`x,y` string, z string")
    two = spark.createDataFrame([("a", "b")], "x string, `y,z` string")
    assert fingerprint(one, ordered=False).first().data_hash != fingerprint(two, ordered=False).first().data_hash
