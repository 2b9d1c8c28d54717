import pytest
from pyspark.sql import functions as F

from joeira.sources import catalog, landing
from joeira.sources.rownum import with_parquet_row_idx, with_row_idx
from joeira.sources.text import CORRUPT, read_patient_csv, read_quality_csv
from joeira.sinks.tables import write_table


def save(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_keeps_text_and_reads_na_tokens(spark, tmp_path):
    path = save(tmp_path, "a.csv", 'ID,nome,processo\n0025,NA,12\n2501,"Silva, João",\n2502,"say ""hi""",12\n')
    rows = read_quality_csv(spark, path).orderBy("row_idx").collect()
    assert [(r.row_idx, r.ID, r.nome, r.processo) for r in rows] == [
        (0, "0025", None, "12"), (1, "2501", "Silva, João", None), (2, "2502", 'say "hi"', "12"),
    ]
    assert read_quality_csv(spark, path, na_tokens=()).filter("nome = 'NA'").count() == 1


def test_columns_come_from_the_header_in_any_order(spark, tmp_path):
    path = save(tmp_path, "a.csv", "extra,nome,ID\nx,Ana,2501\n")
    row = read_quality_csv(spark, path).first()
    assert (row.ID, row.nome, row.extra) == ("2501", "Ana", "x")


def test_quoted_line_breaks(spark, tmp_path):
    path = save(tmp_path, "a.csv", 'ID,nome\n2501,"Ana\nMaria"\n2502,Rui\n')
    rows = read_quality_csv(spark, path, multiline=True).orderBy("row_idx").collect()
    assert [(r.row_idx, r.nome) for r in rows] == [(0, "Ana\nMaria"), (1, "Rui")]


def test_short_lines_are_marked_whatever_is_selected(spark, tmp_path):
    path = save(tmp_path, "a.csv", "ID,nome,processo,extra\n2501\n2502,,1,z\n2503,Ana,2,w\n")
    df = read_patient_csv(spark, path).select("ID", "nome", F.col(CORRUPT).isNotNull().alias("short"))
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("2501", None, True), ("2502", None, False), ("2503", "Ana", False)]


def test_row_numbers_follow_the_file_over_many_splits(spark, tmp_path, small_splits):
    lines = [f"{i},{'x' * (i % 37)}" for i in range(3000)]
    path = save(tmp_path, "a.csv", "ID,pad\n" + "\n".join(lines) + "\n")
    df = read_quality_csv(spark, path)
    assert df.rdd.getNumPartitions() > 4
    wrong = df.filter(F.col("row_idx") != F.col("ID").cast("bigint")).count()
    assert (df.count(), wrong) == (3000, 0)


def test_row_numbers_run_on_over_files(spark, tmp_path, small_splits):
    start = 0
    for name, n in (("part-0", 700), ("part-1", 5), ("part-2", 1500)):
        save(tmp_path / "d", f"{name}.csv", "ID\n" + "\n".join(f"{start + i}" for i in range(n)) + "\n")
        start += n
    df = with_row_idx(spark.read.option("header", "true").csv(str(tmp_path / "d")))
    assert df.filter(F.col("row_idx") == F.col("ID").cast("bigint")).count() == start
    assert df.agg(F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()[0:3] == (start, 0, start - 1)


def test_row_numbers_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr("joeira.sources.rownum.BROADCAST_SPLITS", 0)
    path = save(tmp_path, "a.csv", "ID\n" + "\n".join(str(i) for i in range(2000)) + "\n")
    df = read_quality_csv(spark, path)
    assert df.filter(F.col("row_idx") == F.col("ID").cast("bigint")).count() == 2000


def test_row_numbers_stay_after_a_filter(spark, tmp_path):
    path = save(tmp_path, "a.csv", "ID\na\nb\nc\n")
    assert read_quality_csv(spark, path).filter("ID = 'c'").first().row_idx == 2


def test_row_numbers_of_parquet(spark, tmp_path, small_splits):
    path = str(tmp_path / "p")
    spark.range(0, 5000, 1, 3).withColumnRenamed("id", "n").write.parquet(path)
    df = with_parquet_row_idx(spark.read.parquet(path))
    assert df.filter(F.col("row_idx") == F.col("n")).count() == 5000


def test_order_column_is_used_as_it_is(frame):
    df = frame("ID", ["a", "b"]).withColumn("k", F.col("row_idx") * 10).drop("row_idx")
    assert [r.row_idx for r in with_row_idx(df, order_column="k").orderBy("row_idx").collect()] == [0, 10]


@pytest.fixture
def sheets(spark, tmp_path):
    folder = tmp_path / "landing dir"
    save(folder, "Ward A.csv", "ID,nome\n25,Ana\n")
    save(folder, "beds.json", '{"ID":"1","n":2}\n{"ID":"2","n":3}\n')
    save(folder, "notes.txt", "not a sheet")
    write_table(spark.createDataFrame([("2501", "x")], "ID string, v string"), str(folder), "Big/Sheet 1", "parquet")
    return str(folder)


def test_list_and_read_sheets(spark, sheets):
    rows = landing.list_sheets(spark, sheets).collect()
    assert [(r.sheet_name, r.format) for r in rows] == [("Big_Sheet_1", "parquet"), ("Ward A", "csv"), ("beds", "json")]
    assert all(r.size_bytes > 0 and r.modified_time is not None for r in rows)
    assert landing.read_sheet(spark, sheets, "Ward A").first().nome == "Ana"
    assert landing.read_sheet(spark, sheets, sheet_index=2).count() == 2
    assert landing.read_sheet(spark, sheets).first().v == "x"
    with pytest.raises(KeyError):
        landing.read_sheet(spark, sheets, "nope")
    for position in (3, -1):
        with pytest.raises(IndexError):
            landing.read_sheet(spark, sheets, sheet_index=position)
    with pytest.raises(ValueError):
        landing.read_path(spark, sheets, "xlsx")


def test_listing_does_not_read_the_files(spark, sheets):
    assert "content" not in landing.list_sheets(spark, sheets)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_ingest_goes_on_past_a_failing_sheet(spark, sheets, tmp_path):
    def store(sheet, df):
        if sheet.name == "beds":
            raise OSError("disk says no")
        return write_table(df, str(tmp_path / "out"), sheet.target, "csv")

    status = {r.sheet_name: r for r in landing.ingest_all(spark, sheets, store).collect()}
    assert {n: r.status for n, r in status.items()} == {"Big_Sheet_1": "ok", "Ward A": "ok", "beds": "failed"}
    assert "disk says no" in status["beds"].error
    assert status["Ward A"].path.endswith("Ward_A.csv")


def test_catalog(spark):
    spark.createDataFrame([(1, "a"), (2, None)], "n int, t string").createOrReplaceTempView("some_table")
    assert catalog.table_exists(spark, "some_table") and not catalog.table_exists(spark, "other_table")
    assert "some_table" in catalog.list_tables(spark)
    assert catalog.get_table(spark, "some_table").count() == 2
    row = catalog.table_stats(spark, "some_table").first()
    assert (row.row_count, row.size) == (2, 8 + 1 + 8)
    with pytest.raises(ValueError):
        catalog.table_stats(spark, "other_table")
