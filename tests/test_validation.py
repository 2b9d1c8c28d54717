import datetime as dt
import json

from pyspark.sql import functions as F

from joeira.operators.filters import parse_year_filter
from joeira.operators.validation import validate
from joeira.plans.patients import csv_to_documents, validate_table

FULL = "ID nome processo data_ent data_alta sexo data_nasc destino origem"
CSV = """ID,nome,processo,data_ent,data_alta,sexo,data_nasc,destino,origem
2501,John Doe,12345,01-01-2025,15-01-2025,M,01-01-1980,Home,Emergency
2502,Jane Smith,12346,02-01-2025,16-01-2025,F,02-02-1985,Transfer,Clinic
2401,Bob Johnson,12347,03-03-2024,10-03-2024,M,03-03-1990,Home,Emergency
"""


def reasons(df, **options):
    return [r.reasons for r in validate(df, **options).orderBy("row_idx").collect()]


def test_full_record(frame):
    df = frame(FULL, [("2501", "John Doe", "12345", "01-01-2025", "15-01-2025", "M", "01-01-1980", "Home", "Emergency")])
    job = validate_table(df)
    row = job.patients.first()
    assert (row.ID, row.processo, row.sexo, row.data_ent) == ("2501", 12345, "M", dt.date(2025, 1, 1))
    doc = json.loads(job.preview())
    assert (doc["_id"], doc["data_ent"]) == ("2501", "01-01-2025")


def test_missing_id_and_name_reject(frame):
    df = frame("ID nome", [("2501", ""), (None, "a"), ("", "a"), ("2502", None)])
    assert reasons(df) == [[], ["id_missing"], ["id_missing"], ["nome_missing"]]


def test_underscore_id_wins(frame):
    df = frame("ID _id nome", [("2501", "9901", "a"), ("2502", None, "a")])
    assert [r.ID for r in validate(df).orderBy("row_idx").collect()] == ["9901", "2502"]


def test_absent_optional_columns_are_null(frame):
    row = validate(frame("ID", ["2501"])).first()
    assert row.reasons == [] and row.nome == "" and row.processo is None and row.data_ent is None


def test_bad_sex_and_date_are_warnings(frame):
    row = validate(frame("ID nome sexo data_ent", [("2501", "a", "X", "not-a-date")])).first()
    assert row.reasons == [] and row.sexo is None and row.data_ent is None
    assert row.warnings == ["data_ent_unreadable", "sexo_unreadable"]


def test_record_number(frame):
    texts = ["123", "12-3", "1 2", "12a", "12.0", "", None]
    df = frame("ID nome processo", [("2501", "a", t) for t in texts])
    bad = ["processo_invalid"]
    assert reasons(df) == [[], bad, bad, bad, [], bad, []]
    assert reasons(df, blank_as_null=True) == [[], bad, bad, bad, [], [], []]
    cleaned = [r.processo for r in validate(df, clean_digits=True).orderBy("row_idx").collect()]
    assert cleaned == [123, 123, 12, 12, 12, None, None]
    assert reasons(df, clean_digits=True) == [[]] * 7


def test_counts_and_repeated_ids(frame):
    rows = [("2501", "a", "1"), ("2501", "b", "2"), ("2401", "c", "3"), (None, "d", "4"), ("2502", "e", "bad"), ("2503", None, "5")]
    job = validate_table(frame("ID nome processo", rows), "25")
    c = job.counts.first()
    assert (c.total, c.skipped, c.filtered, c.processed, c.errors) == (6, 3, 3, 2, 1)
    assert job.written.first().written == 1
    assert (job.rejected.count(), job.skipped.count()) == (c.errors, c.skipped)


def test_year_range_is_lenient(frame):
    df = frame("ID nome", [("2501", "a"), ("x", "b")])
    assert [r.in_filter for r in validate(df, parse_year_filter("oops")).orderBy("row_idx").collect()] == [True, True]
    assert [r.in_filter for r in validate(df, parse_year_filter("25")).orderBy("row_idx").collect()] == [True, False]


def test_three_row_file(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text(CSV, encoding="utf-8")
    job = csv_to_documents(spark, str(path))
    out = job.write(str(tmp_path / "docs"))
    docs = {r["_id"]: r for r in spark.read.json(out).collect()}
    assert set(docs) == {"2501", "2502", "2401"} and docs["2401"]["processo"] == 12347
    c = job.counts.first()
    assert (c.processed, c.errors) == (3, 0)
    assert json.loads(csv_to_documents(spark, str(path), "24").preview())["_id"] == "2401"
    assert csv_to_documents(spark, str(path), "19").preview() == "Unable to generate preview"


def test_empty_and_absent_cells_of_a_file(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text("ID,nome,processo,destino\n2501\n2502,,1,\n2503,Ana,,Home\n2504,Rui,7\n", encoding="utf-8")
    rows = {r.ID: r for r in csv_to_documents(spark, str(path)).validated.collect()}
    assert rows["2501"].reasons == ["nome_missing"]
    assert (rows["2502"].reasons, rows["2502"].nome, rows["2502"].destino) == ([], "", "")
    assert rows["2503"].reasons == ["processo_invalid"]
    assert (rows["2504"].reasons, rows["2504"].destino) == ([], None)
    relaxed = {r.ID: r.reasons for r in csv_to_documents(spark, str(path), blank_as_null=True).validated.collect()}
    assert relaxed["2503"] == []


def test_no_row_is_lost(frame):
    rows = [(str(2500 + i) if i % 7 else None, "n" if i % 5 else None, str(i) if i % 3 else "x") for i in range(200)]
    job = validate_table(frame("ID nome processo", rows))
    assert job.patients.count() + job.rejected.count() + job.skipped.count() == 200
    assert job.rejected.filter(F.size("reasons") == 0).count() == 0
