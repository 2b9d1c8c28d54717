import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from joeira.operators.validation import accepted, validate
from joeira.sinks import documents, files
from joeira.sinks.documents import latest_per_id, read_documents, to_json_text, write_documents
from joeira.sinks.tables import padded, safe_name, write_table


def lines(folder):
    return [x for f in sorted(Path(folder).rglob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_tables_come_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([("0025", 'a "b", c'), ("2501", None)], "ID string, v string")
    path = write_table(df, str(tmp_path), "Ward A/1", fmt.upper())
    assert path.endswith(f"Ward_A_1.{fmt}")
    reader = spark.read.schema(df.schema)
    back = reader.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else getattr(reader, fmt)(path)
    assert {tuple(r) for r in back.collect()} == {("0025", 'a "b", c'), ("2501", None)}


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", None)], "ID string, v string")
    assert lines(write_table(df, str(tmp_path), "s", "json")) == ['{"ID":"1","v":null}']


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="csv, json, parquet"):
        write_table(spark.range(1), str(tmp_path), "s", "excel")


def test_padding_touches_only_the_id(frame):
    df = padded(frame("ID PID", [("25", "25")]))
    assert df.first()[1:] == ("0025", "25")
    other = frame("PID", ["25"])
    assert padded(other) is other


def test_safe_name_agrees_with_the_column_rule():
    assert safe_name("a b/c") == "a_b_c"


def patient_rows(frame):
    rows = [("2501", "Ana", "1", "1-1-2025", "M"), ("2501", "João", "2", "2-1-2025", "F"), ("2601", "Rui", None, "x", "?")]
    return accepted(validate(frame("ID nome processo data_ent sexo", rows)))


def test_document_text(frame):
    row = patient_rows(frame).filter("ID = '2601'").select(to_json_text().alias("j")).first()
    expected = {"_id": "2601", "processo": None, "nome": "Rui", "data_ent": None, "data_alta": None, "destino": None, "sexo": None, "data_nasc": None, "origem": None}
    assert json.loads(row.j) == expected and list(json.loads(row.j)) == list(expected)


def test_last_row_of_an_id_wins(frame):
    df = latest_per_id(patient_rows(frame))
    assert {r.ID: r.nome for r in df.collect()} == {"2501": "João", "2601": "Rui"}


def test_documents_are_ascii_json(frame, tmp_path):
    found = lines(write_documents(patient_rows(frame), str(tmp_path / "docs")))
    assert len(found) == 2 and all(x.isascii() for x in found)
    docs = {json.loads(x)["_id"]: json.loads(x) for x in found}
    assert docs["2501"]["nome"] == "João" and docs["2501"]["data_ent"] == "02-01-2025"
    assert docs["2601"]["processo"] is None


def test_documents_by_year(frame, tmp_path, spark):
    write_documents(patient_rows(frame), str(tmp_path / "docs"), by_year=True)
    assert sorted(p.name for p in (tmp_path / "docs").glob("year=*")) == ["year=25", "year=26"]
    assert spark.read.json(str(tmp_path / "docs")).filter(F.col("year") == 25).count() == 1


def stored(spark, folder):
    return sorted(map(tuple, read_documents(spark, str(folder)).select("_id", "nome", "processo").collect()))


def rows_of(frame, *rows):
    return accepted(validate(frame("ID nome processo data_ent sexo", [(i, n, p, "1-1-2025", "M") for i, n, p in rows])))


@pytest.mark.parametrize("by_year", [False, True])
def test_documents_of_earlier_runs_stay(frame, tmp_path, spark, by_year):
    out = tmp_path / "docs"
    assert stored(spark, out) == []
    many = [(f"24{k:02}", f"n{k}", str(k)) for k in range(60)]
    write_documents(rows_of(frame, *many), str(out), by_year)
    write_documents(rows_of(frame, ("2501", "João", "1"), ("2502", "Rui", None)), str(out) + "/", by_year)
    kept = [(i, n, int(p)) for i, n, p in many]
    assert stored(spark, out) == sorted(kept + [("2501", "João", 1), ("2502", "Rui", None)])
    # A rerun replaces its own IDs, the last row of each, and nothing else.
    write_documents(rows_of(frame, ("2403", "old", "7"), ("2403", "new", "8"), ("/=x", "odd", "9")), str(out), by_year)
    write_documents(rows_of(frame, ("/=x", "odd", "10"), ("/=y", "odd", "9")), str(out), by_year)
    want = [k if k[0] != "2403" else ("2403", "new", 8) for k in kept] + [("2501", "João", 1), ("2502", "Rui", None), ("/=x", "odd", 10), ("/=y", "odd", 9)]
    assert stored(spark, out) == sorted(want)
    # Nothing of replaced buckets is left, so a plain read sees the same.
    assert spark.read.json(str(out)).count() == len(want) and all(x.isascii() for x in lines(out))
    with pytest.raises(ValueError, match="by year"):
        write_documents(rows_of(frame, ("1", "a", "1")), str(out), not by_year)


def test_only_met_buckets_are_written_again(frame, tmp_path, spark):
    out = tmp_path / "docs"
    write_documents(rows_of(frame, *[(f"24{k:02}", "a", "1") for k in range(80)]), str(out), buckets=8)
    before = {p.parent.name: p.name for p in out.glob("bucket=*/run=*")}
    write_documents(rows_of(frame, ("2405", "b", "2")), str(out), buckets=3)  # the first run's number holds
    after = {p.parent.name: p.name for p in out.glob("bucket=*/run=*")}
    assert len(before) == len(after) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_a_run_that_is_cut_off_leaves_the_former_state(frame, tmp_path, spark, monkeypatch):
    out = tmp_path / "docs"
    write_documents(rows_of(frame, ("2401", "a", "1"), ("2402", "b", "2")), str(out))
    former = stored(spark, out)
    broken = rows_of(frame, ("2401", "x", "3"), ("2501", "y", "4")).withColumn("nome", F.when(F.col("ID") == "2501", F.raise_error(F.lit("lost"))).otherwise(F.col("nome")))
    with pytest.raises(Exception, match="lost"):
        write_documents(broken, str(out))
    assert stored(spark, out) == former
    # Killed after the write, before the swap: new folders lie beside the old ones, which stay current.
    with monkeypatch.context() as m:
        m.setattr(documents.Manifest, "write", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        m.setattr(files.Store, "delete", lambda *a: None)
        with pytest.raises(KeyboardInterrupt):
            write_documents(rows_of(frame, ("2401", "x", "3")), str(out))
    assert stored(spark, out) == former and spark.read.json(str(out)).count() > 2
    write_documents(rows_of(frame, ("2403", "c", "3")), str(out))
    assert stored(spark, out) == sorted([*former, ("2403", "c", 3)]) and spark.read.json(str(out)).count() == 3


def test_two_runs_at_once(frame, tmp_path, spark, monkeypatch):
    out = tmp_path / "docs"
    write_documents(rows_of(frame, ("2401", "a", "1")), str(out))
    real, seen = documents.Manifest.read.__func__, []

    def read(store, folder):
        seen.append(1)
        if len(seen) == 2:  # another run ends while this one writes
            found = real(documents.Manifest, store, folder)
            documents.Manifest(found.buckets, found.by_year, {}).write(store, folder)
        return real(documents.Manifest, store, folder)

    monkeypatch.setattr(documents.Manifest, "read", read)
    with pytest.raises(RuntimeError, match="another run"):
        write_documents(rows_of(frame, ("2402", "b", "2")), str(out))


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_a_failed_write_leaves_the_former_table(spark, tmp_path, fmt):
    path = write_table(spark.createDataFrame([("1", "a")], "ID string, v string"), str(tmp_path), "s", fmt)
    broken = spark.range(0, 100, 1, 10).select(F.when(F.col("id") == 77, F.raise_error(F.lit("halfway")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="halfway"):
        write_table(broken, str(tmp_path), "s", fmt)
    reader = spark.read.schema("ID string, v string")
    back = reader.option("header", "true").csv(path) if fmt == "csv" else getattr(reader, fmt)(path)
    assert [tuple(r) for r in back.collect()] == [("1", "a")]
    assert [p.name for p in tmp_path.iterdir()] == [f"s.{fmt}"]
    write_table(spark.createDataFrame([("2", "b")], "ID string, v string"), str(tmp_path), "s", fmt)
    assert [p.name for p in tmp_path.iterdir()] == [f"s.{fmt}"] and "2" in "".join(map(str, spark.read.format(fmt).load(path).collect()))


def test_a_table_moved_aside_is_brought_back(spark, tmp_path):
    path = write_table(spark.createDataFrame([("1",)], "ID string"), str(tmp_path), "s", "parquet")
    (tmp_path / "s.parquet").rename(tmp_path / "_s.parquet.former-1")
    files.restore(spark, path)
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "s.parquet").rename(tmp_path / "_s.parquet.former-2")
    with pytest.raises(ValueError):
        files.replace(spark, path, lambda staged: (_ for _ in ()).throw(ValueError()))
    assert spark.read.parquet(path).count() == 1
