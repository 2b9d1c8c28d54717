"""Line breaks inside quoted cells: files cut into many splits against one task for the whole file."""

import random

import pytest

from joeira.sources import quoted, rownum
from joeira.sources.text import read_patient_csv, read_quality_csv

NAMES = ["ID", "nome", "destino"]


def content(seed: int, n: int, end: str) -> str:
    rnd = random.Random(seed)
    odd = ["plain", "two\nlines", 'a "word"', "crlf\r\ninside", "\n", "\n\n\n", "é日本", 'x"\n"y', ",", "", "long " * 30, '"', "line\n" * 12]

    def cell():
        text = rnd.choice(odd) + rnd.choice(odd)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') or rnd.random() < 0.3 else text

    rows = ['ID,"nome",destino']
    for k in range(n):
        rows.append(f"{k},{cell()},{cell()}" + (",more" if k % 17 == 5 else ""))
        if k % 11 == 3:
            rows.append("")
        if k % 19 == 4:
            rows.append(f"{k}")
    return end.join(rows)


@pytest.fixture
def splits(spark):
    """Files are cut into splits of so many bytes."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def one_task(spark, path):
    schema = "ID string, nome string, destino string, _corrupt_record string"
    reader = spark.read.options(header="true", escape='"', multiLine="true", columnNameOfCorruptRecord="_corrupt_record", columnPruning="false", enforceSchema="false")
    return [tuple(r)[:3] for r in reader.schema(schema).csv(path).collect()]


@pytest.mark.parametrize("seed, end, size", [(1, "\n", 200), (2, "\r\n", 333), (3, "\n", 40), (4, "\r\n", 1 << 20)])
def test_many_splits_equal_one_task(spark, tmp_path, splits, seed, end, size):
    for name, n in (("a.csv", 60), ("b.csv", 1), ("c.csv", 25)):
        (tmp_path / name).write_bytes((content(seed + n, n, end) + (end if n == 60 else "")).encode())
    (tmp_path / "d.csv").write_bytes(b"ID,nome,destino")
    want = [row for name in "abcd" for row in one_task(spark, str(tmp_path / f"{name}.csv"))]
    splits(size)
    df = read_patient_csv(spark, str(tmp_path), multiline=True)
    assert df.columns == ["row_idx", *NAMES, "_corrupt_record"]
    got = sorted(df.collect())
    assert [r.row_idx for r in got] == list(range(len(want)))
    assert [tuple(r)[1:4] for r in got] == want
    wrong = {r.ID for r in got if r._corrupt_record is not None}
    assert wrong == {r.ID for r in got if r.ID and int(r.ID) % 17 == 5} | {r.ID for r in got if r.ID and int(r.ID) % 19 == 4}
    plain = read_quality_csv(spark, str(tmp_path), na_tokens=(), multiline=True, numbered=False)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(want, key=str)


def test_a_cell_over_many_splits(spark, tmp_path, splits):
    long = "\n".join(f"line {k}" for k in range(400))
    (tmp_path / "a.csv").write_text(f'ID,nome,destino\n1,"{long}",x\n2,b,c\n3,"{long}\n","{long}"', encoding="utf-8")
    splits(100)
    df = read_quality_csv(spark, str(tmp_path), na_tokens=(), multiline=True)
    assert df.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, df.collect())) == [(0, "1", long, "x"), (1, "2", "b", "c"), (2, "3", long + "\n", long)]


def test_more_splits_than_may_be_broadcast(spark, tmp_path, splits, monkeypatch):
    (tmp_path / "a.csv").write_text(content(9, 80, "\n"), encoding="utf-8")
    want = one_task(spark, str(tmp_path / "a.csv"))
    splits(150)
    monkeypatch.setattr(rownum, "BROADCAST_SPLITS", 3)
    assert [tuple(r)[1:4] for r in sorted(read_patient_csv(spark, str(tmp_path), multiline=True).collect())] == want


def test_batches_of_any_size(spark, tmp_path):
    (tmp_path / "a.csv").write_text(content(5, 70, "\n"), encoding="utf-8")
    want = one_task(spark, str(tmp_path / "a.csv"))
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert [tuple(r)[1:4] for r in sorted(read_patient_csv(spark, str(tmp_path), multiline=True).collect())] == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,nome,destino\n", encoding="utf-8")
    assert read_patient_csv(spark, str(tmp_path), multiline=True).count() == 0
    assert quoted.records(spark, str(tmp_path)).columns == ["row_idx", "record"]
