"""Jobs as they are called from a shell."""

import pytest

from joeira.jobs import documents, quality
from joeira.sinks.documents import read_documents

CSV = """ID,processo,nome,data_ent,data_alta,destino,sexo,data_nasc,origem
2501,1,Ana,1-1-2025,5-1-2025,Home,M,1-1-1980,ER
2402,2,Rui,3-1-2024,4-1-2024,Ward,F,1-1-2000,ER
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path), str(tmp_path / "out")


def test_quality_job(spark, csv, tmp_path):
    path, out = csv
    assert quality.main(["--file", path, "--year", "25", "--as-of", "2025-06-30", "--out", out, "--reuse"]) == 0
    assert spark.read.parquet(f"{out}/findings").count() > 50
    report = next((tmp_path / "out").glob("report_*.md"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(report.glob("part-*")))
    assert "**Records:** 1 of 2 total (50.0%)" in text and "- **File Name:** patients.csv" in text
    assert quality.main(["-f", path, "-y", "19", "-o", out]) == 1
    assert quality.main(["-f", path + ".none", "-o", out]) == 1


def test_nothing_is_left_in_the_shared_folder(spark, csv, tmp_path, monkeypatch):
    from joeira import session
    from joeira.plans.quality import QualityResult

    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(shared))
    path, out = csv
    assert quality.main(["-f", path, "-y", "19", "-o", out, "--reuse"]) == 1
    assert list(shared.iterdir()) == []
    monkeypatch.setattr(QualityResult, "report", lambda *a: 1 / 0)
    assert quality.main(["-f", path, "-o", out, "--reuse"]) == 1
    assert list(shared.iterdir()) == []


def test_documents_job(spark, csv):
    path, out = csv
    assert documents.main(["-f", path, "-y", "24-25", "-o", out, "--by-year"]) == 0
    assert {r.year for r in spark.read.json(out).select("year").distinct().collect()} == {24, 25}
    assert documents.main(["-f", path, "-y", "19", "-o", out]) == 1


def test_documents_of_one_year_after_the_other(spark, csv):
    path, out = csv
    for year in ("24", "25", "24"):
        assert documents.main(["-f", path, "-y", year, "-o", out]) == 0
    assert sorted(r._id for r in read_documents(spark, out).collect()) == ["2402", "2501"]


def test_reuse_needs_a_shared_folder(spark, csv, monkeypatch):
    from joeira import session
    from joeira.plans.quality import run_quality_csv

    monkeypatch.setattr(session, "shared_dir", lambda spark: None)
    with pytest.raises(ValueError, match="shared folder"):
        run_quality_csv(spark, csv[0], reuse=True)
