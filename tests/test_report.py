import datetime as dt
from pathlib import Path

from joeira.plans.quality import run_quality, run_quality_csv
from joeira.sinks.reports import write_report

WHEN = dt.datetime(2025, 6, 30, 14, 5)


def texts(q, name="patients"):
    return [r.text for r in q.report(name, WHEN).collect()]


def test_report_of_a_file(spark, tmp_path):
    path = tmp_path / "patients.csv"
    path.write_text(
        "ID,processo,nome,data_ent,data_alta,destino,sexo,data_nasc,origem\n"
        "2501,1,Ana,1-1-2025,5-1-2025,Home,M,1-1-1980,ER\n"
        "2501,x,,1/1/2025,,Home,f,1-1-1890,ER\n"
        ",2,Rui,3-1-2025,1-1-2025,Ward,F,1-1-2030,\n"
        "2504,3,Eva,3-1-2025,4-1-2025,Home,F,1-1-2000,ER\n",
        encoding="utf-8",
    )
    q = run_quality_csv(spark, str(path), "2025-06-30")
    lines = texts(q, str(path))
    for expected in (
        "# Quality Control Report - 2025-06-30 14:05",
        f"**File:** {path}",
        "**Scope:** Full database (no filters applied)",
        "- **File Name:** patients.csv",
        "- **Total Rows:** 4",
        "- **Total Columns:** 9",
        "- **Missing IDs:** 1 (25.00%)",
        "  - Examples: Rows 4",
        "- **Duplicate IDs:** 2 (50.00%)",
        "  - ID '2501' in row 2",
        "  - ID '2501' in row 3",
        "| 25 | 3 | 1 | 4 | 2 |",
        "- All IDs follow the expected pattern.",
        "- **Invalid Date Formats:** 1",
        "  - ID '2501' has date '1/1/2025'",
        "- **Chronology Errors:** 1",
        "- **Unusually Old Dates:** 1",
        "- **Future Dates:** 1",
        "- Mean Age: 35.0",
        "- Min Age: 25",
        "- **Invalid Values:** 1 (25.00%)",
        "- Home: 3 (75.00%)",
        "- Ward: 1 (25.00%)",
        "**Unexpected Values:** 1 (25.00%)",
        "  - ID '2501' has value 'f'",
    ):
        assert expected in lines, expected
    titles = [t for t in lines if t.startswith("## ")]
    assert titles == [f"## {t} Analysis" for t in ("File", "ID", "Admission Date", "Discharge Date", "Birth Date", "Processo", "Nome", "Sexo", "Destino", "Origem")]

    out = Path(write_report(q.report(str(path), WHEN), str(tmp_path), WHEN))
    assert out.name == "report_quality_gsheet_20250630_1405.md"
    parts = sorted(out.glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text(encoding="utf-8").splitlines() == lines


def test_filter_line_and_absent_columns(frame):
    q = run_quality(frame("ID sexo", [("2501", "M"), ("2401", "F"), ("2301", "M")]), "2025-06-30", "25-24")
    lines = texts(q)
    assert "**Filter:** Showing records from years 2025 to 2024" in lines
    assert "**Records:** 2 of 3 total (66.7%)" in lines
    assert [t for t in lines if t.startswith("## ")] == ["## File Analysis", "## ID Analysis", "## Sexo Analysis"]
    assert "- **Duplicate IDs:** None" in lines


def scans(q) -> int:
    """File scans that ran; shuffles that were used again do not count."""
    df = q.report("x", WHEN)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_report_reads_the_rows_five_times(spark, tmp_path):
    rows = [(k, f"25{k % 40:02d}", "1", "n", "1-1-2025", "3-1-2025", "H", "M", "1-1-1980", "E") for k in range(200)]
    names = "row_idx int, ID string, processo string, nome string, data_ent string, data_alta string, destino string, sexo string, data_nasc string, origem string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "p"))
    q = run_quality(spark.read.parquet(str(tmp_path / "p")), "2025-06-30")
    assert scans(q) <= 5


def test_repeated_bad_ids_show_their_first_row(frame):
    q = run_quality(frame("ID", ["2501", "x", "2502", "x", "x"]), "2025-06-30")
    bad = [r.text for r in q.report("x", WHEN).filter("section = 2 AND part = 11").collect()]
    assert bad == ["  - ID 'x' in row 3"] * 3
    assert [r.row_idx for r in q.examples.filter("check = 'id_pattern'").collect()] == [1, 1, 1]
