import pytest

from joeira.operators.tracking import read_history
from joeira.plans.sheets import import_all, import_sheet, pending_change


@pytest.fixture
def folders(tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "Ward A.csv").write_text("ID,nome\n25,Ana\n2501,Rui\n", encoding="utf-8")
    (landing / "Empty.csv").write_text("ID,nome\n", encoding="utf-8")
    return landing, str(tmp_path / "out"), str(tmp_path / "history")


def test_import_and_change_check(spark, folders):
    landing, out, history = folders
    first = pending_change(spark, str(landing), "Ward A", history).first()
    assert (first.first_time, first.content_changed) == (True, False)

    path = import_sheet(spark, str(landing), "Ward A", out, history)
    assert sorted(r.ID for r in spark.read.option("header", "true").csv(path).collect()) == ["0025", "2501"]
    same = pending_change(spark, str(landing), "Ward A", history).first()
    assert (same.first_time, same.content_changed, same.row_delta) == (False, False, 0)

    (landing / "Ward A.csv").write_text("ID,nome\n25,Ana\n2501,Rui\n2502,Eva\n", encoding="utf-8")
    changed = pending_change(spark, str(landing), "Ward A", history).first()
    assert (changed.content_changed, changed.row_delta) == (True, 1)
    import_sheet(spark, str(landing), "Ward A", out, history)
    revisions = [int(r.revision_id) for r in read_history(spark, history).orderBy("download_time").collect()]
    assert revisions[1] == revisions[0] + 1


def test_import_all(spark, folders):
    landing, out, history = folders
    status = {r.sheet_name: (r.status, r.path) for r in import_all(spark, str(landing), out, history, "json").collect()}
    assert status["Empty"] == ("ok", None)
    assert status["Ward A"][0] == "ok" and status["Ward A"][1].endswith("Ward_A.json")
    assert read_history(spark, history).count() == 1
    assert not pending_change(spark, str(landing), "Ward A", history).first().first_time
    with pytest.raises(ValueError):
        import_all(spark, str(landing), out, history, "excel")


def _stored(spark, path, fmt):
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    return sorted(r.ID for r in reader.format(fmt).load(path).collect())


def test_sheets_with_equal_safe_names_are_all_kept(spark, tmp_path):
    landing, out, history = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "history")
    landing.mkdir()
    (landing / "A B.csv").write_text("ID\n1001\n")
    (landing / "A_B.csv").write_text("ID\n2001\n2002\n")
    (landing / "A B.json").write_text('{"ID": "3001"}\n')
    for _ in range(2):
        rows = import_all(spark, str(landing), out, history).collect()
        assert [r.status for r in rows] == ["ok"] * 3 and len({r.path for r in rows}) == 3
    stored = {r.sheet_name: [] for r in rows}
    for r in rows:
        stored[r.sheet_name].append(_stored(spark, r.path, "csv"))
    assert sorted(stored["A B"]) == [["1001"], ["3001"]] and stored["A_B"] == [["2001", "2002"]]
    known = read_history(spark, history).collect()
    assert len({r.source_id for r in known}) == 3 and len(known) == 6
    assert sorted(r.sheet_name for r in known) == ["A B"] * 4 + ["A_B"] * 2
    assert all(len({r.revision_id for r in known if r.source_id == s}) == 1 for s in {r.source_id for r in known})
    with pytest.raises(ValueError, match="2 sheets"):
        import_sheet(spark, str(landing), "A B", out, history)
    one = import_sheet(spark, str(landing), "A B", out, history, sheet_format="json")
    assert one in {r.path for r in rows} and not pending_change(spark, str(landing), "A B", history, "json").first().content_changed


def test_any_way_to_name_the_folder(spark, folders, monkeypatch):
    from joeira.sources.landing import list_sheets

    landing, *_ = folders
    want = [tuple(r) for r in list_sheets(spark, str(landing)).collect()]
    assert [r[0] for r in want] == ["Empty", "Ward A"]
    root = str(landing.parent)
    for form in (f"{root}/./landing", f"{root}/x/../landing/", f"{root}/land*", f"{root}/landing/*.csv", f"file:{root}/landing"):
        assert [tuple(r) for r in list_sheets(spark, form).collect()] == want
    with pytest.raises(FileNotFoundError):
        list_sheets(spark, f"{root}/nowhere")


def test_errors_are_told_whole(spark, folders):
    landing, out, history = folders
    (landing / "Bad.parquet").write_text("x" * 700)
    status = {r.sheet_name: r for r in import_all(spark, str(landing), out, history).collect()}
    assert status["Bad"].status == "failed" and "Bad.parquet" in status["Bad"].error and status["Ward A"].status == "ok"


def test_a_later_sheet_of_the_same_safe_name_changes_no_history(spark, tmp_path):
    landing, out, history = tmp_path / "land", tmp_path / "out", str(tmp_path / "history")
    landing.mkdir()
    (landing / "A B.csv").write_text("ID\n1001\n")
    first = import_sheet(spark, str(landing), "A B", str(out), history)
    (landing / "A_B.csv").write_text("ID\n2001\n2002\n")
    assert not pending_change(spark, str(landing), "A B", history).first().first_time
    assert pending_change(spark, str(landing), "A_B", history).first().first_time
    for _ in range(2):
        paths = {r.sheet_name: r.path for r in import_all(spark, str(landing), str(out), history).collect()}
    assert paths["A B"] == first and paths["A_B"] != first
    assert _stored(spark, paths["A B"], "csv") == ["1001"] and _stored(spark, paths["A_B"], "csv") == ["2001", "2002"]
    assert len(list(out.iterdir())) == 2  # nothing is left over
    entries = read_history(spark, history).collect()
    assert {r.sheet_name: sorted({e.source_id for e in entries if e.sheet_name == r.sheet_name}) for r in entries} == {"A B": ["A_B"], "A_B": [paths["A_B"].split("/")[-1][:-4]]}
    assert len({e.revision_id for e in entries if e.sheet_name == "A B"}) == 1
    # A sheet that goes away keeps its name, and comes back to it.
    (landing / "A B.csv").unlink()
    assert import_sheet(spark, str(landing), "A_B", str(out), history) == paths["A_B"]
    (landing / "A B.csv").write_text("ID\n1001\n")
    assert import_sheet(spark, str(landing), "A B", str(out), history) == first
