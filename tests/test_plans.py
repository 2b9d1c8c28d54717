"""What the physical plans must and must not contain."""

from pathlib import Path

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_products(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "FlatMapGroups"):
        assert bad not in text, bad


@pytest.mark.parametrize("name, columns", [
    ("duplicate_ids", {"o_orderkey", "o_orderdate"}),
    ("year_consistency", {"o_orderkey", "o_orderdate"}),
    ("value_frequency_destino", {"o_orderpriority"}),
    ("processo_invalid", {"o_orderkey", "o_custkey"}),
])
def test_scans_read_only_what_they_need(spark, name, columns):
    text = plan(queries()[name](spark, SF_DIR))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas
    for line in schemas:
        assert {c.split(":")[0] for c in line.split("<")[1].rstrip(">").split(",")} == columns
    assert "customer.parquet" not in text


@pytest.mark.parametrize("name", ["check_examples", "latest_per_id", "long_stays", "first_duplicates", "missing_serials_preview"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["issues", "missing_rows", "validated_patients", "patient_json", "parsed_dates", "id_parts"])
def test_row_outputs_do_not_shuffle(spark, name):
    assert "Exchange hashpartitioning" not in plan(queries()[name](spark, SF_DIR))


def test_checks_are_counted_in_one_scan(spark):
    text = plan(queries()["date_format_check"](spark, SF_DIR))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderpriority), Not(EqualTo(o_orderpriority,))]" in plan(queries()["value_frequency_destino"](spark, SF_DIR))
