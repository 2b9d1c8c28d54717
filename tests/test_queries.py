"""Every registered query against its SQL twin, and every query runs."""

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from expected_sql import EXPECTED_SQL
from joeira.operators.profile import table_profile
from joeira.plans.catalogue import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(EXPECTED_SQL))
def test_equals_sql(spark, duck, name):
    assert compare(spark, duck, queries()[name], oracle_sql()[name], SF_DIR) is None


def test_names_match():
    assert set(QUERIES) == set(EXPECTED_SQL)
    assert set(QUERIES) <= set(queries()) and set(EXPECTED_SQL) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["column", "check", "metric", "value"] and df.count() > 50


def test_profile_of_the_tables(spark):
    for name in ("orders", "documents"):
        r = table_profile(spark.read.parquet(f"{SF_DIR}/{name}.parquet"), name).first()
        assert r.file_size_kb == round(Path(SF_DIR, f"{name}.parquet").stat().st_size / 1024, 2)
        assert r.file_path.endswith(f"{SF_DIR}/{name}.parquet")


def test_views_are_dropped(spark):
    queries()["catalog_lookup"](spark, SF_DIR).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("joeira_")]
