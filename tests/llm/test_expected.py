"""The queries of the subpackage against their SQL twins."""

import os
from pathlib import Path

import pytest

from compare import compare, connect
from joeira.llm.expected import EXPECTED_SQL
from joeira.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(EXPECTED_SQL))
def test_equals_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], EXPECTED_SQL[name], SF_DIR) is None
