from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from joeira.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local(4, memory="4g", partitions=4)
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of text values with ``row_idx`` in the given order."""

    def build(columns: str, rows: list):
        names = columns.split()
        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        schema = ", ".join(["row_idx bigint", *[f"{n} string" for n in names]])
        return spark.createDataFrame(data, schema)

    return build
