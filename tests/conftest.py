import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ["CELLWEAVE_SHUFFLE_PARTITIONS"] = "4"
    session = build_session("tests", 8, spark__driver__memory="6g")
    yield session
    session.stop()


@pytest.fixture
def grid_of(spark):
    """Turn a dense list of rows into a cell table."""

    def make(rows, name="v"):
        data = [(r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)]
        return spark.createDataFrame(data, f"row bigint, col bigint, {name} double")

    return make


@pytest.fixture
def dense():
    """Turn a cell table back into a dict (row, col) -> value."""

    def read(df, name):
        return {(r["row"], r["col"]): r[name] for r in df.collect()}

    return read
