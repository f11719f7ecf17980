import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sparkfolio import get_spark

    session = get_spark("tests", "local[4]", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame):
    """Rows of a pandas frame with columns by name, comparable whatever the engine."""
    import pandas as pd

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows():
    return lambda a, b: rows_of(a) == rows_of(b)
