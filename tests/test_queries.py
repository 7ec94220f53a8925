"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlink import catalogue  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = os.path.join(FOLDER, name)
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def shown(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    df = df.map(lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, FOLDER)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
    else:
        pd.testing.assert_frame_equal(shown(got.toPandas()), shown(con.execute(sql).df()), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
