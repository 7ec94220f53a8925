"""The registered queries of the subpackage on the smallest tables."""

import os

import duckdb
import pytest

from pairlink.llm import queries as q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")

COLUMNS = {"p1_found": ["rec_id", "group_id"], "p2_found": ["entry_id_1", "entry_id_2"], "p3_found": ["id_a", "id_b"], "p5_found": ["addr_id_1", "addr_id_2"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", list(q.queries()))
def test_query(spark, name):
    # where the SQL measures texts by words, the smallest tables hold too few of them to tell what falls short
    folder = FOLDER.replace("sf0.001", "sf0.01") if name in ("p7_found", "p7_kept") else FOLDER
    df = q.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and rows and len(set(rows)) == len(rows)
        if name in ("p2_found", "p5_found"):
            assert all(a < b for a, b in rows)
    if name in q.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(folder):
            con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
        assert sorted(rows) == sorted(con.execute(q.oracle_sql()[name]).fetchall())
