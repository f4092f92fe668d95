import os

import pytest

import __spark_entry__ as entry
from gneiss.llm import queries
from tests.oracle import FOLDER, differing

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = {"p1_found": ["file_id"], "p5_found": ["snapshot_key", "category", "target_key"], "p6_found": ["file_id"], "p7_found": ["file_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    run = entry.queries()[name]
    if name in queries.SQL:
        assert differing(spark, run, queries.SQL[name]) == ([], [])
    df = run(spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
