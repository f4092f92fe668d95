import os

import pytest

import __spark_entry__ as entry
from gneiss.plans import data_queries, graph_queries, projection_queries, tool_queries
from tests.oracle import FOLDER, differing

CORE = [(m, n) for m in (data_queries, graph_queries, projection_queries, tool_queries) for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", [n for m, n in CORE if n in m.SQL])
def test_query_equals_its_sql(spark, name):
    assert differing(spark, entry.queries()[name], entry.oracle_sql()[name]) == ([], [])


def test_entry_and_the_rest(spark):
    assert entry.entry(spark).columns == ["snapshot_key", "symbol_key", "root_key"]
    for module, name in CORE:
        if name not in module.SQL:
            assert entry.queries()[name](spark, FOLDER).count() > 0
