"""Queries of the package on the smallest tables, against SQL where there is some."""

from pathlib import Path

import pytest

from oracle import compare, connect
from regloom.llm import queries, sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    query = queries.queries()[name]
    if name in sql.oracle_sql():
        assert compare(spark, con, query, sql.oracle_sql()[name], SF) == ""
    else:
        rows = query(spark, SF).collect()
        assert rows or name == "p9_found"  # 9 labels, none of them of a list, a table or junk that is seen twice
        if name.endswith("_found"):
            assert len(set(rows)) == len(rows)
