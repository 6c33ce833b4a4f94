"""Every query of the core against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from oracle import compare, connect
from regloom import queries, queries_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
SQL = queries_sql.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    query = queries.queries()[name]
    if name in SQL:
        assert compare(spark, con, query, SQL[name], SF) == ""
    else:
        assert query(spark, SF).count() > 0


def test_every_query_but_the_similarity_has_sql():
    assert set(queries.queries()) - set(SQL) == {"hybrid_best_match", "gap_assessment_full"}
