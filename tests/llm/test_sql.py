import pytest
from oracle import compare, connect

from tidemark.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, D, name, QUERIES[name], ORACLE_SQL[name]) > 0
