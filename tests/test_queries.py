import pytest

from plyforge.plans import queries as core
from tests.compare import connect, same

SQL, QUERIES = core.oracle_sql(), core.queries()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, con, name):
    got, want = same(QUERIES[name](spark, small), con, SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0
