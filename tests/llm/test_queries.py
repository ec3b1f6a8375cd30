import pytest

from plyforge.llm import queries as llm
from tests.compare import connect, same

SQL, QUERIES = llm.oracle_sql(), llm.queries()
#: Columns that the statement fixes.
FIXED = {
    "p2_found": ["position_id_a", "position_id_b"],
    "p3_found": ["keep_id", "copy_id"],
    "p5_found": ["network_sha256", "rank_no"],
    "p6_found": ["position_id", "family_id"],
    "p7_found": ["doc_id"],
    "p8_found": ["source"],
    "p9_found": ["doc_id", "unbreakable"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    got, want = same(QUERIES[name](spark, small), connect(small), SQL[name])
    assert got == want and (got or name == "p5_check")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(FIXED))
def test_fixed_columns(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns == FIXED[name]
    assert all(t == ("string" if c in ("network_sha256", "source") else "bigint") for c, t in df.dtypes)
