"""Every registered query that has SQL, against that SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck, type_difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    assert type_difference(df, con, SQL[name]) is None
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["topic_id", "doc_id", "rank", "score"]
