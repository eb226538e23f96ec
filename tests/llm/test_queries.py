import pytest

from bitsieve.llm import queries
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, small_dir, con, name):
    only_spark, only_sql = differences(queries.QUERIES[name](spark, small_dir), con, queries.SQL[name])
    assert not only_spark and not only_sql
