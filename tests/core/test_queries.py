import pytest

from concordia.queries import registered
from tests import compare


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.skipif(not compare.available(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in registered().items() if sql])
def test_query_equals_its_sql(spark, con, name):
    query, sql = registered()[name]
    assert compare.differences(spark, con, query, sql) is None


def test_entry_has_a_schema_and_every_name_an_operator():
    import __spark_entry__ as e

    assert set(registered()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
