import pytest

from concordia.llm import queries as Q
from tests import compare


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.skipif(not compare.available(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare.differences(spark, con, Q.queries()[name], Q.oracle_sql()[name]) is None


def test_all_thirteen_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
