import pytest

from pageloom.catalog import QUERIES
from pageloom.catalog_sql import ORACLE
from tests.compare import connect, differences

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = connect(D)
    c.execute("SET TimeZone = 'UTC'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, D, QUERIES[name], ORACLE[name]) == []
