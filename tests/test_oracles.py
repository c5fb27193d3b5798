import pytest

from mendweave import catalog
from tests.conftest import LARGER, SMALL
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    assert_same(catalog.queries()[name](spark, SMALL).toPandas(), catalog.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_has_rows(spark, name):
    """On tables large enough for several targets, pages whose id is divisible by 50, with others on their hosts."""
    assert catalog.queries()[name](spark, LARGER).count() > 0
