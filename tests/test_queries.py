"""Every query of the library's own operators against its SQL; those without SQL run and agree with themselves."""

import pytest

from meadow.plans import registry
from tests.compare import connection, normal, same

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats(spark, sf, name):
    one, two = (normal(tuple(r) for r in QUERIES[name](spark, sf).collect()) for _ in range(2))
    assert one == two
