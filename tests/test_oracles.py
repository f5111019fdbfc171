"""Every query with an oracle returns the oracle's rows."""

import pytest

from tests import compare
from tokenloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(name, spark, sf_dir, con):
    got = compare.rows(registry.QUERIES[name](spark, sf_dir).toPandas())
    assert got == compare.rows(con.sql(registry.ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
