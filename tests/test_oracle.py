"""Every registered query that has SQL, compared as a whole on the smallest tables."""

import pytest

from conftest import SMALL
from compare import compare, duck
from sievemark.plans import registry

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SMALL) is None


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
