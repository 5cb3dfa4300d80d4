import pytest

from lodeweave.plans import all_queries
from lodeweave.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

all_queries.load()


@pytest.fixture(scope="module")
def sf_dir():
    """The scale at which the statements are compared; smaller ones leave some without rows."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_statement(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
