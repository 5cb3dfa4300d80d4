import pytest

from lodeweave.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_statement(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
