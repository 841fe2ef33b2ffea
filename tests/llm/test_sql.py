"""Text queries against their SQL on the smallest tables."""

import compare
import pytest
from conftest import DATA

from loomwake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, con, name):
    assert compare.differ(queries.QUERIES[name](spark, DATA), con, queries.ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
