"""Every query outside the text subpackage against its SQL on the smallest tables."""

import compare
import pytest
from conftest import DATA

from loomwake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, con, name):
    assert compare.differ(registry.queries()[name](spark, DATA), con, registry.oracles()[name]) == ""


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracles())
