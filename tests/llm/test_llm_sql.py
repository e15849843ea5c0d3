"""Operators with SQL, on whole small tables."""

import pytest

from siftwell.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_operator_agrees_with_sql(agrees, name):
    agrees(name)
