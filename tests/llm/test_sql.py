"""Queries of this folder that have SQL give the rows of that SQL."""

import pytest
from compare import differences, duck

from rillflow.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), duck(small), ORACLES[name]) == []
