"""Queries against their SQL, on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare  # noqa: E402

from tidemill.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, medium, name):
    assert compare(spark, medium, queries.QUERIES[name], queries.ORACLES[name]) > 0
