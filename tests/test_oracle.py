"""Every query of the engine against its SQL, on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import compare  # noqa: E402

from tidemill.plans import queries as plans  # noqa: E402


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, medium, name):
    assert compare(spark, medium, plans.QUERIES[name], plans.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0
