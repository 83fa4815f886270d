"""Every registered query with an SQL twin gives its rows; the others run."""

import pytest

from lakeloom.plans import registry
from tests.oracle import check

ORACLES = registry.oracle_sql()
ROWS_ONLY = sorted(set(registry.queries()) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, registry.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())
