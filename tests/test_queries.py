"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

from sessionloom.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SPARSE = {"real_overlap_windows"}  # sessions have too few player events at this scale


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, name, FOLDER, allow_empty=name in SPARSE) is None


def test_entry_point(spark):
    import __spark_entry__ as contract

    row = contract.entry(spark).first()
    assert row.episodes == 300 and 0 < row.accuracy < 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
