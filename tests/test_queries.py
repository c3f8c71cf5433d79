"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from registry.base import ORACLES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_a_name_that_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    problem = compare(spark, connection, name, SF)
    # Few rows may leave a report empty at this scale, in the SQL as well.
    assert problem in (None, "no rows on either side"), problem
