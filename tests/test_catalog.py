"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from citescope.plans.catalog import QUERIES
from citescope.plans.checks import CHECKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(queries()) >= set(QUERIES)
    assert set(oracle_sql()) >= set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, CHECKS[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0

