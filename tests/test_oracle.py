"""Every registered query against its SQL twin, on whole tables."""

import pytest

from __spark_entry__ import entry
from check import compare, connect
from voxloom.catalog import all_oracles as oracle_sql
from voxloom.catalog import all_queries as queries


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, sf, duck, name):
    assert compare(queries()[name](spark, sf), duck.execute(oracle_sql()[name])) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
