"""Every registered query against its independent SQL."""

import pytest

from checks.compare import database, difference
from checks.oracles import oracle_sql
from checks.queries import queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, connection, sf_dir, name):
    assert difference(spark, connection, sf_dir, name) is None


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
