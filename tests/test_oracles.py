"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from same import assert_same, database

from tidewater.jobs import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, db, name):
    assert_same(catalog.queries()[name](spark, FOLDER), db, catalog.oracle_sql()[name])
