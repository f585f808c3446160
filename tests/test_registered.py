"""Every registered query against its check SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from harness.checks import CHECKS
from harness.compare import database, difference
from harness.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_check(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, CHECKS[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 50
