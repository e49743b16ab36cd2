"""Every registered query against its SQL on the small tables."""

import pytest
from helpers import SMALL

import __spark_entry__ as entry_points
import oracle

QUERIES, SQL = entry_points.QUERIES, entry_points.ORACLE


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    assert name in SQL
    assert oracle.compare(QUERIES[name](spark, SMALL), db, SQL[name]) is None


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
