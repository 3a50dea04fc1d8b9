"""Every registered query against its SQL check, and the shape of the driver's entry."""

import pytest

import __spark_entry__ as driver
import check
from coverlane.plans import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert check.compare(spark, db, SF, name) is None


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(CHECKS) == set(QUERIES)
    assert "policy_no" in driver.entry(spark).columns


@pytest.mark.parametrize("name", ["alerts", "catalog_nested", "nav_changes", "nav_first_change", "session_ttl"])
def test_query_with_every_key_heavy(spark, db, name):
    """The same rows when each key is above the mark and goes the long way."""
    spark.conf.set("coverlane.hotRows", "5")
    try:
        assert check.compare(spark, db, SF, name) is None
    finally:
        spark.conf.unset("coverlane.hotRows")
