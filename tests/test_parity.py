"""Every registered query against its SQL twin; PARITY_FOLDER picks the tables."""

import os

import pytest

import __spark_entry__ as entry
from evidence.plans.registered import QUERIES
from tests.parity import connect, differences

#: The queries of the library; those of the corpus operators have tests of their own.
NAMES = sorted(QUERIES)
FOLDER = os.environ.get("PARITY_FOLDER", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(autouse=True)
def plain_session(spark):
    """A session as a user starts it: Arrow is off for what goes to the driver."""
    name = "spark.sql.execution.arrow.pyspark.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, was)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) == []
    else:
        assert len(df.collect()) > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
