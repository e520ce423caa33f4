"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from plumbrule.plans import registered
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", sorted(registered.all_queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR, duck)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", ["temporal_evidence", "sequence_evidence"])
def test_many_partitions(spark, duck, name):
    """As many shuffle partitions as Spark has by default, where joins and unions meet differently dealt frames."""
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        ok, note = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR, duck)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert ok, note


def test_every_query_has_sql():
    assert set(registered.all_sql()) == set(registered.all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["record_ref", "status", "failure_count", "source_row_hash"]
