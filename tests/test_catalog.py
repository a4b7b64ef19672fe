"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from compare import compare, register

import __spark_entry__ as contract
from pulsewatch.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return register(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    ok, _, message = compare(spark, con, name, SF)
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)


def test_partitions_hold_every_row_once(spark):
    found = contract.queries()["partition_rows"](spark, SF)
    assert found.groupBy().sum("cnt").first()[0] == 2 * spark.read.parquet(f"{SF}/events.parquet").count()
