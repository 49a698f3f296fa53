"""Every registered query against its DuckDB counterpart, on the whole smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from workload.check import differences, duck
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert differences(spark, tables, FOLDER, name) == ""
