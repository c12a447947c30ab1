"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare
from workloads.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = [
    pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables"),
    pytest.mark.usefixtures("codegen"),
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = compare(spark, duck, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["stage", "key", "step", "action"]
    assert df.count() > 0
