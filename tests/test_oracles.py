"""Every registered query against its SQL, over the smallest given tables."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_query_has_an_oracle():
    """But for the operators for training data, which SQL cannot all express."""
    without = set(QUERIES) - set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)
    assert all(re.match(r"op\d+_|pipeline$", key) for key in without)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, connection, key):
    assert difference(spark, connection, QUERIES[key], ORACLES[key], FOLDER) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["tahun", "bulan", "revenue", "qty", "display_label"]
    assert df.count() > 0
