"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from tools.compare import connect, normal

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() > 0
    assert all(isinstance(f.dataType, (T.StringType, T.LongType, T.DoubleType)) for f in result.schema)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIRECTORY)
    got = [tuple(row) for row in df.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert normal(got, df.columns) == normal(expected, names)
