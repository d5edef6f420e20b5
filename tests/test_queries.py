"""Every registered query against its SQL on the smallest test tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import TABLES, rows  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    relation = duck.sql(CHECKS[name])
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())


UNCHECKED = sorted(set(QUERIES) - set(CHECKS))


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(df.columns) > 0
    df.write.format("noop").mode("overwrite").save()
