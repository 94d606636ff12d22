"""Every registered query against its check statement on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), 0 if v is None else v) for v in row])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_check(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = [tuple(plain(row[found.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert ordered([tuple(plain(row[c]) for c in columns) for row in got.collect()]) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_query_without_check_returns_rows(spark, name):
    """These train models or work on texts; what they compute is tested elsewhere."""
    rows = __spark_entry__.queries()[name](spark, SF_DIR)
    assert not rows.isEmpty() and len(set(rows.columns)) == len(rows.columns)
