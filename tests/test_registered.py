"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, got) == check.rows_of(names, cursor.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.rendered.startswith("### Result 1\n") for r in rows)


def test_human_bytes_of_products_beyond_64_bits(spark, tmp_path):
    rows = [(600_000, 20_000, 7), (9_000_000, 1_200_000, 7), (4_000_000_000, 4_000_000_000, 1), (3, 5, 2), (None, 1, 1)]
    items = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber bigint")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.orderkey, r.product, r.n) for r in entry.queries()["human_bytes"](spark, str(tmp_path)).collect()}
    assert got == {
        ("585.9 KB", "750000000.0 TB", 1), ("8.6 MB", "675000000000.0 TB", 1),
        ("3.7 GB", "14551915.2 TB", 1), ("3.0 B", "960.0 B", 1), (None, None, 1),
    }
