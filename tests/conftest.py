import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("SEDIMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return connection


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Compares a query with its SQL: columns by name, rows in any order."""

    def compare(query, sql):
        rows = query(spark, data)
        columns = sorted(rows.columns)
        got = sorted(map(repr, map(tuple, rows.select(columns).collect())))
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        expected = sorted(map(repr, map(tuple, relation.project(",".join(f'"{c}"' for c in columns)).fetchall())))
        assert got == expected

    return compare
