import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test data at {DATA}")
    return DATA


def rows_of(table):
    """The rows of an Arrow table, columns by name, in any order."""
    names = sorted(table.column_names)
    return sorted(repr([r[n] for n in names]) for r in table.to_pylist())


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Compares a query with its SQL in DuckDB."""
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")

    def compare(query, sql):
        got, expected = query(spark, sf_dir).toArrow(), db.execute(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(expected.column_names)
        assert rows_of(got) == rows_of(expected)

    return compare
