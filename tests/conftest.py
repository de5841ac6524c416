import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    # Compiling generated code would take most of the time of queries over so few rows.
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    session = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", "3g").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def same_rows(df, cursor):
    """Whether a DataFrame and a DuckDB result have the same columns and rows, in any order."""
    names = [c[0] for c in cursor.description]
    rows = cursor.fetchall()
    columns = sorted(df.columns)
    assert sorted(names) == columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
    assert got == want
