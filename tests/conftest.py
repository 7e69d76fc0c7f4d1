import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as from '{SF}/{f}'")
    return con


def same(a, b):
    """Whether two pandas frames hold the same rows, in any order."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        differ = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        assert not differ.any(), (c, a[c][differ].head(3).tolist(), b[c][differ].head(3).tolist())
