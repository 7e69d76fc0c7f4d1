import pytest

import __spark_entry__ as entry
from tests.conftest import same
from tessera.plans import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, sf, duck, name):
    query, sql = QUERIES[name]
    same(query(spark, sf).toPandas(), duck.sql(sql).df())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name][0](spark, sf).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "user_id", "value", "run"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_listing_queries_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
