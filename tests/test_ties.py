"""Readings that lie just on a limit, where floating-point roundings would decide: the queries against their SQL."""

import duckdb
import pytest

from tessera.plans import QUERIES
from tests.conftest import same

#: Eight readings and then 1.3 times their mean, in hundredths; summed up as doubles the mean is a little too small.
ON_THE_LIMIT = [[9311, 19253, 16363, 16557, 12889, 19300, 1131, 76, 15418], [17644, 17698, 10850, 15012, 19656, 916, 7523, 61, 14521]]


@pytest.fixture
def against_sql(spark, tmp_path):
    """Holds a query over (user_id, milliseconds, value) against its SQL."""

    def hold(name, rows):
        con = duckdb.connect()
        con.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        con.executemany("INSERT INTO events VALUES (?, make_timestamp(1704067200000000 + ?), ?, 'view', ?, '{}')", [(k, ms * 1000, u, v) for k, (u, ms, v) in enumerate(rows)])
        con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        got, want = QUERIES[name][0](spark, str(tmp_path)).toPandas(), con.sql(QUERIES[name][1]).df()
        same(got, want)
        return got

    return hold


def test_reading_just_on_the_baseline_limit(against_sql):
    rows = [(u, 1000 * k, v / 100) for u, values in enumerate(ON_THE_LIMIT) for k, v in enumerate(values)]
    against_sql("over_baseline", rows)


def test_duty_whose_share_of_the_period_is_whole(against_sql):
    rows = [(1, ms, v) for v in (64.6, 23.0, 100.0, 250.0, 0.2) for ms in range(320, 326)]
    heating = against_sql("patterns", rows).set_index("event_id").heating
    assert heating[2] and not heating[3]  # 64.6 % of 500 ms is 323
