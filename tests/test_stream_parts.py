"""Streams over tables of many files, and folds of many keys in one state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import QUERIES
from tessera.plans.stream_queries import ROCKSDB, streamed
from tessera.streaming import device
from tests.conftest import same


@pytest.fixture(scope="module")
def many_files(spark, sf, tmp_path_factory):
    """The events in twelve files, each read by a task of its own."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(12, "event_id").write.parquet(f"{folder}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["watchdog_silences", "stream_state_machine", "stream_rail_verdicts"])
def test_stream_of_many_files_loses_no_row(spark, many_files, duck, name):
    assert spark.read.parquet(f"{many_files}/events.parquet").rdd.getNumPartitions() >= 12
    query, sql = QUERIES[name]
    same(query(spark, many_files).toPandas(), duck.sql(sql).df())


@pytest.mark.parametrize("groups", [1, 5])
def test_fold_keeps_keys_of_a_group_apart(spark, groups):
    """Runs of rows of a key up to two hours apart; the key may be null or beyond what a double holds."""
    rng, day = random.Random(3), datetime.datetime(2024, 1, 1)
    keys = [None, *(2**53 + k for k in range(9))]
    rows = [(k, rng.choice(keys), day + datetime.timedelta(minutes=rng.randint(0, 2500)), "view", rng.choice([None, 1.0, 2.5])) for k in range(300)]

    def step(state, event_id, us, value):
        n = (state[0] if state else 0) + 1
        return (n,), (event_id, n, value)

    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    fold = lambda source: device.fold_in_order(source(), step, "n long", "user_id", ["value"], "event_id long, n long, value double", "1 hour", 7_200_000, groups=groups)
    got = [tuple(r) for r in streamed(df, fold, ROCKSDB).filter(F.col("event_id") < 10**12).collect()]
    want, seen = [], {}
    for event_id, key, ts, _, value in sorted(rows, key=lambda r: (r[2], r[0])):
        last, n = seen.get(key, (ts, 0))
        n = 1 if ts - last > datetime.timedelta(hours=2) else n + 1
        seen[key] = ts, n
        want.append((key, event_id, n, value))
    assert sorted(map(str, got)) == sorted(map(str, want))
