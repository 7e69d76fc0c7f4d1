"""Streams in order of event time, joined streams, idempotent tables and the binary source."""

import datetime
import glob
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans.registry import events
from tessera.plans.session_queries import _signals
from tessera.sources import binary
from tessera.streaming import device, machine, pairs, sinks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
FAR = datetime.datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set(STORE, ROCKS)
    yield spark
    spark.conf.unset(STORE)


def write_parts(spark, frames, folder):
    """One file for each frame, oldest first."""
    for k, frame in enumerate(frames):
        one = folder / f"tmp{k}"
        frame.coalesce(1).write.parquet(str(one))
        (folder / "in").mkdir(exist_ok=True)
        name = folder / "in" / f"part-{k}.parquet"
        os.rename(glob.glob(f"{one}/*.parquet")[0], name)
        os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder / "in")


def drain(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]


def signals(spark, sf):
    return _signals(events(spark, sf)).toPandas()


def last_of_all(spark, schema):
    """A newest row, of a device of its own, that moves the watermark past all others."""
    return spark.createDataFrame([(10**9, 10**9, FAR, "none")], schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_machine_in_order_of_time_for_any_split(rocks, sf, tmp_path, seed):
    """Rows in any order and any files, and a restart from the checkpoint half way."""
    spark = rocks
    rows = signals(spark, sf)
    want = machine.transitions(spark.createDataFrame(rows)).toPandas()
    shuffled = rows.sample(frac=1, random_state=seed).reset_index(drop=True)
    schema = spark.createDataFrame(rows).schema
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 3))
    frames = [spark.createDataFrame(shuffled[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    path = write_parts(spark, frames[:2], tmp_path)

    def stream():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return device.transitions_in_order(source, "10000 days", 10**15)

    drain(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    for k, frame in enumerate([*frames[2:], last_of_all(spark, schema)]):  # the query starts anew from its checkpoint
        frame.coalesce(1).write.parquet(str(tmp_path / f"more{k}"))
        name = f"{path}/part-{9 + k}.parquet"
        os.rename(glob.glob(str(tmp_path / f"more{k}/*.parquet"))[0], name)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(device.transitions_in_order(source, "10000 days", 10**15), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    key = ["event_id", "user_id", "from_state", "to_state", "fault"]
    assert len(want) and sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))


def test_idle_state_goes_and_late_rows_are_dropped(rocks, tmp_path):
    spark = rocks
    day = datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(hours=h)
    schema = "event_id long, user_id long, ts timestamp, signal string"
    rows = [[(1, 1, at(0), "configured"), (2, 1, at(1), "tuned"), (3, 2, at(1), "configured")], [(4, 2, at(100), "tuned")], [(5, 1, at(2), "home"), (6, 1, at(150), "configured"), (7, 2, at(101), "home")], [(8, 3, at(400), None)]]
    path = write_parts(spark, [spark.createDataFrame(r, schema) for r in rows], tmp_path)
    stream = device.transitions_in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "1 hour", 50 * 3_600_000)
    progress = drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "user_id", "from_state", "to_state").collect())
    # device 2 is silent for 99 hours and begins in BOOT again, where "tuned" means nothing; event 5 is late
    assert got == [(1, 1, "BOOT", "AUTOTUNE"), (2, 1, "AUTOTUNE", "HOMING"), (3, 2, "BOOT", "AUTOTUNE"), (6, 1, "BOOT", "AUTOTUNE")]
    states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert states[-1]["customMetrics"].get("numValueStateVars", 0) >= 0 and states[-1]["numRowsTotal"] <= 4


def test_folds_in_order_of_one_key_and_a_large_batch(rocks, tmp_path):
    """All rows of one device in shuffled files, one of them large, and a restart: what the batch operators give."""
    from tessera.operators import gated, sequence

    spark, rng = rocks, random.Random(8)
    day = datetime.datetime(2024, 1, 1)
    schema = "event_id long, user_id long, ts timestamp, value double"
    rows = [(k, 1, day + datetime.timedelta(seconds=k // 2), rng.choice([None, *(rng.uniform(0, 100) for _ in range(9))])) for k in range(14_000)]
    want = spark.createDataFrame(rows, schema)
    shuffled = rng.sample(rows, len(rows))
    for name, make, batch, key in (
        ("gate", lambda s: device.credibility_in_order(s, 2.0, 98.0, 30.0, 3, "1 day", 10**15), gated.credibility(want, 2.0, 98.0, 30.0, 3), ["event_id", "kept", "bad", "credible"]),
        ("runs", lambda s: device.consecutive_in_order(s, 60.0, 3, "1 day", 10**15), sequence.consecutive(want, F.col("value") > 60, 3, "user_id", ["ts", "event_id"]), ["event_id", "run"]),
    ):
        folder = tmp_path / name
        folder.mkdir()
        path = write_parts(spark, [spark.createDataFrame(r, schema) for r in (shuffled[:12_000], shuffled[12_000:])], folder)
        go = lambda make=make, path=path, folder=folder: drain(make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), str(folder / "out"), str(folder / "check"))
        go()
        spark.createDataFrame([(10**9, 2, FAR, 1.0)], schema).coalesce(1).write.parquet(str(folder / "more"))
        os.rename(glob.glob(str(folder / "more/*.parquet"))[0], f"{path}/part-9.parquet")
        go()
        got = spark.read.parquet(str(folder / "out"))
        assert sorted(map(str, got.filter("user_id = 1").select(*key).collect())) == sorted(map(str, batch.select(*key).collect()))


def tick_streams(spark, rows, folder):
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"
    path = write_parts(spark, [spark.createDataFrame(r, schema) for r in rows], folder)
    source = lambda kind: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).filter(F.col("event_type") == kind)
    return source("view"), source("click")


def test_same_tick_stream_equals_batch_and_forgets(spark, sf, tmp_path):
    from tessera.operators import sequence

    e = events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    want = sequence.same_tick(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "user_id", "ts", 3_600_000, "value").toPandas()
    rows = e.toPandas().sort_values(["ts", "event_id"])
    n = len(rows) // 4 + 1
    parts = [[(i, u, t.to_pydatetime(), kind, v) for i, u, t, kind, v in rows[k * n : k * n + n].itertuples(index=False)] for k in range(4)]
    parts.append([(10**9 + k, 10**9, FAR, kind, 1.0) for k, kind in enumerate(("view", "click"))])
    left, right = tick_streams(spark, parts, tmp_path)
    progress = drain(pairs.stream_same_tick(left, right, "user_id", "ts", "1 hour", "value", "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", (F.unix_timestamp("tick") / 3600).cast("long").alias("tick"), "left", "right").toPandas()
    key = ["user_id", "tick", "left", "right"]
    assert len(want) and sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))
    states = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert states[-1] <= 4 < max(states)  # what the watermark has passed is gone


def test_within_stream_equals_a_join(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = sorted((day + datetime.timedelta(minutes=rng.randint(0, 3000)), k, k % 3, rng.choice(["view", "click"]), 1.0) for k in range(200))
    parts = [[(k, u, t, kind, v) for t, k, u, kind, v in rows[a : a + 50]] for a in range(0, 200, 50)]
    left, right = tick_streams(spark, parts, tmp_path)
    drain(pairs.stream_within(left, right, "user_id", "ts", "30 minutes", "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("first_id", "then_id").collect())
    want = sorted((k, j) for t, k, u, kind, _ in rows for s, j, w, other, _ in rows if kind == "view" and other == "click" and u == w and 0 <= (s - t).total_seconds() <= 1800)
    assert got == want and want


LINES = "device_id long, event_id long, at timestamp, fault int, error int"


def lines(n, seed=1):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    return [(rng.choice([1, 1, 1, 2, 3, None]), k, day + datetime.timedelta(minutes=rng.randint(0, 50)), rng.choice([0, 0, 6, None]), rng.randint(-9, 9)) for k in range(n)]


def record_rows(df):
    return sorted((str(r["device_id"]), r["sessions"], r["faults"], r["last_id"], r["last_fault"], [(x["id"], x["error"]) for x in r["errors"]]) for r in df.collect())


def test_records_are_the_same_for_any_batches_and_replays(spark, tmp_path):
    rows = lines(120)
    every = sinks.merged_records(sinks.record_parts(spark.createDataFrame(rows, LINES)))
    table = sinks.records_table(spark, str(tmp_path / "t"), buckets=4)
    for k, a in enumerate(range(0, 120, 40)):
        part = sinks.record_parts(spark.createDataFrame(rows[a : a + 40], LINES))
        table.upsert(part, k)
        before = record_rows(table.read())
        table.upsert(part, k)  # replayed
        assert record_rows(table.read()) == before
    assert record_rows(table.read()) == record_rows(every)
    # a batch that broke off before its commit leaves no trace, and can be done again
    more = sinks.record_parts(spark.createDataFrame(lines(30, 2), LINES))
    fail = table.commits.write
    table.commits.write = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        table.upsert(more, 3)
    table.commits.write = fail
    assert record_rows(table.read()) == before
    table.upsert(more, 3)
    both = sinks.record_parts(spark.createDataFrame(rows + lines(30, 2), LINES))
    assert record_rows(table.read()) == record_rows(sinks.merged_records(both))
    table.upsert(more.limit(0), 4)
    assert record_rows(table.read()) == record_rows(sinks.merged_records(both))
    sinks.erase(table, 5)
    sinks.erase(table, 5)
    assert table.read().count() == 0
    with pytest.raises(Exception, match="exist"):
        table.commits.write(5, {})


def test_stream_into_tables_with_a_restart(spark, tmp_path):
    rows = lines(90, 3)
    frames = [spark.createDataFrame(rows[a : a + 30], LINES) for a in range(0, 90, 30)]
    path = write_parts(spark, frames[:2], tmp_path)
    table, log = sinks.records_table(spark, str(tmp_path / "t")), sinks.AppendTable(spark, str(tmp_path / "log"), LINES)

    def go():
        source = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(path)
        for q in (table.sink(source, str(tmp_path / "c1"), sinks.record_parts), log.sink(source, str(tmp_path / "c2"))):
            started = q.trigger(availableNow=True).start()
            started.awaitTermination(120)
            assert started.exception() is None

    go()
    # the last batch is done again, as after a crash between the sink and the checkpoint
    for c in ("c1", "c2"):
        for f in glob.glob(str(tmp_path / c / "commits" / "*1*")) + glob.glob(str(tmp_path / c / "commits" / ".*1*")):
            os.remove(f)
    frames[2].coalesce(1).write.parquet(str(tmp_path / "more"))
    os.rename(glob.glob(str(tmp_path / "more/*.parquet"))[0], f"{path}/part-9.parquet")
    go()
    assert record_rows(table.read()) == record_rows(sinks.merged_records(sinks.record_parts(spark.createDataFrame(rows, LINES))))
    assert sorted(r["event_id"] for r in log.read().collect()) == list(range(90))


FIELDS = ["event_id", "user_id", "ts", "event_type", "value", "props"]


def as_rows(frame):
    frame = frame.select(*FIELDS).toPandas()
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(binary.BinaryRecords)
    return spark


def test_binary_round_trip_in_small_ranges_and_with_filters(source, sf, tmp_path):
    spark, path = source, str(tmp_path / "b")
    e = events(spark, sf).select(*FIELDS)
    odd = spark.createDataFrame([(None, None, None, None, None, None), (-1, 2, FAR, "TSR\x01é", float("nan"), "TSR\x01" * 9)], e.schema)
    both = e.unionByName(odd)
    both.repartition(3).write.format("tessera_records").mode("append").save(path)
    for size in (10**9, 4096):
        got = spark.read.format("tessera_records").option("rangeBytes", size).load(path)
        assert got.filter("broken IS NOT NULL").count() == 0 and as_rows(got) == as_rows(both)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("tessera_records").option("pushdown", "true").load(path)
        for rule in ("user_id = 3 AND value > 40", "ts < timestamp'2024-01-05 00:00:00'", "ts >= timestamp'2099-01-01 00:00:00'", "event_type = 'click' AND props IS NOT NULL"):
            assert as_rows(got.filter(rule)) == as_rows(both.filter(rule))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    e.limit(0).write.format("tessera_records").mode("append").save(path)
    e.limit(10).write.format("tessera_records").mode("overwrite").save(path)
    assert spark.read.format("tessera_records").load(path).count() == 10


@pytest.mark.parametrize("size", [64, 200, 10**6])
def test_broken_records_are_reported_once(source, tmp_path, size):
    whole = [binary.packed(k, k % 7, 10**6 * k, "view", k / 2, "x" * (k % 90)) for k in range(60)]
    data, kept, broken = b"", [], 0
    for k, r in enumerate(whole):
        if k % 10 == 3:
            r = r[:20] + b"\xff" + r[21:]
        elif k % 10 == 6:
            r = b"noise" + r[:-9]
        if k % 10 in (3, 6):
            broken += 1
        else:
            kept.append(k)
        data += r
    (tmp_path / "d.bin").write_bytes(data + whole[0][:30])
    rows = source.read.format("tessera_records").option("rangeBytes", size).load(str(tmp_path)).collect()
    assert sorted(r["event_id"] for r in rows if r["broken"] is None) == kept
    assert sum(r["broken"] is not None for r in rows) == broken + 1
    assert all(r["file"].endswith("d.bin") and r["at"] is not None for r in rows if r["broken"])


def test_binary_stream_takes_commits_once(source, sf, tmp_path):
    spark, path = source, str(tmp_path / "b")
    rows = events(spark, sf).select(*FIELDS).toPandas()
    schema = events(spark, sf).select(*FIELDS).schema
    parts = [spark.createDataFrame(rows[k::3], schema) for k in range(3)]
    for p in parts[:2]:
        p.write.format("tessera_records").mode("append").save(path)

    def go():
        stream = spark.readStream.format("tessera_records").option("rangeBytes", 8192).load(path)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    go()
    parts[2].write.format("tessera_records").mode("append").save(path)
    go()
    go()
    assert as_rows(spark.read.parquet(str(tmp_path / "out"))) == as_rows(spark.createDataFrame(rows, schema))
