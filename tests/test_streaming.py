import pytest
from pyspark.sql import functions as F

from tessera.operators import gated, sequence
from tessera.plans import QUERIES
from tessera.plans.registry import ORDER, events
from tessera.streaming import machine, triggers


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events in three files by time, as a stream takes them."""
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value").toPandas().sort_values(["ts", "event_id"])
    path = tmp_path_factory.mktemp("stream")
    n = len(rows) // 3 + 1
    for k in range(3):
        part = rows[k * n : (k + 1) * n]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return str(path / "in"), spark.createDataFrame(rows)


def run(spark, parts, make, name, checkpoint):
    path, batch = parts
    stream = make(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_consecutive_stream_equals_batch(spark, parts, tmp_path):
    got = run(spark, parts, lambda s: triggers.stream_consecutive(s, 60.0, 2), "runs", tmp_path)
    want = sequence.consecutive(parts[1], F.col("value") > 60, 2, "user_id", ORDER)
    assert sorted(map(tuple, got.select("event_id", "run").collect())) == sorted(map(tuple, want.select("event_id", "run").collect()))


def test_credibility_stream_equals_batch(spark, parts, tmp_path):
    got = run(spark, parts, lambda s: triggers.stream_credibility(s, 2.0, 98.0, 0.005, 3), "gated", tmp_path)
    want = gated.credibility(parts[1], 2.0, 98.0, 0.005, 3)
    key = ["event_id", "kept", "bad", "credible"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_machine_stream_equals_batch(spark, parts, tmp_path):
    names = F.array(*map(F.lit, ("configured", "tuned", "home", "armed", "warm", "full", "parked", "stall", "unsafe")))
    signal = F.element_at(names, (F.col("event_id") % 9 + 1).cast("int"))
    got = run(spark, parts, lambda s: machine.stream_transitions(s.withColumn("signal", signal)), "machine", tmp_path)
    want = machine.transitions(parts[1].withColumn("signal", signal))
    key = ["event_id", "from_state", "to_state", "fault"]
    assert want.count() and sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_blocks_stream_is_a_part_of_batch(spark, parts, tmp_path):
    got = run(spark, parts, triggers.stream_blocks, "blocks", tmp_path)
    rows = {(r.user_id, int(r.w) // 225): (r.low, r.high, r.n) for r in got.select("user_id", F.unix_timestamp("window.start").alias("w"), "low", "high", "n").collect()}
    want = {(r.user_id, r.block): (r.low, r.high, r.n) for r in sequence.blocks(parts[1], "ts", 225).groupBy("user_id", "block").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).collect()}
    assert rows and all(want[k] == v for k, v in rows.items())


def test_silences_time_out(spark, parts, tmp_path):
    got = run(spark, parts, lambda s: triggers.stream_silences(s, 3_600_000), "silences", tmp_path)
    assert got.count() > 0


def test_flagship(spark, sf):
    assert "consecutive_trigger" in QUERIES
