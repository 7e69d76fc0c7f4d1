"""Streams over the events: they are written as files by time, read as a stream, and the sink's table is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import QUERIES, events, query
from tessera.plans.session_queries import _signals
from tessera.sources import binary, records
from tessera.sources.scratch import new_folder
from tessera.streaming import device, pairs, sinks

PARTS = 4
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def parts_by_time(rows: DataFrame) -> list[DataFrame]:
    """The rows by ranges of ts, oldest first, and at last a row of a later time for each event_type, so that the watermark
    passes all others."""
    least, most = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - least) * PARTS / max(1, most - least)), F.lit(PARTS - 1)) if least is not None else F.lit(0)
    ids = [(10**12 + k, 10**12, kind) for k, kind in enumerate(("view", "click", "purchase", "error"))]
    last = rows.sparkSession.createDataFrame(ids, "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_micros(F.lit((most or 0) + 10**15)))
    return [rows.filter(part == k) for k in range(PARTS)] + [rows.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1)]


def finished(started) -> None:
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


def streamed(rows: DataFrame, make: Callable[[Callable[[], DataFrame]], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """What the stream make(source) gives over the rows, which come as files by time.

    Each part is one micro-batch, however many files it has: the query ends there and goes on from its checkpoint with the
    next. In several, all but the first would have rows that the watermark of the ones before has passed already.
    """
    spark = rows.sparkSession
    folder, out, state = (new_folder(spark, name) for name in ("staged", "stream", "stream-state"))
    parts = parts_by_time(rows)
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        stream = make(lambda: spark.readStream.schema(rows.schema).parquet(folder))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        # a watermark that has moved on is worked off with the next part's rows, the last one on its own
        with_settings(spark, {**(settings or {}), NO_DATA: str(k == len(parts) - 1).lower()}, lambda writer=writer: finished(writer.trigger(availableNow=True).start()))
    return spark.read.schema(stream.schema).parquet(out)


def with_settings(spark: SparkSession, settings: dict[str, str], make: Callable[[], None]) -> None:
    """make() under settings of the session, which are put back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        make()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


@query(QUERIES["state_machine"][1])
def stream_state_machine(spark, sf_dir):
    """T1, T18 on a stream, by event time with transformWithState: what state_machine gives."""
    rows = _signals(events(spark, sf_dir)).withColumn("event_type", F.lit("signal"))
    found = streamed(rows, lambda source: device.transitions_in_order(source(), "1 hour", 10**15), ROCKSDB)
    return found.select("event_id", "user_id", "from_state", "to_state", F.col("fault").cast("int").alias("fault"))


@query(QUERIES["rail_verdicts"][1])
def stream_rail_verdicts(spark, sf_dir):
    """J3 on a stream: two signals in one tick, joined with a watermark on either: what rail_verdicts gives."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value")
    one = lambda source, kind: source().filter(F.col("event_type") == kind)
    both = streamed(rows, lambda source: pairs.stream_same_tick(one(source, "view"), one(source, "click"), "user_id", "ts", "1 hour", "value", "1 hour"))
    verdict = F.when(F.col("left") >= 50, "alive").when(F.col("right") >= 50, "stopped").otherwise("brown-out")
    return both.select("user_id", F.floor(F.unix_micros("tick") / 3_600_000_000).cast("long").alias("tick"), verdict.alias("verdict"))


@query("""
WITH n AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS after FROM events)
SELECT user_id, event_id, us AS silent_since FROM n WHERE after IS NULL OR after > us + 172800000000""")
def watchdog_silences(spark, sf_dir):
    """T6 on a stream: devices that a timer finds silent for two days, the last time at the stream's end too."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    found = streamed(rows, lambda source: device.watchdog(source(), 2 * 86_400_000, "1 hour"), ROCKSDB)
    return found.filter(F.col("user_id") < 10**12)  # without the row that ends the stream


def _lines(rows: DataFrame) -> DataFrame:
    fault = F.when(F.col("event_type") == "error", F.col("event_id") % 17).otherwise(0)
    return rows.select(F.col("user_id").alias("device_id"), "event_id", F.col("ts").alias("at"), fault.cast("int").alias("fault"), (F.col("event_id") * 37 % 201 - 100).cast("int").alias("error"))


_LINES_SQL = "l AS (SELECT user_id AS device_id, event_id, ts, CASE WHEN event_type = 'error' THEN event_id % 17 ELSE 0 END AS fault, event_id * 37 % 201 - 100 AS error FROM events)"


@query(f"""
WITH {_LINES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) AS back FROM l)
SELECT device_id, count(*) AS sessions, count(*) FILTER (fault <> 0) AS faults, max(fault) FILTER (back = 1)::INT AS last_fault,
  string_agg(error, ',' ORDER BY back DESC) FILTER (back <= 5) AS errors FROM b GROUP BY device_id""")
def device_records(spark, sf_dir):
    """A stream of session lines keeps each device's record, by an upsert that counts a batch once."""
    rows = events(spark, sf_dir)
    folder = new_folder(spark, "lines")
    _lines(rows).repartition(PARTS).write.parquet(folder)
    table = sinks.records_table(spark, new_folder(spark, "records"))
    stream = spark.readStream.schema(_lines(rows).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    finished(table.sink(stream, new_folder(spark, "records-state"), sinks.record_parts).trigger(availableNow=True).start())
    return table.read().select("device_id", "sessions", "faults", "last_fault", F.array_join(F.transform("errors", lambda e: e["error"].cast("string")), ",").alias("errors"))


@query(f"WITH {_LINES_SQL} SELECT device_id, event_id, epoch_us(ts) AS us, fault::INT AS fault, error::INT AS error FROM l")
def session_lines(spark, sf_dir):
    """The lines themselves, appended by a stream, each batch once."""
    rows = events(spark, sf_dir)
    folder = new_folder(spark, "lines")
    _lines(rows).repartition(PARTS).write.parquet(folder)
    log = sinks.AppendTable(spark, new_folder(spark, "log"), "device_id long, event_id long, at timestamp, fault int, error int")
    stream = spark.readStream.schema(_lines(rows).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    finished(log.sink(stream, new_folder(spark, "log-state")).trigger(availableNow=True).start())
    return log.read().select("device_id", "event_id", F.unix_micros("at").alias("us"), "fault", "error")


@query(f"""
WITH {_LINES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, error DESC) AS back FROM l),
r AS (SELECT device_id, count(*) AS sessions, count(*) FILTER (fault <> 0) AS faults, arg_max(fault, ts) AS last_fault, string_agg(error, ',' ORDER BY back DESC) FILTER (back <= 5) AS errors FROM b GROUP BY device_id)
SELECT device_id, device_id % 5 <> 0 AND device_id % 7 <> 0 AS valid, CASE WHEN device_id % 5 = 0 OR device_id % 7 = 0 THEN 0 ELSE sessions END::INT AS sessions,
  CASE WHEN device_id % 5 = 0 OR device_id % 7 = 0 THEN 0 ELSE faults END::INT AS faults, CASE WHEN device_id % 5 = 0 OR device_id % 7 = 0 THEN 0 ELSE last_fault END::INT AS last_fault,
  CASE WHEN device_id % 5 = 0 OR device_id % 7 = 0 THEN '' ELSE errors END AS errors FROM r""")
def stored_records(spark, sf_dir):
    """Records written with magic and checksum; of some a bit is changed, and those give way to the defaults."""
    path, broken = new_folder(spark, "store"), new_folder(spark, "broken")
    records.save_records(_lines(events(spark, sf_dir)), path)
    rows = spark.read.schema(records.RECORD).parquet(path)
    rows = rows.withColumn("checksum", F.when(F.col("device_id") % 5 == 0, F.col("checksum").bitwiseXOR(F.lit(4))).otherwise(F.col("checksum")))
    rows.withColumn("magic", F.when(F.col("device_id") % 7 == 0, F.col("magic") + 1).otherwise(F.col("magic"))).write.parquet(broken)
    back = records.load_records(spark, broken)
    return back.select("device_id", "valid", "sessions", "faults", "last_fault", F.array_join(F.col("errors").cast("array<string>"), ",").alias("errors"))


@query("SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value, props FROM events")
def binary_events(spark, sf_dir):
    """Readings as packed binary records with magic numbers and checksums, written and read back in ranges."""
    spark.dataSource.register(binary.BinaryRecords)
    folder = new_folder(spark, "binary")
    events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value", "props").write.format("tessera_records").mode("append").save(folder)
    back = spark.read.format("tessera_records").option("rangeBytes", 1 << 20).load(folder)
    return back.filter("broken IS NULL").select("event_id", "user_id", F.unix_micros("ts").alias("us"), "event_type", "value", "props")
