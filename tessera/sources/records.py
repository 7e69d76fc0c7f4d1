"""Session records and logs: read with checks and defaults, append, overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sensor import fnv1a

MAGIC = 0x54455353
RECORD = "device_id bigint, magic bigint, sessions int, faults int, last_fault int, errors array<int>, checksum bigint"
STROKE_LOG = "session_id bigint, n int, t_s double, kind string, v_cms double, r_mm double, dr_mm double, f_peak_mn double, t_contact_s double, gap_s double, dwell_s double, phi_rev double, side int"
SENSOR_TICK = "device_id bigint, ts timestamp, ntc_ferrule int, ntc_cup int, vbus int, rail boolean, park_switch boolean, diag boolean, button boolean"


def checksum():
    """F11 over a record's fields, in order; a null field or error reads as a dash, so that it isn't the same as none."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("device_id", "magic", "sessions", "faults", "last_fault")]
    return fnv1a(F.concat_ws("|", *fields, F.coalesce(F.array_join(F.col("errors").cast("array<string>"), ",", "-"), F.lit("-"))))


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as read; one whose magic or checksum is wrong gives way to the defaults."""
    df = spark.read.schema(RECORD).parquet(path)
    valid = F.coalesce((F.col("magic") == MAGIC) & (F.col("checksum") == checksum()), F.lit(False))
    df = df.withColumn("valid", valid)
    zero = {c: F.when(F.col("valid"), F.col(c)).otherwise(0) for c in ("sessions", "faults", "last_fault")}
    return df.withColumns(zero | {"errors": F.when(F.col("valid"), F.col("errors")).otherwise(F.array().cast("array<int>"))})


def save_records(sessions: DataFrame, path: str) -> None:
    """One record for each device after its sessions (device_id, at, fault, error); overwrites."""
    back = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("at"), F.desc("error")))
    late = F.array_sort(F.collect_list(F.when(F.col("back") <= 5, F.struct("at", "error"))))  # five at most
    own = sessions.withColumn("back", back).groupBy("device_id").agg(F.count("*").cast("int").alias("sessions"), F.count_if(F.col("fault") != 0).cast("int").alias("faults"), F.max_by("fault", "at").cast("int").alias("last_fault"), F.transform(late, lambda x: x["error"]).cast("array<int>").alias("errors"))
    own = own.withColumn("magic", F.lit(MAGIC).cast("bigint"))
    own.withColumn("checksum", checksum()).select("device_id", "magic", "sessions", "faults", "last_fault", "errors", "checksum").write.mode("overwrite").parquet(path)


def erase_records(spark: SparkSession, path: str) -> None:
    """S13."""
    spark.createDataFrame([], RECORD).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends session or transition lines, by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_stroke_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STROKE_LOG).csv(path, header=True)


def write_stroke_log(df: DataFrame, path: str) -> None:
    df.select(*[c.split()[0] for c in STROKE_LOG.split(", ")]).write.mode("overwrite").csv(path, header=True)
