"""Tables that a stream keeps up to date, each micro-batch once: versions in folders, and a commit file for each batch.

A batch writes its own new folders and then its commit file, which is made under another name and renamed, and never
overwritten. What has no commit file isn't there: a batch that broke off, or is replayed, changes nothing that a reader
sees, and a batch whose commit file exists is left alone. Readers take the newest commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Commits:
    """The commit files of a table: one JSON document for each batch id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{name}")

    def ids(self) -> list[int]:
        folder = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        fs = folder.getFileSystem(self.conf)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, batch_id: int) -> dict:
        return json.loads(self.spark.read.text(self._path(f"{batch_id}.json").toString(), wholetext=True).first()[0])

    def write(self, batch_id: int, what: dict) -> None:
        """Makes the commit file, or fails if it is there."""
        made, final = self._path(f".{batch_id}-{uuid.uuid4().hex}"), self._path(f"{batch_id}.json")
        fs = final.getFileSystem(self.conf)
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(made, final, none)  # atomic, and an error if the other exists

    def delete(self, name: str) -> None:
        where = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.conf).delete(where, True)


class UpsertTable:
    """A table of one row for each key, dealt out in buckets by a hash of the key; a batch writes the buckets that it has rows of.

    merge: the rows of the table and of a batch together -> one row for each key, in the table's schema. It is to be
    associative, so that the table doesn't depend on how rows fall into batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 16, keep: int = 3) -> None:
        self.spark, self.path, self.schema, self.keys, self.merge = spark, path.rstrip("/"), schema, keys, merge
        self.buckets, self.keep, self.commits = buckets, keep, Commits(spark, path)

    def read(self) -> DataFrame:
        """The table after its newest commit."""
        ids = self.commits.ids()
        return self._of(self.commits.read(ids[-1])["buckets"].values() if ids else [])

    def _of(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Merges rows (in the table's schema, several for a key too) as batch batch_id: once, however often it is called.

        Rows with a null key are those of one key. A batch without rows commits the table as it was.
        """
        ids = self.commits.ids()
        if ids and batch_id <= ids[-1]:
            return
        now: dict[str, str] = self.commits.read(ids[-1])["buckets"] if ids else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        part = self.merge(rows).withColumn("_bucket", bucket)
        version = f"v{batch_id}-{uuid.uuid4().hex}"
        fresh = f"{self.path}/{version}/batch"
        part.repartition("_bucket").write.partitionBy("_bucket").parquet(fresh)
        touched = [r[0] for r in self.spark.read.parquet(fresh).select("_bucket").distinct().collect()] if self._has(fresh) else []
        old = [now[str(b)] for b in touched if str(b) in now]
        names = [f.split()[0] for f in self._of([]).columns]
        both = self._of(old).unionByName(self.spark.read.schema(f"{self.schema}, _bucket int").parquet(fresh).select(*names)) if touched else None
        if both is not None:
            merged = self.merge(both).withColumn("_bucket", bucket)
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}/table")
            now = now | {str(b): f"{version}/table/_bucket={b}" for b in touched}
        self.commits.write(batch_id, {"buckets": now})
        self.commits.delete(f"{version}/batch")
        self._tidy(ids + [batch_id])

    def _has(self, path: str) -> bool:
        where = self.commits.jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.commits.conf)
        return any(f.isDirectory() for f in fs.listStatus(where))

    def _tidy(self, ids: list[int]) -> None:
        """Deletes versions that none of the last `keep` commits names, and the commits before these."""
        named = {f.split("/")[0] for k in ids[-self.keep :] for f in self.commits.read(k)["buckets"].values()}
        where = self.commits.jvm.org.apache.hadoop.fs.Path(self.path)
        for f in where.getFileSystem(self.commits.conf).listStatus(where):
            name = f.getPath().getName()
            if name.startswith("v") and name not in named:
                self.commits.delete(name)
        for k in ids[: -self.keep]:
            self.commits.delete(f"_commits/{k}.json")

    def sink(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        """A writer of the stream into the table; start it with .start()."""
        return stream.writeStream.foreachBatch(lambda rows, batch_id: self.upsert(prepare(rows), batch_id)).option("checkpointLocation", checkpoint)


class AppendTable:
    """A log that grows by one folder for each batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema, self.commits = spark, path.rstrip("/"), schema, Commits(spark, path)

    def read(self) -> DataFrame:
        paths = [f"{self.path}/{self.commits.read(k)['folder']}" for k in self.commits.ids()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of batch batch_id, once."""
        if batch_id in self.commits.ids():
            return
        folder = f"b{batch_id}-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/{folder}")
        self.commits.write(batch_id, {"folder": folder})

    def sink(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda rows, batch_id: self.append(rows, batch_id)).option("checkpointLocation", checkpoint)


RECORDS = "device_id long, sessions long, faults long, last_at timestamp, last_id long, last_fault int, errors array<struct<at: timestamp, id: long, error: int>>"


def record_parts(lines: DataFrame) -> DataFrame:
    """Lines (device_id, event_id, at, fault, error) as records of one session each."""
    error = F.array(F.struct(F.col("at"), F.col("event_id").alias("id"), F.col("error").cast("int").alias("error")))
    return lines.select("device_id", F.lit(1).cast("long").alias("sessions"), (F.coalesce(F.col("fault"), F.lit(0)) != 0).cast("long").alias("faults"), F.col("at").alias("last_at"), F.col("event_id").alias("last_id"), F.col("fault").cast("int").alias("last_fault"), error.alias("errors"))


def merged_records(parts: DataFrame, most_errors: int = 5) -> DataFrame:
    """Counters added up, the fault of the last session, the errors of the last most_errors, newest last."""
    last = F.struct("last_at", "last_id")
    errors = parts.select("device_id", F.explode("errors").alias("e")).withColumn("salt", F.pmod(F.xxhash64("e"), F.lit(16)))
    for by in (["device_id", "salt"], ["device_id"]):  # a device may have any share of the lines
        back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("e.at"), F.desc("e.id")))
        errors = errors.withColumn("back", back).filter(F.col("back") <= most_errors)
    errors = errors.groupBy("device_id").agg(F.array_sort(F.collect_list("e")).alias("errors"))
    sums = parts.groupBy("device_id").agg(
        F.sum("sessions").alias("sessions"), F.sum("faults").alias("faults"), F.max(last).alias("last"), F.max_by("last_fault", last).alias("last_fault")
    )
    found = sums.join(errors.withColumnRenamed("device_id", "own"), F.col("device_id").eqNullSafe(F.col("own")), "left")
    none = F.expr("CAST(array() AS array<struct<at: timestamp, id: bigint, error: int>>)")
    return found.select("device_id", "sessions", "faults", F.col("last.last_at").alias("last_at"), F.col("last.last_id").alias("last_id"), "last_fault", F.coalesce("errors", none).alias("errors"))


def records_table(spark: SparkSession, path: str, buckets: int = 16) -> UpsertTable:
    """The record of each device, kept by a stream of session lines."""
    return UpsertTable(spark, path, RECORDS, ["device_id"], merged_records, buckets)


def erase(table: UpsertTable, batch_id: int) -> None:
    """As batch batch_id, an empty table."""
    if not (ids := table.commits.ids()) or batch_id > ids[-1]:
        table.commits.write(batch_id, {"buckets": {}})
