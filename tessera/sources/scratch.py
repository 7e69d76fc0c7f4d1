"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder of SparkContext.setCheckpointDir; a local one only for a local master."""
    if told := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return told
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there and the session is still up."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to a new folder and reads it again: a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
