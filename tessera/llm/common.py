"""What the operators of this subpackage share: the shared folder, written tables, text columns."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python stage handles at a time: texts may be long, so few of them are Python objects at once.
BATCH_ROWS = 512
#: The folders below the shared one that written() uses, as workspace() sets them: each thread of the driver has its own.
_AT: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("tessera_workspace", default=())


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_ROWS at most, without empty ones. Spark itself bounds a batch's bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


def portions(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS rows and most_bytes of a binary column; a longer value is alone."""
    for batch in small(batches):
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        k = 0
        while k < len(ends):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most_bytes, "right")))
            yield batch.slice(k, upto - k)
            k = upto


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one set by SparkContext.setCheckpointDir.

    Where neither is set, a local folder serves a local master; on a cluster, where each executor would write to its own
    disk, that is an error.
    """
    if told := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return told
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
        pass


def written(df: DataFrame, name: str, above: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, and a lost executor loses nothing of it.

    above: outside the innermost workspace().
    """
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), "tessera", *(_AT.get()[:-1] if above else _AT.get()), f"{name}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again._tessera_path = path
    return again


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is written within, by the driver's thread, is deleted at the end, whatever that is."""
    token = _AT.set((*_AT.get(), uuid.uuid4().hex))
    path = "/".join([shared_folder(spark), "tessera", *_AT.get()])
    try:
        yield
    finally:
        _AT.reset(token)
        _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of make(), without the tables that it took to make it."""
    with workspace(spark):
        return written(make(), name, above=True)


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    if path := getattr(df, "_tessera_path", None):
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns: list[str], name: str) -> str:
    """A column name, beginning with `name`, that none of the columns has, however Spark treats case."""
    return name + "_" * max(map(len, columns), default=0)


def lowered(text: Column) -> Column:
    """A null is an empty text; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


class Words(dict):
    """Numbers words in order of first sight; `fresh` holds those since the last call of take()."""

    #: Bytes of words beyond which it is full, however few they are.
    MOST_BYTES = 32 << 20

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        self.bytes += sum(map(len, fresh))
        return fresh

    def full(self, most: int) -> bool:
        return len(self) > most or self.bytes > self.MOST_BYTES

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of `lengths` values (0 for empty runs), the same wherever a run lies."""
    out, some = np.zeros(len(lengths)), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64), (np.cumsum(lengths) - lengths)[some])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalising step of SplitMix64 on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
