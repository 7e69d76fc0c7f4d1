"""Collects the named queries: each with its function and, where SQL can state it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable, str | None]] = {}
ORDER = ["ts", "event_id"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are those of UTC, whatever the session's zone is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.concat(F.col(c).cast("string"), F.lit("Z")).cast("timestamp") for c in ntz}) if ntz else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


#: Generator states of the seeds in SQL, two a row (k: the pair's number from 0), with the two normal deviates they make.
_SHIFT = "xor(xor({0}, ({0} << 13) & 4294967295), xor({0}, ({0} << 13) & 4294967295) >> 17)"
_NEXT = f"xor({_SHIFT}, ({_SHIFT} << 5) & 4294967295)"


def normals_sql(sessions: int, pairs: int) -> str:
    """CTEs g (session_id, k, s1, s2) and z (session_id, k from 1, z): R1 to R3 for the batch's seeds."""
    radius = "sqrt(-2 * ln(greatest((s1 >> 8) / 16777216.0::DOUBLE, 1e-7::DOUBLE)))"
    turn = "2 * pi() * ((s2 >> 8) / 16777216.0::DOUBLE)"
    first = f"SELECT session_id, 0 AS k, {_NEXT.format('s')} AS s1 FROM (SELECT r.k AS session_id, (4096 + r.k * 2654435761) % 4294967296 AS s FROM range({sessions}) r(k))"
    return f"""g0 AS ({first} UNION ALL SELECT session_id, k + 1, {_NEXT.format("s1")} FROM g0 WHERE k < {2 * pairs - 1}),
g AS (SELECT a.session_id, a.k // 2 AS k, a.s1, b.s1 AS s2 FROM g0 a JOIN g0 b ON a.session_id = b.session_id AND b.k = a.k + 1 AND a.k % 2 = 0),
z AS (SELECT session_id, 2 * k + 1 AS k, {radius} * cos({turn}) AS z FROM g UNION ALL SELECT session_id, 2 * k + 2, {radius} * sin({turn}) FROM g)"""


def reflect_sql(x: str, low: float, high: float) -> str:
    """R4's fold in SQL."""
    span = 2 * (high - low)
    return f"({high} - abs(((({x}) - ({low})) % {span} + {span}) % {span} - {high - low}))"
