"""Exact duplicates by content sort.

Sampled splitters deal the texts out by their normalised bytes (a leading part, then a hash of all, then a salt, so that a
text that makes up a third of all rows still spreads over many tasks). Each task sorts its range, which spills to disk,
so equal texts are neighbours; whole neighbouring texts are compared. Only the first and the last run of a task can go
on in the next one: those few are put together at the end by their whole texts, and each task's rows learn of it by the
task's number, so that no key holds more rows than a task had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lowered, named, small, unused, written

#: Leading bytes of a text by which the ranges are cut first.
HEAD_BYTES = 48


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of content -> the same rows with their run's largest id, size and digest.

    place: the task's number and the run's in it, for those runs that may go on in another task (null for others): runs
    of the first or the last hash here. The first row of such a run has the whole text.
    """
    task, n_runs = TaskContext.get().partitionId(), 0
    hashed: int | None = None  # of the last run
    at_start = True
    waiting: list[tuple[bytes, list[pa.Array]]] = []  # runs of the last hash: text, ids in parts

    def closed(runs: list[tuple[bytes, list[pa.Array], bool]]) -> pa.RecordBatch:
        """The rows of runs (text, ids in parts, whether it may go on elsewhere)."""
        nonlocal n_runs
        sizes = np.array([sum(map(len, ids)) for _, ids, _ in runs])
        run, begin = np.repeat(np.arange(len(runs)), sizes), np.cumsum(sizes) - sizes
        ids = pa.concat_arrays([part for _, parts, _ in runs for part in parts])
        place = [(task << 32) + n_runs + k if edge else None for k, (_, _, edge) in enumerate(runs)]
        n_runs += len(runs)
        first = np.zeros(len(run), bool)
        first[begin] = True
        whole = pa.array([text if edge else None for text, _, edge in runs], pa.binary()).take(pa.array(run, mask=~first))
        sha = pa.array([hashlib.sha256(text).hexdigest() for text, _, _ in runs], pa.string())
        at = pa.array(run)
        return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(begin[run])), pa.array(sizes[run]), sha.take(at), pa.array(place, pa.int64()).take(at), whole], names=["doc_id", "keep_id", "group_size", "text_sha256", "place", "norm"])

    for batch in small(batches):
        ids, norm, hashes = batch.column("doc_id"), batch.column("norm").to_pylist(), batch.column("hash").to_pylist()
        last = waiting[-1][0] if waiting else None
        starts = [k for k, text in enumerate(norm) if text != (norm[k - 1] if k else last)]
        if not starts:
            waiting[-1][1].append(ids)
            continue
        if starts[0]:
            waiting[-1][1].append(ids.slice(0, starts[0]))
        done: list[tuple[bytes, list[pa.Array], bool]] = []
        for a, b in zip(starts, [*starts[1:], len(norm)], strict=True):
            if hashes[a] != hashed:
                if waiting:
                    done += [(*run, at_start) for run in waiting]
                    at_start, waiting = False, []
                hashed = hashes[a]
            waiting.append((norm[a], [ids.slice(a, b - a)]))
        if done:
            yield closed(done)
    if waiting:
        yield closed([(*run, True) for run in waiting])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is an empty one, so null and empty texts form one group; texts are equal when they are after
    lower-casing A-Z. The row with the largest id stays; a null id is smaller than any other. Rows that repeat an id
    count as rows of the group and say the same of it. An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("doc_id"), lowered(named(text_col)).cast("binary").alias("norm"))
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD_BYTES), "hash": F.xxhash64("norm"), "salt": F.xxhash64("doc_id")})
    placed = rows.repartitionByRange("head", "hash", "salt").sortWithinPartitions("head", "hash", "norm", F.desc_nulls_last("doc_id"))
    runs = placed.select("doc_id", "norm", "hash").mapInArrow(_runs, f"doc_id {kind}, keep_id {kind}, group_size long, text_sha256 string, place long, norm binary")
    runs = written(runs, "runs")
    # a row for each run at the edge of a task, most often two of each
    edges = runs.filter("norm IS NOT NULL").select("norm", "place", F.col("keep_id").alias("keep"), F.col("group_size").alias("size"))
    whole = edges.groupBy("norm").agg(F.max("keep").alias("keep_id"), F.sum("size").alias("group_size"))
    known = edges.select("norm", "place").join(whole, "norm").drop("norm")
    at_edge = runs.filter("place IS NOT NULL").select("doc_id", "text_sha256", "place").join(known, "place")
    out = runs.filter("place IS NULL").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(at_edge.drop("place"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one of each group, also where ids repeat or are null.

    The row with the largest id stays, a null id being the smallest; of several such rows, one. A null text is an empty
    one. Columns may have any names; an empty table gives an empty result. Each row's number is written once, with the row.
    """
    row = unused(docs.columns, "_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = exact_groups(keyed.select(F.struct(named(id_col).alias("id"), F.col(row).alias("row")).alias("doc_id"), named(text_col).alias("text")))
    kept = groups.filter("kept").select(F.col("doc_id.row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*map(named, docs.columns))


SQL_GROUPS = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
