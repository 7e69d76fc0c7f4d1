"""Ordered folds whose key may hold any share of the rows: a parallel prefix over maps that compose.

Rows are dealt out by ranges of (key, order), so a key's history is spread over as many tasks as it fills. What a stretch
of rows does to a state is a map; maps compose without the state being known. A task folds its rows to blocks, each with
the map from the key's start in the task to the block's, and gives one map for its first and one for its last key. Those
few, in order of tasks, give the state in which each task begins; then blocks are replayed row by row, each by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.operators.gated import ordered_fold
from tessera.sources.scratch import written

#: Rows of a block, and blocks that a task hands on together.
BLOCK, TOGETHER = 2048, 8


@dataclass(frozen=True)
class Maps:
    """What rows do to a state: schema (of a map's values), identity, of(*a row's values), then(first, second), apply(map,
    state), where the state is None before a key's first row, and state (the schema of a state, a tuple)."""

    schema: str
    identity: tuple
    of: Callable[..., tuple]
    then: Callable[[tuple, tuple], tuple]
    apply: Callable[[tuple, tuple | None], tuple | None]
    state: str


def _structs(rows: list[tuple], kind: StructType) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else ([] for _ in kind)
    return pa.StructArray.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], names=[f.name for f in kind])


def _blocks(batches: Iterator[pa.RecordBatch], maps: Maps, key: str, columns: list[str], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows in order -> task, key, head (whether it is the task's first key), before, rows; without rows: the map of a key over the task."""
    task, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
    map_kind, row_kind = schema["before"].dataType, schema["rows"].dataType.elementType
    now, begun, head, before, total = None, False, True, maps.identity, maps.identity
    rows: list[tuple] = []
    done: list[tuple] = []

    def close() -> None:
        nonlocal rows, before
        if rows:
            done.append((now, head, before, rows))
            rows, before = [], total

    def record() -> pa.RecordBatch:
        sizes = [0]
        for *_, r in done:
            sizes.append(sizes[-1] + len(r or ()))
        flat = _structs([x for *_, r in done for x in r or ()], row_kind)
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array([r is None for *_, r in done]))
        made = [pa.array([task] * len(done), pa.int32()), pa.array([d[0] for d in done], arrow.types[1]), pa.array([d[1] for d in done]), _structs([d[2] for d in done], map_kind), lists]
        done.clear()
        return pa.RecordBatch.from_arrays(made, names=arrow.names)

    for batch in batches:
        for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if not begun or k != now:
                close()
                if begun and head:
                    done.append((now, True, total, None))
                now, head, begun = k, not begun, True
                before = total = maps.identity
            rows.append(tuple(values))
            total = maps.then(total, maps.of(*values))
            if len(rows) == BLOCK:
                close()
        while len(done) >= TOGETHER:
            yield record()
    if begun:
        close()
        done.append((now, head, total, None))
        yield record()


def _start(state: tuple | None, task: int, *values, maps: Maps) -> tuple:
    """The state at a task's beginning, and that at its end to go on with; _fold's own state is (begun, state)."""
    now = state[0] if state else None
    empty = (None,) * len(maps.state.split(", "))
    return (maps.apply(values, now),), (task, now is not None, *(now or empty))


def _replayed(batches: Iterator[pa.RecordBatch], maps: Maps, step: Callable, schema: pa.Schema, states: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("rows")
        flat, ends = lists.flatten(), lists.offsets.to_pylist()
        values = [flat.field(k).to_pylist() for k in range(flat.type.num_fields)]
        starts = zip(batch.column("begun").to_pylist(), *(batch.column(c).to_pylist() for c in states), strict=True)
        befores = [tuple(b.values()) for b in batch.column("before").to_pylist()]
        for n, (key, before, (begun, *now)) in enumerate(zip(batch.column(0).to_pylist(), befores, starts, strict=True)):
            a, b = ends[n] - ends[0], ends[n + 1] - ends[0]
            state, found = maps.apply(before, tuple(now) if begun else None), []
            for row in zip(*(v[a:b] for v in values), strict=True):
                state, result = step(state, *row)
                found.append((key, *result))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)


def blocked_fold(df: DataFrame, step: Callable, maps: Maps, key: str, order: list[str], columns: list[str], out: str, parts: int | None = None) -> DataFrame:
    """What gated.ordered_fold(df, step, key, order, columns, out) gives, with any key spread over tasks.

    step's state is a tuple, or None at a key's first row; maps says the same of stretches of rows. Where maps add
    floating-point numbers up, a state that a block begins with is rounded otherwise than row by row. Rows with a null key
    are those of one key; rows with equal key and order stay together; an empty table gives an empty result. parts: the
    number of ranges; None: spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)
    micros = {c: F.unix_micros(c) for c in columns if kinds[c] == "timestamp"}
    placed = df.select(key, *dict.fromkeys([*order, *columns])).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    rows = placed.select(key, *(micros.get(c, F.col(c)).alias(f"v{k}") for k, c in enumerate(columns)))
    values = ", ".join(f"v{k}: {'bigint' if c in micros else kinds[c]}" for k, c in enumerate(columns))
    map_struct = _parse_datatype_string(maps.schema).simpleString()
    schema = _parse_datatype_string(f"task int, {key} {kinds[key]}, head boolean, before {map_struct}, rows array<struct<{values}>>")
    names = [f"v{k}" for k in range(len(columns))]
    blocks = written(rows.mapInArrow(partial(_blocks, maps=maps, key=key, columns=names, schema=schema), schema), "blocks")
    totals = blocks.filter("rows IS NULL").select("task", F.col(key), "before.*")
    states = [f"s{k}" for k in range(len(maps.state.split(", ")))]
    kept = ", ".join(f"s{k} {f.split()[1]}" for k, f in enumerate(maps.state.split(", ")))
    begun = ordered_fold(totals, partial(_start, maps=maps), key, ["task"], ["task", *(c for c in totals.columns if c not in ("task", key))], f"task int, begun boolean, {kept}")
    # a task's first key alone may have begun in another: a row for each task
    starts = begun.join(blocks.filter("rows IS NULL AND head").select("task", F.col(key).alias("own")), "task").filter(F.col(key).eqNullSafe(F.col("own")))
    starts = starts.select("task", F.lit(True).alias("head"), "begun", *states)
    met = blocks.filter("rows IS NOT NULL").join(starts, ["task", "head"], "left").select(key, "before", "rows", F.coalesce("begun", F.lit(False)).alias("begun"), *states)
    made = _parse_datatype_string(f"{key} {kinds[key]}, {out}")
    return met.mapInArrow(partial(_replayed, maps=maps, step=step, schema=to_arrow_schema(made), states=states), made)


def clamped_shifts(of: Callable[..., tuple[float, float, float]]) -> Maps:
    """States of one number x, and rows that make it min(high, max(low, x + shift)): of(*values) -> (shift, low, high)."""

    def then(f: tuple, g: tuple) -> tuple:
        clamp = lambda x: min(g[2], max(g[1], x + g[0]))
        return f[0] + g[0], clamp(f[1]), clamp(f[2])

    inf = float("inf")
    apply = lambda f, state: (min(f[2], max(f[1], (state[0] if state else 0.0) + f[0])),)
    return Maps("shift double, low double, high double", (0.0, -inf, inf), of, then, apply, "x double")


def _run_step(state: tuple | None, event_id: int, hit: bool | None) -> tuple:
    run = (state[0] if state else 0) + 1 if hit else 0
    return (run,), (event_id, run)


def hot_runs(df: DataFrame, hit: Column, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """event_id and run (how many rows in a row have had `hit`, 0 where this one hasn't), with any key spread over tasks."""
    maps = Maps(
        "begins boolean, n long", (False, 0), lambda _, hit: (False, 1) if hit else (True, 0),
        lambda f, g: g if g[0] else (f[0], f[1] + g[1]), lambda f, state: (f[1] if f[0] or not state else state[0] + f[1],), "run long",
    )
    return blocked_fold(df.withColumn("hit", hit), _run_step, maps, key, order, ["event_id", "hit"], "event_id long, run long", parts)


def affine(of: Callable[..., tuple[int, int]], prime: int) -> Maps:
    """States (x, n) of a number modulo prime and a count: a row makes them (a * x + b, n + 1), of(*values) -> (a, b)."""
    then = lambda f, g: (f[0] * g[0] % prime, (f[1] * g[0] + g[1]) % prime, f[2] + g[2])
    apply = lambda f, state: ((f[0] * (state[0] if state else 0) + f[1]) % prime, (state[1] if state else 0) + f[2])
    return Maps("a long, b long, n long", (1, 0, 0), lambda *v: (*of(*v), 1), then, apply, "x long, n long")


def transition_functions(states: list[str], start: str, next_of: Callable[[str, str | None], tuple[str, int]], clears: str) -> Maps:
    """A state machine with a first fault that stays: a map has, for each state to start in, the state that is reached,
    whether the fault was cleared on the way, and the first fault since. next_of(state, signal) -> (state, fault or 0)."""
    place = {s: k for k, s in enumerate(states)}
    known: dict[str | None, tuple] = {}

    def of(_event, _us, signal) -> tuple:
        if signal not in known:
            each = [next_of(s, signal) for s in states]
            cleared = [to == clears and s != to for s, (to, _) in zip(states, each, strict=True)]
            known[signal] = ([place[to] for to, _ in each], cleared, [0 if c else code for c, (_, code) in zip(cleared, each, strict=True)])
        return known[signal]

    def then(f: tuple, g: tuple) -> tuple:
        to, cleared, code = [], [], []
        for k, c, fault in zip(*f, strict=True):
            to.append(g[0][k])
            cleared.append(c or g[1][k])
            code.append(g[2][k] if g[1][k] else fault or g[2][k])
        return to, cleared, code

    def apply(f: tuple, state: tuple | None) -> tuple:
        now, fault = state or (start, 0)
        k = place[now]
        return states[f[0][k]], (0 if f[1][k] else fault) or f[2][k]

    n = len(states)
    return Maps("to array<int>, cleared array<boolean>, code array<int>", (list(range(n)), [False] * n, [0] * n), of, then, apply, "state string, fault int")
