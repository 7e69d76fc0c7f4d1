"""Visits to the rest position that check and correct a device's count of steps, and what else guards its moves."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.gated import ordered_fold

# Microsteps in a step and out of tolerance, retries, the retry's share of the way, fault codes.
MICROSTEPS, TOLERATED, RETRIES, AMPLITUDE, DRIFT, INTEGRITY = 32, 30 * 32, 1, 0.7, 7, 6
OUT = "event_id long, branch string, passed boolean, error_steps int, corrected long, retries int, fault int"


def _whole_steps(error: int) -> int:
    return int(error / MICROSTEPS)


def visit(closed: bool, way: float, reached: bool, error: int) -> tuple[str, bool, int | None, int, int]:
    """One visit: branch, passed, error in steps, microsteps to correct the count by, fault.

    With the switch closed already the count is compared as it is; away from it a way of no length fails; a move must
    close the switch, and its error is taken off the count without further notice. Either error may be a drift.
    """
    if not closed and way <= 0.2:
        return "stuck", False, None, 0, 0
    if not closed and not reached:
        return "open", False, None, 0, 0
    branch = "resting" if closed else "moved"
    if abs(error) > TOLERATED:
        return branch, False, _whole_steps(error), 0, DRIFT
    return branch, True, _whole_steps(error), 0 if closed else error, 0


def _visits(state: tuple | None, event_id: int, begins: bool | None, closed: bool, way: float, reached: bool, error: int, reached_again: bool, error_again: int) -> tuple:
    corrected, retries, fault = state or (0, 0, 0)
    if begins:
        corrected, retries, fault = 0, 0, 0
    branch, passed, steps, off, found = visit(closed, way, reached, error)
    fault = found or fault
    if passed:
        retries = 0
    elif retries >= RETRIES:
        fault = INTEGRITY
    else:  # released, after a wait, once more and less far
        retries += 1
        branch, passed, steps, off, found = visit(False, way * AMPLITUDE, reached_again, error_again)
        branch = "again_" + branch
        fault = INTEGRITY if not passed else 0 if fault == DRIFT else fault
    corrected += off
    return (corrected, retries, fault), (event_id, branch, passed, steps, corrected, retries, fault)


def visits(df: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each visit of a device with its one retry: branch, passed, error_steps (null: none was taken), corrected
    (microsteps off the count so far), retries, fault.

    df has event_id, begins (a session: counts and fault are cleared), closed, way, reached, error, and reached_again
    and error_again for the retry. A visit that passes gives the next one its retry back; a retry that passes clears a
    drift, one that fails is a fault of integrity.
    """
    columns = ["event_id", "begins", "closed", "way", "reached", "error", "reached_again", "error_again"]
    return ordered_fold(df, _visits, key, list(order), columns, OUT)


def unverified(df: DataFrame, stroke: Column, register: Column, want: int, key: str, order: list[str]) -> DataFrame:
    """The strokes before which the last reading of the register isn't `want`; one that was never read is not."""
    last = F.last(register, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"register": last, "_stroke": stroke})
    return rows.filter(F.col("_stroke") & ~F.coalesce(F.col("register") == want, F.lit(False))).drop("_stroke")


def _commanded(state: tuple | None, event_id: int, us: int, signal: str | None, command: str | None, advance, hang_us: int, begin: str) -> tuple:
    now, fault, sessions, faults, until = state or (begin, 0, 0, 0, None)
    answer = None
    if until is not None and us < until:  # nothing is heard until the watchdog's reset
        return (now, fault, sessions, faults, until), (event_id, "HUNG", fault, sessions, faults, None)
    if until is not None:
        now, fault, until = begin, 0, None
    if command == "H":
        until, answer = us + hang_us, "hangs"
    elif command == "Z":
        sessions, faults, answer = 0, 0, "erased"
    elif command == "i":
        answer = f"{now} {sessions}/{faults}"
    elif signal is not None:
        before, (now, fault) = now, advance(now, fault, signal)
        sessions += now == "RUNNING" and before != "RUNNING"
        faults += now == "FAULT" and before != "FAULT"
    return (now, fault, sessions, faults, until), (event_id, now if until is None else "HUNG", fault, sessions, faults, answer)


def commanded(signals: DataFrame, commands: DataFrame, advance, hang_us: int = 2_000_000, begin: str = "BOOT") -> DataFrame:
    """A device's signals (event_id, user_id, ts, signal) with the commands (the same, command) that come in between.

    'i' answers with state and log, 'Z' erases the log, 'H' hangs the device until its watchdog begins anew; other
    commands, and nulls, do nothing. One row for each row of both: event_id, state, fault, sessions, faults, answer.
    """
    both = signals.select("user_id", "event_id", "ts", "signal", F.lit(None).cast("string").alias("command"))
    both = both.unionByName(commands.select("user_id", "event_id", "ts", F.lit(None).cast("string").alias("signal"), "command"))
    step = partial(_commanded, advance=advance, hang_us=hang_us, begin=begin)
    return ordered_fold(both, step, "user_id", ["ts", "event_id"], ["event_id", "ts", "signal", "command"], "event_id long, state string, fault int, sessions long, faults long, answer string")
