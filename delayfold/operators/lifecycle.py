"""What became of every schedule: replay of a command log as one ordered pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from delayfold.functions import clock
from delayfold.operators.decode import effective
from delayfold.operators.ordered import ID, Ordered, Slicing, split

IGNORE, COMPLETE = "ignore", "complete"


def as_of(commands: DataFrame, as_of_ms: int | None) -> DataFrame:
    """Cuts the log at a record time. This must come before the neighbours are looked up."""
    return commands if as_of_ms is None else commands.where(F.col("arrival_ms") <= as_of_ms)


def lifecycle(
    commands: DataFrame,
    as_of_ms: int | None = None,
    gate_ms: int = 0,
    expired_policy: str = IGNORE,
    rows: int | None = None,
    slicing: Slicing = Slicing(),
) -> DataFrame:
    """Every update with its `outcome`, `fire_ms` and `closed_ms`.

    An update fires at the latest of the time it was seen (`seen_ms`, see operators/ordered), its due
    time and the gate, unless a later command of the same ID is seen first or at the same ms. Outcomes: fired, superseded (by an update), canceled
    (by a delete), canceled_by_error, pending, and with the `complete` policy completed.

    expired_policy: `ignore` takes no notice of the deletes that report a fired schedule. `complete`
    lets such a delete close the pending update too, if that was due by then; a replay with a gate
    then does not fire again what the log shows as done. It counts as the next command (`next_ms`).
    """
    if expired_policy not in (IGNORE, COMPLETE):
        raise ValueError(f"unknown expired policy: {expired_policy}")
    cut = as_of(commands, as_of_ms)
    histories = []
    for part in split(effective(cut) if expired_policy == IGNORE else cut, rows, slicing):
        fire_ms = clock.fire_ms(F.col("seen_ms"), F.col("due_ms"), gate_ms)
        ordered = Ordered(part.rows.withColumn("fire_ms", fire_ms), part.cut)
        if expired_policy == COMPLETE:
            ordered = _with_closing_reports(ordered)
        history = ordered.add_next("_next", F.struct("seen_ms", "command", "is_expired")).done()
        histories.append(_outcomes(history.where(F.col("command") == "update"), as_of_ms))
    return reduce(DataFrame.unionByName, histories)


def _with_closing_reports(ordered: Ordered) -> Ordered:
    """Keeps the effective commands and those fired-reports that close the update before them.

    A report looks at the latest effective command; reports in between do not matter.
    """
    is_report = (F.col("command") == "delete") & F.col("is_expired")
    current = F.when(~is_report, F.struct("command", "due_ms", "fire_ms"))
    closes = (
        (F.col("_current.command") == "update")
        & (F.col("_current.due_ms") <= F.col("seen_ms"))
        & (F.col("seen_ms") <= F.col("_current.fire_ms"))
    )
    return ordered.add_last_before("_current", current).where(
        ~is_report | F.coalesce(closes, F.lit(False))
    )


def _outcomes(updates: DataFrame, as_of_ms: int | None) -> DataFrame:
    fires = F.col("_next").isNull() | (F.col("fire_ms") < F.col("_next.seen_ms"))
    reached = F.lit(True) if as_of_ms is None else F.col("fire_ms") <= as_of_ms
    outcome = (
        F.when(fires & reached, "fired")
        .when(fires, "pending")
        .when(F.col("_next.command") == "update", "superseded")
        .when(F.col("_next.command") == "error", "canceled_by_error")
        .when(F.col("_next.is_expired"), "completed")
        .otherwise("canceled")
    )
    closed = F.when(F.col("outcome") == "fired", F.col("fire_ms")).when(
        F.col("outcome") != "pending", F.col("_next.seen_ms")
    )
    return (
        updates.withColumns(
            {
                "next_ms": F.col("_next.seen_ms"),
                "next_command": F.col("_next.command"),
                "outcome": outcome,
            }
        )
        .withColumn("closed_ms", closed)
        .drop("_next", "_current")
    )


def fired(history: DataFrame, after_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Fired schedules, optionally only those fired in (after_ms, until_ms]."""
    rows = history.where(F.col("outcome") == "fired")
    if after_ms is not None:
        rows = rows.where(F.col("fire_ms") > after_ms)
    if until_ms is not None:
        rows = rows.where(F.col("fire_ms") <= until_ms)
    return rows


# Of a step: whose it is, when, which, and its log line.
_PLACE = (ID, "source_topic", "partition", "offset")
STEPS = (*_PLACE, "target_topic", "due_ms", "step", "at_ms", "line")


def _named() -> Column:
    return F.concat(F.lit("["), F.col(ID), F.lit("]"))


def update_steps(updates: DataFrame, scheduled: bool = True, closed: bool = True) -> DataFrame:
    """One row for each step of an update: that it was scheduled, and what became of it, unless it waits
    (no `closed_ms`). Fixed values: the lines."""
    steps = [
        F.struct(
            F.lit("scheduled").alias("step"),
            F.col("seen_ms").alias("at_ms"),
            F.concat(F.lit("Scheduled "), _named()).alias("line"),
        ),
        F.struct(
            F.col("outcome").alias("step"),
            F.col("closed_ms").alias("at_ms"),
            F.when(
                F.col("outcome") == "fired",
                F.concat(
                    F.lit("Scheduled "), _named(), F.lit(" to "), F.col("target_topic"),
                    F.lit(" due at "), F.col("due_ms"),
                ),
            ).alias("line"),
        ),
    ]
    wanted = [s for s, on in zip(steps, (scheduled, closed)) if on]
    return (
        updates.withColumn("_step", F.explode(F.array(*wanted)))
        .where(F.col("_step.at_ms").isNotNull())
        .select(*_PLACE, "target_topic", "due_ms", "_step.*")
        .select(*STEPS)
    )


def cancel_steps(commands: DataFrame) -> DataFrame:
    """One row for each effective delete and error that has an ID: it cancels and says so, also where
    nothing was waiting. Fixed values: the lines."""
    cancels = effective(commands).where(F.col("command") != "update").where(F.col(ID).isNotNull())
    return cancels.select(
        *_PLACE,
        F.lit(None).cast("string").alias("target_topic"),
        F.lit(None).cast("bigint").alias("due_ms"),
        F.lit("cancel").alias("step"),
        F.col("arrival_ms").alias("at_ms"),
        F.concat(F.lit("Canceled Schedule "), _named()).alias("line"),
    )


def transitions(commands: DataFrame, history: DataFrame) -> DataFrame:
    """Queue audit: one row per step of a schedule, and one per cancel, with its log line.

    `commands` is the log that `history` was made of, as of the same time.
    """
    return update_steps(history).unionByName(cancel_steps(commands))
