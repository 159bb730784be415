"""Pending schedules as keyed state with one processing-time timer per ID."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from delayfold.model import LANE
from delayfold.streaming.resolve import (
    CLOSER,
    PACKED,
    PAYLOAD,
    RESOLVED,
    STATE_LANE,
    resolve_within_batch,
    stateful,
    unpacked,
)

_KEPT = ("schedule_id", *LANE, "offset", "arrival_ms", *PAYLOAD, "seen_ms", "fire_ms")

PENDING_STATE = "pending"
PENDING = T.StructType([f for f in RESOLVED if f.name in _KEPT])

FIRED = T.StructType([*PENDING, T.StructField("fired_ms", T.LongType())])

_LATER_MS = 1_000


def fired_rows(resolved: pa.RecordBatch, now: int) -> pa.Table:
    """Schedules that fired within a micro-batch, as `FIRED`."""
    rows = pa.table(resolved.select(PENDING.fieldNames()))
    return rows.append_column("fired_ms", pa.array([now] * len(rows), pa.int64()))


class PendingSchedules(StatefulProcessor):
    """An update replaces the pending schedule, any other command cancels it, its timer fires it.

    While `held`, the log up to the start is still being read: nothing fires, timers that go off are
    set again.
    """

    output = FIRED

    def __init__(self, held: bool = False):
        self.held = held

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState(PENDING_STATE, PENDING)

    def _fired(self, schedule: Row, now: int) -> Row:
        return Row(**{n: schedule[n] for n in PENDING.fieldNames()}, fired_ms=now, **{PACKED: None})

    def _closed(self, schedule: Row, by: Row) -> Iterable[Row]:
        """Rows for a schedule that the next command of its ID closes."""
        return ()

    def _passes(self, row: Row) -> Row:
        """Packed rows, on a lane of their own."""
        return Row(**dict.fromkeys(self.output.fieldNames()), **{PACKED: row[PACKED]})

    def _load(self) -> Row | None:
        value = self.pending.get()
        return None if value is None else Row(*PENDING.fieldNames())(*value)

    def _arm(self, schedule: Row) -> None:
        self.pending.update(tuple(schedule[n] for n in PENDING.fieldNames()))
        self.handle.registerTimer(schedule["fire_ms"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._arm(initialState)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if key[1] != STATE_LANE:
            for row in rows:
                yield self._passes(row)
            return
        # At most two rows: the last command of the micro-batch, and a first one that closes.
        first = last = None
        for row in rows:
            if row["command"] == CLOSER:
                first = row
            else:
                last = row
        stored = self._load()
        if stored is not None:
            closer = first or last
            if not self.held and stored["fire_ms"] < closer["seen_ms"] and stored["fire_ms"] <= now:
                yield self._fired(stored, now)
            else:
                yield from self._closed(stored, closer)
            self.handle.deleteTimer(stored["fire_ms"])
        if last["command"] == "update":
            self._arm(last)
        elif stored is not None:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        schedule, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        if schedule is None or schedule["fire_ms"] > now:
            return
        if self.held:
            self.handle.registerTimer(now + _LATER_MS)
            return
        self.pending.clear()
        yield self._fired(schedule, now)

    def close(self) -> None:
        pass


def keyed(resolved: DataFrame, processor: PendingSchedules, waiting: DataFrame | None) -> DataFrame:
    """Runs the processor over resolved rows, by ID and lane, from the schedules that wait at the start."""
    initial = None
    if waiting is not None:
        initial = (
            stateful(waiting)
            .select(F.col("schedule_id").alias("state_id"), *PENDING.fieldNames())
            .withColumn("lane", F.lit(STATE_LANE))
            .groupBy("state_id", "lane")
        )
    output = T.StructType([*processor.output, T.StructField(PACKED, T.BinaryType())])
    return unpacked(
        resolved.groupBy("state_id", "lane").transformWithState(
            processor, output, "append", "processingTime", initial
        )
    )


def fire_stream(
    commands: DataFrame, waiting: DataFrame | None = None, held: bool = False
) -> DataFrame:
    """Stream of commands to stream of fired schedules.

    waiting: schedules that wait when the stream starts (`state.waiting_at_gate` over the log up to
    that point). They are loaded before the first batch, so nothing fires ahead of a command that
    was already in the log. held: nothing fires at all; for catching up after a stop (`run.resume`).
    """
    resolved = resolve_within_batch(commands, fired_rows, held)
    fired = keyed(resolved, PendingSchedules(held), waiting)
    return fired.withColumn("out_headers", F.map_from_entries("out_headers"))
