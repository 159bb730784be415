"""Epoch milliseconds. Due times cover the whole BIGINT range, so they never become timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from delayfold.model import MAX_DELAY_MS


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def shifted_now_ms(seconds: Column) -> Column:
    """The same clock set ahead (or back) by a number of seconds."""
    return now_ms() + seconds.cast("bigint") * 1000


def delay_ms(due: Column, now: Column) -> Column:
    """Wait until `due`: nothing when past due, at most MAX_DELAY_MS, and never an overflow."""
    longest = F.lit(MAX_DELAY_MS).cast("bigint")
    wait = F.coalesce(F.try_subtract(due, now), longest)
    return F.when(due <= now, F.lit(0).cast("bigint")).otherwise(F.least(wait, longest))


def fire_ms(arrival: Column, due: Column, gate_ms: int = 0) -> Column:
    """When an update fires if no later command of its ID comes first; null without a due time."""
    latest = F.coalesce(F.try_add(arrival, F.lit(MAX_DELAY_MS).cast("bigint")), due)
    fires = F.greatest(arrival, F.least(due, latest), F.lit(gate_ms).cast("bigint"))
    return F.when(due.isNotNull(), fires)
