"""Schedule tables to command records, ready for a command topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from delayfold.functions import avro_payload, json_payload
from delayfold.functions.text import to_utf8
from delayfold.model import HEADERS

_FIELDS = ("due_ms", "target_topic", "out_key", "out_value", "out_headers")


def _records(schedules: DataFrame, payload: Column, keep: tuple[str, ...]) -> DataFrame:
    return schedules.select(
        *keep,
        F.col("source_topic").alias("topic"),
        to_utf8(F.col("schedule_id")).alias("key"),
        payload.alias("value"),
        F.array().cast(HEADERS).alias("headers"),
    )


def to_json_records(schedules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One update record per schedule, JSON payload; `keep` names columns to carry along."""
    payload = to_utf8(json_payload.write(*[F.col(f) for f in _FIELDS]))
    return _records(schedules, payload, keep)


def to_avro_records(
    schedules: DataFrame, with_headers: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One update record per schedule, Avro payload; the older layout has no headers."""
    columns = [F.col(f) for f in _FIELDS]
    if not with_headers:
        columns[-1] = None
    return _records(schedules, avro_payload.write(*columns), keep)
