"""Fired schedules to outgoing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from delayfold.functions.text import to_utf8
from delayfold.model import EXPIRED_KEY, EXPIRED_VALUE, HEADERS, OUTGOING

PUBLISH, TOMBSTONE = 0, 1


def _record(seq: int, topic: Column, key: Column, value: Column, headers: Column) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"),
        topic.alias("topic"),
        key.alias("key"),
        value.cast("binary").alias("value"),
        headers.cast(HEADERS).alias("headers"),
    )


def message(seq: int = PUBLISH) -> Column:
    """The delayed message itself."""
    headers = F.transform(
        F.map_entries("out_headers"),
        lambda h: F.struct(h["key"].alias("key"), h["value"].alias("value")),
    )
    return _record(seq, F.col("target_topic"), F.col("out_key"), F.col("out_value"), headers)


def tombstone(seq: int = TOMBSTONE) -> Column:
    """The delete that marks the schedule as done on the topic it came from."""
    mark = F.array(
        F.struct(F.lit(EXPIRED_KEY).alias("key"), F.lit(EXPIRED_VALUE.encode()).alias("value"))
    )
    return _record(
        seq, F.col("source_topic"), to_utf8(F.col("schedule_id")), F.lit(None), mark
    )


def publish_rows(fired: DataFrame) -> DataFrame:
    return fired.select(message().alias("_r")).select(*[f"_r.{n}" for n in OUTGOING.fieldNames()])


def tombstone_rows(fired: DataFrame) -> DataFrame:
    return fired.select(tombstone().alias("_r")).select(*[f"_r.{n}" for n in OUTGOING.fieldNames()])


def fire_rows(fired: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message, then tombstone, of each fired schedule; `seq` gives the order."""
    pair = F.explode(F.array(message(), tombstone())).alias("_r")
    return fired.select(*keep, pair).select(*keep, "_r.*")
