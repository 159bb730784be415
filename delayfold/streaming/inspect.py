"""Reading what a firing query keeps, from its checkpoint: pending schedules, their timers, lookups.

Spark's state data source reads the snapshots and change files of the state stores in parallel, one task
a state partition; the running query is not asked and not disturbed. What is seen is the state as of a
committed micro-batch: the last one, or any that the checkpoint still holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from delayfold.operators.ordered import ID
from delayfold.operators.state import lookup
from delayfold.streaming.resolve import STATE_LANE
from delayfold.streaming.timers import PENDING, PENDING_STATE

_OPERATOR = "transformWithState"


def _operator_id(spark: SparkSession, checkpoint: str) -> int:
    """Number of the operator that holds the schedules in the query of a checkpoint."""
    found = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName")
    # One row for each stateful operator of the query.
    numbers = {r.operatorId for r in found.distinct().collect() if r.operatorName.startswith(_OPERATOR)}
    if len(numbers) != 1:
        raise ValueError(f"{checkpoint} is not the checkpoint of a firing query")
    return numbers.pop()


def _read(spark: SparkSession, checkpoint: str, batch_id: int | None, **options: str) -> DataFrame:
    reader = spark.read.format("statestore").option("operatorId", _operator_id(spark, checkpoint))
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    # Fired rows pass the operator on other lanes and leave nothing behind.
    return reader.options(**options).load(checkpoint).where(F.col("key.lane") == STATE_LANE)


def schedules_in_stream(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The schedules that the query keeps, one row per ID, headers as a map."""
    kept = _read(spark, checkpoint, batch_id, stateVarName=PENDING_STATE)
    headers = F.map_from_entries("value.out_headers")
    return kept.select(
        *[(headers if n == "out_headers" else F.col(f"value.{n}")).alias(n) for n in PENDING.fieldNames()]
    )


def timers_in_stream(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """schedule_id and timer_ms of every timer that is set."""
    timers = _read(spark, checkpoint, batch_id, readRegisteredTimers="true")
    return timers.select(F.col("key.state_id").alias(ID), F.col("expiration_timestamp_ms").alias("timer_ms"))


def pending_in_stream(
    spark: SparkSession, checkpoint: str, at_ms: int | None = None, batch_id: int | None = None
) -> DataFrame:
    """The schedules that wait, each with its `timer_ms`; with `at_ms` those that are not due by then.

    Both sides are keyed by ID and bounded by one row each, so the join is one shuffle. A schedule without
    a timer would never fire: its `timer_ms` is null here.
    """
    kept = schedules_in_stream(spark, checkpoint, batch_id)
    if at_ms is not None:
        kept = kept.where(F.col("fire_ms") > at_ms)
    return kept.join(timers_in_stream(spark, checkpoint, batch_id), ID, "left")


def lookup_in_stream(
    spark: SparkSession, checkpoint: str, ids: DataFrame, batch_id: int | None = None
) -> DataFrame:
    """What the query keeps for each asked ID; `found` tells hits from misses."""
    return lookup(schedules_in_stream(spark, checkpoint, batch_id), ids)
