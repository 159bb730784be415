"""Starting, draining and reading the firing query."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from delayfold.model import OUTGOING
from delayfold.operators.publish import fire_rows
from delayfold.session import exists, prepare
from delayfold.sources.kafka import sink_options
from delayfold.streaming.timers import FIRED, fire_stream

_PAUSE_S = 3.0

# Carried next to each outgoing record, for audits and lag reports.
ORIGIN = tuple(n for n in FIRED.fieldNames() if not n.startswith("out_"))


@contextlib.contextmanager
def state_partitions(spark: SparkSession, partitions: int):
    """Inside, a stream starts with so many state partitions. The number is fixed for the life of a
    checkpoint, so it should suit the size that the stream shall grow to."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trigger(every: str, until_now: bool) -> dict:
    return {"availableNow": True} if until_now else {"processingTime": every}


def start_outbox(
    fired: DataFrame, path: str, checkpoint: str, every: str = "1 second", until_now: bool = False
) -> StreamingQuery:
    """Writes message and tombstone of each fired schedule to a parquet outbox.

    Spark's file sink notes the files of each batch in its log, so a batch that runs again after a
    failure does not double its rows. With `until_now` the source is read up to where it ends now.
    """
    prepare(fired.sparkSession)
    return (
        fire_rows(fired, keep=ORIGIN)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every, until_now))
        .start()
    )


def start_kafka(
    fired: DataFrame,
    settings,
    checkpoint: str,
    every: str = "1 second",
    until_now: bool = False,
    client: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Writes the same records to their topics, at least once. `client` settings win over the presets."""
    prepare(fired.sparkSession)
    return (
        fire_rows(fired)
        .select(*OUTGOING.fieldNames())
        .writeStream.format("kafka")
        .options(**sink_options(settings.producer, **(client or {})))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every, until_now))
        .start()
    )


def has_run(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream has committed a batch under this checkpoint."""
    return exists(spark, f"{checkpoint.rstrip('/')}/commits/0")


def resume(commands: DataFrame, begin: Callable[..., StreamingQuery]) -> StreamingQuery:
    """Goes on from a checkpoint as from a first start: nothing fires until all that is in the log by
    now is read, in as many micro-batches as it takes.

    begin(fired, until_now) starts the query on its sink and checkpoint, as `start_outbox` does.
    """
    catch_up = begin(fire_stream(commands, held=True), until_now=True)
    _stop_after(catch_up, lambda progress: progress["numInputRows"] == 0, 1, None)
    return begin(fire_stream(commands), until_now=False)


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _stop_after(
    query: StreamingQuery, idle: Callable[[dict], bool], times: int, timeout_s: float | None
) -> None:
    """Stops the query after so many idle batches in a row; between two batches, if there is a pause
    within a few seconds, so that no write is cut off."""
    deadline = None if timeout_s is None else time.monotonic() + timeout_s
    seen, still = -1, 0
    try:
        while still < times:
            if query.exception() is not None:
                raise query.exception()
            if not query.isActive:
                return
            if deadline is not None and time.monotonic() > deadline:
                raise TimeoutError(f"stream not idle after {timeout_s} s")
            for progress in query.recentProgress:
                if progress["batchId"] > seen:
                    seen = progress["batchId"]
                    still = still + 1 if idle(progress) else 0
            time.sleep(0.02)
        pause = time.monotonic() + _PAUSE_S
        while query.status["isTriggerActive"] and time.monotonic() < pause:
            time.sleep(0.01)
    finally:
        query.stop()


def drain(query: StreamingQuery, quiet: int = 2, timeout_s: float | None = None) -> None:
    """Waits until `quiet` batches in a row had no input and changed no state, then stops.

    A query with processing-time timers never ends by itself, also not with an available-now trigger.
    """

    def idle(progress: dict) -> bool:
        return progress["numInputRows"] == 0 and not any(
            op["numRowsUpdated"] > 0 or op["numRowsRemoved"] > 0 for op in progress["stateOperators"]
        )

    _stop_after(query, idle, quiet, timeout_s)
