"""The whole service on Kafka: load what is there, then follow, fire and publish."""

from __future__ import annotations

import time
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from delayfold.model import Settings
from delayfold.operators.metrics import observed
from delayfold.operators.state import waiting_in_log
from delayfold.session import prepare
from delayfold.sources import kafka
from delayfold.streaming.run import has_run, resume, start_kafka
from delayfold.streaming.timers import fire_stream


def start(
    spark: SparkSession,
    settings: Settings,
    checkpoint: str,
    every: str = "1 second",
    client: dict[str, str] | None = None,
) -> StreamingQuery:
    """Starts the firing query between the configured topics; nothing fires before the log is loaded.

    The first start folds the log in batch, decoding the last record of each ID only, and hands the
    waiting schedules to the stream as its initial state; if that load fails, nothing is started. Where
    the checkpoint shows an earlier run, the stream first catches up with the log without firing.
    """
    prepare(spark)
    begin = partial(start_kafka, settings=settings, checkpoint=checkpoint, every=every, client=client)
    if has_run(spark, checkpoint):
        return resume(observed(kafka.follow(spark, settings)), begin)
    ends = kafka.offsets_option(kafka.end_offsets(spark, settings))
    log = kafka.raw_log(spark, settings, ends)
    waiting = waiting_in_log(log, int(time.time() * 1000), json_topics=settings.topics.json)
    return begin(fire_stream(observed(kafka.follow(spark, settings, ends)), waiting))
