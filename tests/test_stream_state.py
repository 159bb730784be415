import time

import pytest
from pyspark.sql import functions as F

from delayfold.operators import state
from delayfold.streaming import inspect
from delayfold.streaming.run import drain, start_outbox
from delayfold.streaming.timers import fire_stream
from frames import commands

HOUR = 3_600_000


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Two files, read one after the other: schedules that wait, are moved, cancelled, or fire."""
    folder, now = tmp_path_factory.mktemp("state"), int(time.time() * 1000)
    update = lambda name, due, **more: {"schedule_id": name, "due_ms": due, **more}
    first = [update("a", now + HOUR), update("b", now + HOUR), update("c", now + HOUR), update("past", now - HOUR)]
    second = [
        update("a", now + 2 * HOUR, out_headers=None),
        {"schedule_id": "b", "command": "delete"},
        {"schedule_id": "none", "command": "error"},
    ]
    schema = None
    for name, rows in (("1", first), ("2", second)):
        rows = [{"arrival_ms": now - HOUR + int(name), "offset": int(name) * 10 + i, **r} for i, r in enumerate(rows)]
        frame = commands(spark, rows)[0].drop("error").coalesce(1)
        schema = frame.schema
        frame.write.parquet(str(folder / "log" / name))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "log" / "*"))
    checkpoint = str(folder / "checkpoint")
    drain(start_outbox(fire_stream(log), str(folder / "outbox"), checkpoint))
    return checkpoint, now, spark.read.schema(schema).parquet(str(folder / "log" / "*"))


def test_state_is_what_the_log_says(spark, place):
    checkpoint, now, log = place
    names = ("schedule_id", "offset", "due_ms", "seen_ms", "fire_ms", "out_key", "out_headers")
    log = log.withColumn("error", F.lit(None))
    expected = state.pending_at(log, now).select(*names).collect()
    got = inspect.pending_in_stream(spark, checkpoint).select(*names).collect()
    assert sorted(got) == sorted(expected) and {r.schedule_id for r in got} == {"a", "c"}
    headers = {r.schedule_id: r.out_headers for r in got}
    assert headers["a"] is None and headers["c"] == {"h": bytearray(b"x")}


def test_every_schedule_has_its_timer(spark, place):
    checkpoint, now, _ = place
    timers = {r.schedule_id: r.timer_ms for r in inspect.timers_in_stream(spark, checkpoint).collect()}
    assert timers == {"a": now + 2 * HOUR, "c": now + HOUR}
    waiting = inspect.pending_in_stream(spark, checkpoint).collect()
    assert all(r.timer_ms == r.fire_ms for r in waiting)


def test_not_due_by(spark, place):
    checkpoint, now, _ = place
    later = inspect.pending_in_stream(spark, checkpoint, at_ms=now + HOUR).collect()
    assert [r.schedule_id for r in later] == ["a"]


def test_an_earlier_batch(spark, place):
    checkpoint, now, _ = place
    before = {r.schedule_id: r.due_ms for r in inspect.schedules_in_stream(spark, checkpoint, 0).collect()}
    assert before == dict.fromkeys("abc", now + HOUR)


def test_lookup_finds_hits_and_misses(spark, place):
    ids = spark.createDataFrame([("a",), ("b",), ("zz",), ("a",)], "schedule_id string")
    found = inspect.lookup_in_stream(spark, place[0], ids).collect()
    assert sorted((r.schedule_id, r.found) for r in found) == [("a", True), ("a", True), ("b", False), ("zz", False)]


def test_other_checkpoints_are_refused(spark, tmp_path):
    source = spark.readStream.format("rate").load().groupBy("value").count()
    query = source.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c"))
    running = query.trigger(availableNow=True).start()
    running.awaitTermination(120)
    with pytest.raises(ValueError, match="firing query"):
        inspect.schedules_in_stream(spark, str(tmp_path / "c"))
