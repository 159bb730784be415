import pytest
from pyspark.sql import functions as F

from delayfold.operators import lifecycle as life, state
from frames import commands, formatted_plan, payload, records


def up(at, due=100, **more):
    return {"arrival_ms": at, "due_ms": due, **more}


LOG = [
    up(1, schedule_id="a"),
    up(2, schedule_id="b"),
    {"arrival_ms": 3, "command": "delete", "schedule_id": "b"},
    up(4, 6, schedule_id="c"),
    up(5, schedule_id="d"),
    {"arrival_ms": 6, "command": "delete", "is_expired": True, "schedule_id": "d"},
    up(7, schedule_id="a"),
]


def test_pending(spark):
    frame, _ = commands(spark, LOG)
    assert {r.schedule_id: r.offset for r in state.pending_at(frame, 50).collect()} == {"a": 6, "d": 4}
    assert {r.schedule_id for r in state.pending_at(frame, 5).collect()} == {"a", "c", "d"}


def test_waiting_at_gate_keeps_past_due(spark):
    frame, _ = commands(spark, LOG)
    waiting = {r.schedule_id: r.fire_ms for r in state.waiting_at_gate(frame, 50).collect()}
    assert waiting == {"a": 100, "c": 50, "d": 100}


def test_lookup(spark):
    frame, _ = commands(spark, LOG)
    ids = spark.createDataFrame([("a",), ("b",), ("zz",)], "schedule_id string")
    found = state.lookup(state.pending_at(frame, 50), ids).collect()
    assert {r.schedule_id: r.found for r in found} == {"a": True, "b": False, "zz": False}


def test_lookup_of_one_id_reaches_the_scan(spark, tmp_path):
    frame, _ = commands(spark, LOG)
    frame.drop("metadata", "error", "out_headers").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    one = state.pending_at(log, 50).where(F.col("schedule_id") == "a")
    assert "EqualTo(schedule_id,a)" in formatted_plan(one)
    assert [r.offset for r in one.collect()] == [6]


def test_compaction_per_topic(spark):
    rows = [
        up(1, source_topic="t"),
        up(2, source_topic="u"),
        up(3, source_topic="t"),
        {"arrival_ms": 4, "command": "delete", "source_topic": "u"},
        {"arrival_ms": 5, "command": "error", "schedule_id": "b"},
    ]
    frame, _ = commands(spark, rows)
    kept = lambda now: {r.offset for r in state.compact_per_topic(frame, now, 10).collect()}
    assert kept(14) == {2, 3, 4}
    assert kept(15) == {2, 4}


def test_compaction_keeps_the_highest_offset(spark):
    rows = [up(100, 500), {"arrival_ms": 50, "command": "delete"}]
    frame, _ = commands(spark, rows)
    assert {r.offset for r in state.compact_per_topic(frame, 60, 20).collect()} == {1}


def test_a_raw_log_is_ranked_before_it_is_decoded(spark):
    raw = records(spark, [payload(time=5), payload(time=10**6), None, "foobar"]).withColumn(
        "key", F.lit(b"a")
    )
    other = records(spark, [payload(time=2 * 10**12), "x"]).withColumn("key", F.concat(F.lit("b"), "offset").cast("binary"))
    log = raw.unionByName(other)
    found = state.latest_in_log(log).collect()
    assert {(r.schedule_id, r.command, r.offset) for r in found} == {
        ("a", "error", 3), ("b0", "update", 0), ("b1", "error", 1),
    }
    at = found[0].arrival_ms
    assert {r.schedule_id for r in state.pending_in_log(log, at + 1).collect()} == {"b0"}
    assert {r.schedule_id for r in state.waiting_in_log(log, at, json_topics=["t"]).collect()} == {"b0"}


def pending_ids(frame, at=50):
    return {(r.schedule_id, r.offset) for r in state.pending_at(frame, at).collect()}


def test_safe_compaction_replays_to_the_same_state(spark):
    frame, _ = commands(spark, LOG)
    kept = state.compact_safe(frame, 50)
    assert kept.columns == frame.columns
    assert pending_ids(kept) == pending_ids(frame) == {("a", 6), ("d", 4)}
    assert pending_ids(state.compact_safe(kept, 50)) == pending_ids(frame)


def test_per_topic_compaction_can_revive_and_lose(spark):
    revived = [
        up(1, source_topic="t"),
        {"arrival_ms": 2, "command": "delete", "source_topic": "u"},
    ]
    frame, _ = commands(spark, revived)
    assert pending_ids(frame) == set()
    assert pending_ids(state.compact_per_topic(frame, 50, 10)) == {("a", 0)}
    lost = [
        up(1, 5),
        up(6),
        {"arrival_ms": 7, "command": "delete", "is_expired": True},
    ]
    frame, _ = commands(spark, lost)
    assert pending_ids(frame) == {("a", 1)}
    assert pending_ids(state.compact_per_topic(frame, 50, 10)) == set()
    assert pending_ids(state.compact_safe(frame, 50)) == {("a", 1)}


@pytest.mark.parametrize("gate", [0, 4])
def test_pending_equals_lifecycle(spark, gate):
    frame, _ = commands(spark, LOG)
    history = life.lifecycle(frame, 5, gate).where(F.col("outcome") == "pending")
    assert {r.offset for r in history.collect()} == {
        r.offset for r in state.pending_at(frame, 5, gate).collect()
    }
