import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from delayfold.model import COMMANDS
from delayfold.operators import lifecycle as life, metrics, state
from delayfold.operators.decode import decode_json
from delayfold.sources import logs
from delayfold.streaming.resolve import _FROM_COMMAND, GROUPS, KEYED, RESOLVED, _settle, _settle_group
from delayfold.streaming.run import drain, has_run, read_outbox, resume, start_outbox
from delayfold.streaming.timers import FIRED, fire_stream, fired_rows
from frames import b64, commands, payload, records


def share(rows, now=10**6):
    """One task's share; rows are (id, arrival, offset, command, due)."""
    columns = {n: [None] * len(rows) for n in _FROM_COMMAND}
    columns |= {
        "schedule_id": [r[0] for r in rows],
        "source_topic": ["t"] * len(rows),
        "partition": pa.array([0] * len(rows), pa.int32()),
        "arrival_ms": pa.array([r[1] for r in rows], pa.int64()),
        "offset": pa.array([r[2] for r in rows], pa.int64()),
        "command": [r[3] for r in rows],
        "due_ms": pa.array([r[4] for r in rows], pa.int64()),
        "out_key": pa.array([b"k"] * len(rows), pa.binary()),
        "now_ms": pa.array([now] * len(rows), pa.int64()),
    }
    return pa.table(columns)


def settle(rows, now=10**6, held=False):
    """Runs one task's share."""
    out = [b for b in _settle(iter(share(rows, now).to_batches(max_chunksize=3)), 4, held)]
    return [r for b in out for r in b.to_pylist()]


ROWS = [
    ("a", 1, 0, "update", 2),  # fires before the next command; first of its ID
    ("a", 5, 1, "update", 99),  # closed by the next one
    ("a", 6, 2, "update", 7),  # fires
    ("a", 12, 3, "delete", None),  # last of its ID
    ("b", 3, 4, "update", 50),
]


def test_settle_keeps_the_ends_and_what_fires_inside():
    got = settle(ROWS[::-1])
    assert sorted((r["offset"], r["command"], r["lane"] > 0, r["state_id"]) for r in got) == [
        (0, "closer", False, "a"),
        (0, "fired", True, ""),
        (2, "fired", True, ""),
        (3, "delete", False, "a"),
        (4, "update", False, "b"),
    ]
    closer = next(r for r in got if r["command"] == "closer")
    assert closer["out_key"] is None and closer["fire_ms"] is None


def test_settle_fires_nothing_early_or_while_held():
    assert [r["offset"] for r in settle(ROWS, now=5) if r["command"] == "fired"] == [0]
    assert not [r for r in settle(ROWS, held=True) if r["command"] == "fired"]


def test_settle_goes_by_offset_within_a_partition():
    got = settle([("a", 100, 1, "update", 500), ("a", 50, 2, "delete", None)])
    last = next(r for r in got if r["command"] != "closer")
    assert (last["command"], last["seen_ms"]) == ("delete", 100) and len(got) == 2


def test_settle_sends_at_most_two_rows_of_an_id_to_the_state():
    pick = random.Random(3)
    rows = [("a", pick.randrange(100), i, "update", pick.randrange(200)) for i in range(5_000)]
    got = settle(rows)
    assert sum(r["lane"] == 0 for r in got) == 2
    assert {r["lane"] for r in got if r["lane"]} <= {1, 2, 3, 4}


def test_what_fires_within_a_batch_passes_the_state_packed():
    """The state takes rows one by one and keeps what it gives out for a key: it sees few and small ones."""
    rows = [("a", 2 * i, i, "update", 2 * i + 1) for i in range(60_000)]
    got = _settle_group(GROUPS - 1, share(rows), False, RESOLVED, fired_rows)
    assert got.column_names == KEYED.fieldNames()
    kept = got.to_pylist()
    packs = [r for r in kept if r["packed"] is not None]
    assert sorted(r["offset"] for r in kept if r["lane"] == 0) == [0, 59_999] and len(packs) == len(kept) - 2
    assert 100 < len(packs) < 600 and max(len(r["packed"]) for r in packs) < 40_000
    assert len({r["lane"] for r in packs}) == len(packs) and {r["state_id"] for r in packs} == {""}
    fired = pa.concat_tables(pa.ipc.open_stream(r["packed"]).read_all() for r in packs)
    assert fired.column_names == FIRED.fieldNames() and set(fired.column("fired_ms").to_pylist()) == {10**6}
    assert fired.column("offset").to_pylist() == list(range(59_999))


def test_a_pack_of_long_values_holds_few_rows():
    table = share([("a", 2 * i, i, "update", 2 * i + 1) for i in range(500)])
    table = table.drop("out_value").append_column("out_value", pa.array([bytes(10_000)] * 500, pa.binary()))
    got = _settle_group(0, table.select(share(ROWS).column_names), False, RESOLVED, fired_rows)
    packs = [p for p in got.column("packed").to_pylist() if p is not None]
    assert sum(pa.ipc.open_stream(p).read_all().num_rows for p in packs) == 499 and len(packs) > 150


def test_settle_of_nothing():
    assert settle([]) == [] and list(_settle(iter([]), 4, False)) == []


def sent(spark, folder):
    rows = read_outbox(spark, f"{folder}/outbox").where(F.col("seq") == 0).collect()
    return {r.offset: r for r in rows}


def wait_for(spark, folder, count, seconds=90):
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        try:
            rows = sent(spark, folder)
            if len(rows) >= count:
                return rows
        except Exception:  # the outbox has no file yet
            pass
        time.sleep(0.3)
    raise AssertionError("nothing came out in time")


def now_ms():
    return int(time.time() * 1000)


def test_follow_replace_cancel_restart(spark, tmp_path):
    """Raw JSON files arrive one after the other; the query is stopped and started in between."""
    log, folder = str(tmp_path / "log"), str(tmp_path)
    start = now_ms()

    def append(at, offset, text, schedule_id):
        frame = records(spark, [text]).select(
            F.lit(schedule_id).cast("binary").alias("key"), "value", "topic", "partition",
            F.lit(offset).cast("bigint").alias("offset"),
            F.timestamp_millis(F.lit(at)).alias("timestamp"), "headers",
        )
        frame.write.mode("append").parquet(log)

    def begin():
        stream = metrics.observed(decode_json(logs.follow_table(spark, log)))
        return start_outbox(fire_stream(stream), f"{folder}/outbox", f"{folder}/checkpoint")

    append(start, 0, payload(time=start + 10**10), "far")
    append(start, 1, payload(time=start - 600_000, value=b64("past")), "past")
    append(start, 2, payload(time=start + 10**10), "gone")
    append(start, 3, payload(time=start + 10**10), "changed")
    append(start, 4, payload(time=start + 40_000), "soon")
    query = begin()
    rows = wait_for(spark, folder, 1)
    until, updates = time.monotonic() + 30, 0
    while updates < 5 and time.monotonic() < until:  # progress is told after the rows are out
        counted = [p["observedMetrics"].get("commands") for p in query.recentProgress]
        updates = sum(c["update"] for c in counted if c is not None)
        time.sleep(0.2)
    query.stop()
    assert updates == 5
    assert set(rows) == {1} and bytes(rows[1].value) == b"past"

    append(now_ms(), 5, None, "gone")
    append(now_ms(), 6, payload(time=start, value=b64("new")), "changed")
    append(now_ms(), 7, "foobar", "far")
    query = begin()
    rows = wait_for(spark, folder, 3)
    query.stop()
    assert set(rows) == {1, 4, 6} and bytes(rows[6].value) == b"new"
    assert rows[4].fired_ms >= start + 40_000
    marks = read_outbox(spark, f"{folder}/outbox").where(F.col("seq") == 1)
    assert marks.count() == 3
    assert {bytes(r.key) for r in marks.collect()} == {b"past", b"soon", b"changed"}
    lag = metrics.delivery_lag(
        read_outbox(spark, f"{folder}/outbox").where(F.col("seq") == 0), "fired_ms"
    ).first()
    assert lag.messages == 3 and lag.max_ms >= 0


def file_stream(spark, frame, path):
    slim = frame.drop("error")
    slim.write.parquet(path)
    return spark.readStream.schema(slim.schema).parquet(path)


@pytest.mark.parametrize("gate", [None, 30_000])
def test_hot_id_in_one_batch_equals_the_replay(spark, tmp_path, gate):
    pick = random.Random(11)
    rows, times = [], sorted(pick.randrange(2_000, 60_000) for _ in range(20_000))
    for i, at in enumerate(times):
        if gate is None and pick.random() < 0.1:
            at -= 2_000  # a record time that goes back; a gate would split such a log by offset
        kind = pick.choice(["update"] * 6 + ["delete", "error"])
        rows.append(
            {
                "schedule_id": "hot" if pick.random() < 0.7 else f"u{pick.randrange(200)}",
                "arrival_ms": at,
                "partition": pick.randrange(3),
                "command": kind,
                "is_expired": pick.random() < 0.3,
                "due_ms": at + pick.randrange(-20, 40) if kind == "update" else None,
                "target_topic": "out" if kind == "update" else None,
            }
        )
    frame, _ = commands(spark, rows)
    history = life.lifecycle(frame, gate_ms=gate or 0).where(F.col("outcome") == "fired")
    expected = {r.offset: r.fire_ms for r in history.collect()}

    stream, waiting = file_stream(spark, frame, str(tmp_path / "log")), None
    if gate is not None:
        waiting = state.waiting_at_gate(life.as_of(frame, gate), gate)
        stream = stream.where(F.col("arrival_ms") > gate)
    query = start_outbox(
        fire_stream(stream, waiting), str(tmp_path / "outbox"), str(tmp_path / "checkpoint")
    )
    drain(query)
    got = sent(spark, tmp_path)
    assert {o: r.fire_ms for o, r in got.items()} == expected
    assert all(r.headers == [("h", bytearray(b"x"))] for r in got.values())


def test_restart_goes_on_without_the_initial_load(spark, tmp_path):
    soon = now_ms() + 30_000
    frame, _ = commands(spark, [{"due_ms": soon}, {"arrival_ms": 1, "schedule_id": "b"}])
    waiting = state.waiting_at_gate(frame, 1)
    first, second = str(tmp_path / "log" / "1"), str(tmp_path / "log" / "2")
    later, _ = commands(spark, [{"schedule_id": "z", "offset": 7, "arrival_ms": 9}])
    later.drop("error").write.parquet(first)
    source = lambda: spark.readStream.schema(later.drop("error").schema).parquet(
        str(tmp_path / "log" / "*")
    )
    places = str(tmp_path / "outbox"), str(tmp_path / "checkpoint")
    query = start_outbox(fire_stream(source(), waiting), *places)
    wait_for(spark, tmp_path, 2)
    query.stop()
    later.withColumn("offset", F.lit(8).cast("bigint")).drop("error").write.parquet(second)
    query = start_outbox(fire_stream(source()), *places)
    rows = wait_for(spark, tmp_path, 4)
    query.stop()
    assert set(rows) == {0, 1, 7, 8} and rows[0].fired_ms >= soon


def test_after_a_stop_nothing_fires_before_the_log_is_read(spark, tmp_path):
    """A backlog of two files, read one by one: an update that is past due, and the delete that came."""
    hour = 3_600_000
    start = now_ms()
    base, _ = commands(spark, [{"schedule_id": "x", "arrival_ms": start - 9 * hour, "due_ms": start + 9 * hour}])
    schema = base.drop("error").schema
    log = str(tmp_path / "log")
    places = str(tmp_path / "outbox"), str(tmp_path / "checkpoint")

    def append(name, rows):
        commands(spark, rows)[0].drop("error").coalesce(1).write.parquet(f"{log}/{name}")

    def follow():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{log}/*")

    def begin(fired, until_now=False):
        return start_outbox(fired, *places, until_now=until_now)

    append("1", [{"schedule_id": "x", "arrival_ms": start - 9 * hour, "due_ms": start + 9 * hour}])
    assert not has_run(spark, places[1])
    drain(begin(fire_stream(follow())))
    assert has_run(spark, places[1])
    append("2", [{"schedule_id": "x", "offset": 5, "arrival_ms": start - 2 * hour, "due_ms": start - hour}])
    append("3", [{"schedule_id": "x", "offset": 6, "arrival_ms": start - hour - 1, "command": "delete"}])
    append("4", [{"schedule_id": "y", "offset": 7, "arrival_ms": start - hour, "due_ms": start}])
    query = resume(follow(), begin)
    rows = wait_for(spark, tmp_path, 1)
    drain(query)
    assert set(rows) == set(sent(spark, tmp_path)) == {7}


def test_failed_stream_is_reported(spark, tmp_path):
    frame, _ = commands(spark, [{}])
    stream = file_stream(spark, frame, str(tmp_path / "log")).withColumn(
        "schedule_id", F.raise_error(F.lit("broken source")).cast("string")
    )
    query = start_outbox(fire_stream(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(Exception, match="broken source"):
        drain(query, timeout_s=60)


def test_drain_gives_up(spark, tmp_path):
    frame, _ = commands(spark, [{}])
    stream = file_stream(spark, frame, str(tmp_path / "log"))
    query = start_outbox(fire_stream(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(TimeoutError):
        drain(query, timeout_s=0)
    assert not query.isActive


def test_command_schema_is_what_the_stream_needs():
    missing = {"seen_ms", "fire_ms", "lane", "state_id"}
    assert set(RESOLVED.fieldNames()) - set(COMMANDS.fieldNames()) == missing
