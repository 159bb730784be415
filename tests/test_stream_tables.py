import random

import pytest
from pyspark.sql import functions as F

from delayfold.operators import decode, lifecycle as life, metrics, state
from delayfold.operators.publish import fire_rows
from delayfold.streaming import audit
from delayfold.streaming.run import drain
from frames import commands

KEYS = ("schedule_id", "source_topic", "partition", "offset")


def random_log(spark):
    pick, rows = random.Random(4), []
    for i in range(3_000):
        kind = pick.choice(["update"] * 5 + ["delete", "error"])
        at = 2_000 + i * 3 + pick.randrange(-9, 9)
        name = "hot" if pick.random() < 0.5 else f"u{pick.randrange(40)}"
        if kind == "error" and pick.random() < 0.3:
            name = None  # no ID: told, but part of nothing
        rows.append(
            {
                "schedule_id": name,
                "arrival_ms": at,
                "partition": pick.randrange(3),
                "command": kind,
                "is_expired": kind == "delete" and pick.random() < 0.4,
                "due_ms": at + pick.randrange(-20, 60) if kind == "update" else None,
                "error": ("decode", "not-json", f"bad {i}", None, []) if kind == "error" else None,
            }
        )
    return commands(spark, rows)[0]


def expected(log, gate):
    history = life.lifecycle(log, gate_ms=gate)
    return {
        "outbox": fire_rows(life.fired(history), keep=(*KEYS, "due_ms", "fire_ms")),
        "errors": decode.errors_only(log),
        "commands": metrics.command_audit(log),
        "steps": life.transitions(log, history),
        "counts": metrics.event_counts(log),
    }


def rows_of(frame, columns):
    return sorted((str(tuple(r)) for r in frame.select(*columns).collect()))


def same_tables(spark, path, tables):
    for name in audit.TABLES:
        columns = [c for c in tables[name].columns if c != "fired_ms"]
        told = audit.read_told(spark, path, name)
        assert rows_of(told, columns) == rows_of(tables[name], columns), name


def follow(spark, frame, path, files=1):
    frame.repartition(files, "schedule_id").write.parquet(path)
    reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def test_tables_equal_the_batch_ones_also_after_a_batch_ran_twice(spark, tmp_path, monkeypatch):
    log = random_log(spark)
    stream = audit.told_stream(follow(spark, log, str(tmp_path / "log"), files=3))
    path, checkpoint = str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    whole, ran = audit.write_tables, []

    def stops_before_its_commit(folder):
        write = whole(folder)

        def run(tagged, batch_id):
            write(tagged, batch_id)
            ran.append(batch_id)
            if batch_id == 1 and ran.count(1) == 1:
                raise RuntimeError("stopped after its tables were written")

        return run

    monkeypatch.setattr(audit, "write_tables", stops_before_its_commit)
    with pytest.raises(Exception, match="stopped after"):
        drain(audit.start_tables(stream, path, checkpoint))
    drain(audit.start_tables(stream, path, checkpoint))
    assert ran.count(1) == 2 and ran.count(0) == 1
    same_tables(spark, path, expected(log, 0))


def test_from_schedules_that_wait_at_the_start(spark, tmp_path):
    gate, log = 6_000, random_log(spark)
    before, after = life.as_of(log, gate), log.where(F.col("arrival_ms") > gate)
    stream = audit.told_stream(
        follow(spark, after, str(tmp_path / "log")), state.waiting_at_gate(before, gate)
    )
    path = str(tmp_path / "tables")
    drain(audit.start_tables(stream, path, str(tmp_path / "checkpoint")))
    tables = expected(log, gate)
    sent = rows_of(audit.read_told(spark, path, "outbox"), (*KEYS, "seq"))
    # Schedules of record times that go back over the gate are left out of the comparison.
    assert set(rows_of(tables["outbox"], (*KEYS, "seq"))) >= set(sent) and len(sent) == len(set(sent)) > 500
    told = audit.read_told(spark, path, "commands")
    assert rows_of(told, KEYS) == rows_of(after, KEYS)


def test_nothing_fires_while_held_but_all_is_told(spark, tmp_path):
    log = random_log(spark).where(F.col("offset") < 300)
    stream = audit.told_stream(follow(spark, log, str(tmp_path / "log")), held=True)
    path = str(tmp_path / "tables")
    query = audit.start_tables(stream, path, str(tmp_path / "checkpoint"), until_now=True)
    from delayfold.streaming.run import _stop_after

    _stop_after(query, lambda progress: progress["numInputRows"] == 0, 1, 120)
    assert audit.read_told(spark, path, "commands").count() == 300
    assert audit.read_told(spark, path, "outbox").count() == 0
    steps = {r.step for r in audit.read_told(spark, path, "steps").select("step").distinct().collect()}
    assert steps == {"scheduled", "cancel", "superseded", "canceled", "canceled_by_error"}


def test_only_reports_and_nameless_errors(spark, tmp_path):
    rows = [{"command": "delete", "is_expired": True}, {"command": "error", "schedule_id": None}]
    log = commands(spark, rows)[0]
    stream = audit.told_stream(follow(spark, log, str(tmp_path / "log")))
    path = str(tmp_path / "tables")
    drain(audit.start_tables(stream, path, str(tmp_path / "checkpoint")))
    same_tables(spark, path, expected(log, 0))
