"""Registered queries: every operator over the command log of a scale factor's `events` table.

Binary and map columns are shown as hex text and counts, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from delayfold.functions import clock, metadata
from delayfold.functions.text import base64_bytes, base64_problem
from delayfold.model import HEADERS
from delayfold.operators import decode, encode, lifecycle as life, metrics, publish, state
from delayfold.operators.ordered import Slicing
from delayfold.plans.fixtures import (
    AS_OF_MS,
    FAR_MS,
    GATE_MS,
    avro_log,
    command_log,
    events,
    json_log,
    late_timestamps,
    waiting_log,
)
from delayfold.session import remove, work_dir
from delayfold.sources import logs
from delayfold.streaming import audit, inspect
from delayfold.streaming.run import drain, read_outbox, start_outbox, state_partitions
from delayfold.streaming.timers import fire_stream

Query = Callable[[SparkSession, str], DataFrame]

# Cuts IDs of more than about 200 commands, to take the path of hot IDs on a small log.
FINE = Slicing(least=200, samples=20)


def _hex(name: str) -> Column:
    return F.hex(name).alias(name)


def _headers_text(name: str = "out_headers") -> Column:
    """Map of bytes as sorted `name=hex` text."""
    pairs = F.transform(
        F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), F.hex(e["value"]))
    )
    return F.array_join(F.array_sort(pairs), ",").alias(name)


_ENVELOPE = ["schedule_id", "source_topic", "partition", "offset", "arrival_ms"]
_HISTORY = [*_ENVELOPE, "due_ms", "fire_ms", "next_ms", "outcome", "closed_ms"]


def _schedule() -> list[Column]:
    return [
        F.col("due_ms"),
        F.col("target_topic"),
        _hex("out_key"),
        _hex("out_value"),
        _headers_text(),
    ]


def _decoded() -> list[Column]:
    return [
        *[F.col(name) for name in (*_ENVELOPE, "command", "is_expired")],
        *_schedule(),
        F.col("error.class").alias("error_class"),
        F.col("error.cause_class").alias("error_cause"),
        F.col("error.message").alias("error_message"),
        F.col("error.cause_message").alias("error_cause_message"),
        F.array_join("error.paths.path", ",").alias("error_paths"),
    ]


def classify_commands(spark, sf_dir):
    log = command_log(spark, sf_dir)
    takes_effect = ~((F.col("command") == "delete") & F.col("is_expired"))
    return log.select(*_ENVELOPE, "command", "is_expired", takes_effect.alias("takes_effect"))


def effective_commands(spark, sf_dir):
    return decode.effective(command_log(spark, sf_dir)).select(*_ENVELOPE, "command")


def decode_json_commands(spark, sf_dir):
    return decode.decode_json(json_log(spark, sf_dir)).select(*_decoded())


def avro_decode_fallback(spark, sf_dir):
    return decode.decode_avro(avro_log(spark, sf_dir)).select(*_decoded())


def merge_sources(spark, sf_dir):
    """Topic a holds Avro payloads, topic b JSON payloads."""
    merged = logs.merge(
        avro=avro_log(spark, sf_dir).where(F.col("topic") == "schedules-a"),
        json=json_log(spark, sf_dir).where(F.col("topic") == "schedules-b"),
    )
    return merged.select(*_ENVELOPE, "command", "due_ms", "target_topic", _hex("out_key"))


def merge_one_group(spark, sf_dir):
    """A service with JSON topics only; the other group is left out."""
    merged = logs.merge(json=json_log(spark, sf_dir))
    return merged.select(*_ENVELOPE, "command", "due_ms", "target_topic", _hex("out_key"))


def map_payload_kept(spark, sf_dir):
    """Due a minute later, on another topic; the envelope and other commands stay as they are."""

    def change(payload):
        return {
            "due_ms": payload["due_ms"] + 60_000,
            "target_topic": F.concat(payload["target_topic"], F.lit("-retry")),
        }

    changed = decode.map_payload(command_log(spark, sf_dir), change)
    return changed.select(*_ENVELOPE, "command", "is_expired", *_schedule())


def metadata_transformed(spark, sf_dir):
    """A function over all of a command's metadata, then names as plain text."""
    log = command_log(spark, sf_dir)
    tagged = metadata.combine(F.col("metadata"), F.create_map(F.lit("Source"), F.col("source_topic")))
    changed = metadata.transform(tagged, lambda m: F.transform_values(m, lambda _, v: F.upper(v)))
    return log.select("offset", F.explode(metadata.to_map(changed)).alias("name", "value"))


def clock_shift(spark, sf_dir):
    """How far a clock that is set ahead by the event's class, in seconds, is from the plain one."""
    shifted = clock.shifted_now_ms(F.col("class"))
    return events(spark, sf_dir).select("offset", (shifted - clock.now_ms()).alias("shift_ms"))


def base64_decode_fields(spark, sf_dir):
    table = events(spark, sf_dir)
    fields = F.explode(
        F.array(
            F.struct(
                F.lit("key").alias("path"),
                F.when(F.col("class") == 18, "invalid-base64")
                .when(F.col("class") == 17, F.concat(F.base64("out_key"), F.lit("\n")))
                .when(F.col("class") == 16, F.rtrim(F.base64("out_key"), F.lit("=")))
                .otherwise(F.base64("out_key"))
                .alias("text"),
            ),
            F.struct(F.lit("value").alias("path"), F.base64("out_value").alias("text")),
        )
    )
    field = table.select("offset", fields.alias("f")).select("offset", "f.*")
    return field.select(
        "offset",
        "path",
        F.hex(base64_bytes(F.col("text"))).alias("bytes"),
        base64_problem(F.col("text")).alias("problem"),
    )


def headers_to_metadata(spark, sf_dir):
    """Headers with a null value, and two names that differ only in case; then marked as expired."""

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    headers = F.array(
        header("K", F.col("schedule_id")),
        header("Note", F.lit(None)),
        header("Etype", F.col("event_type")),
        header("k", F.col("target_topic")),
    ).cast(HEADERS)
    table = events(spark, sf_dir).withColumn("_entries", metadata.header_entries(headers))
    own = metadata.from_entries(F.col("_entries"))
    extra = F.create_map(F.lit("etype"), F.lit("merged"), F.lit("source"), F.col("source_topic"))
    merged = table.withColumn("_own", own).withColumn(
        "_all", metadata.expire(metadata.combine(F.col("_own"), extra))
    )
    return merged.select("offset", F.explode("_all").alias("name", "value"))


def _updates(spark, sf_dir):
    return command_log(spark, sf_dir).where(F.col("command") == "update")


def encode_json_records(spark, sf_dir):
    return encode.to_json_records(_updates(spark, sf_dir), keep=("offset",)).select(
        "offset", "topic", F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("payload"),
    )


def _as_raw(records: DataFrame) -> DataFrame:
    return records.withColumn("timestamp", F.timestamp_millis("arrival_ms"))


def encode_json_roundtrip(spark, sf_dir):
    keep = ("partition", "offset", "arrival_ms")
    records = encode.to_json_records(_updates(spark, sf_dir), keep=keep)
    return decode.decode_json(_as_raw(records)).select(*_ENVELOPE, "command", *_schedule())


def encode_avro_roundtrip(spark, sf_dir):
    keep = ("partition", "offset", "arrival_ms")
    records = encode.to_avro_records(_updates(spark, sf_dir), keep=keep)
    return decode.decode_avro(_as_raw(records)).select(*_ENVELOPE, "command", *_schedule())


def delay_clamped(spark, sf_dir):
    """Due times of two classes are put at the ends of the BIGINT range."""
    due = (
        F.when(F.col("class") == 0, F.lit(9223372036854775807))
        .when(F.col("class") == 1, F.expr("-9223372036854775808"))
        .otherwise(F.col("due_ms"))
    )
    now = F.lit(AS_OF_MS).cast("bigint")
    return events(spark, sf_dir).select(
        "offset", clock.delay_ms(due.cast("bigint"), now).alias("delay_ms")
    )


def schedule_lifecycle(spark, sf_dir):
    return life.lifecycle(command_log(spark, sf_dir), AS_OF_MS).select(*_HISTORY)


def lifecycle_gated(spark, sf_dir):
    return life.lifecycle(command_log(spark, sf_dir), AS_OF_MS, GATE_MS).select(*_HISTORY)


def lifecycle_expired_complete(spark, sf_dir):
    history = life.lifecycle(command_log(spark, sf_dir), AS_OF_MS, GATE_MS, life.COMPLETE)
    return history.select(*_HISTORY)


def lifecycle_hot_id(spark, sf_dir):
    """A third of the commands share one ID, which is cut into slices."""
    log = command_log(spark, sf_dir).withColumn(
        "schedule_id", F.when(F.col("offset") % 3 == 0, "hot").otherwise(F.col("schedule_id"))
    )
    history = life.lifecycle(log, AS_OF_MS, GATE_MS, life.COMPLETE, slicing=FINE)
    return history.select(*_HISTORY)


def _late_log(spark, sf_dir):
    return late_timestamps(command_log(spark, sf_dir))


def lifecycle_late_timestamps(spark, sf_dir):
    """Record times go back within a partition; the offset decides there."""
    history = life.lifecycle(_late_log(spark, sf_dir), AS_OF_MS, GATE_MS, life.COMPLETE)
    return history.select(*_HISTORY, "seen_ms")


def lifecycle_late_hot_id(spark, sf_dir):
    """The same with a third of the commands under one ID, which is cut into slices."""
    log = _late_log(spark, sf_dir).withColumn(
        "schedule_id", F.when(F.col("offset") % 3 == 0, "hot").otherwise(F.col("schedule_id"))
    )
    history = life.lifecycle(log, AS_OF_MS, GATE_MS, life.COMPLETE, slicing=FINE)
    return history.select(*_HISTORY, "seen_ms")


def pending_late_timestamps(spark, sf_dir):
    pending = state.pending_at(_late_log(spark, sf_dir), AS_OF_MS)
    return pending.select(*_ENVELOPE, *_schedule(), "seen_ms", "fire_ms")


def pending_in_json_log(spark, sf_dir):
    """From raw JSON records, of which only the last of each ID is decoded."""
    pending = state.pending_in_log(json_log(spark, sf_dir), AS_OF_MS)
    return pending.select(*_ENVELOPE, *_schedule(), "seen_ms", "fire_ms")


def pending_state(spark, sf_dir):
    pending = state.pending_at(command_log(spark, sf_dir), AS_OF_MS)
    return pending.select(*_ENVELOPE, *_schedule(), "fire_ms")


def state_lookup(spark, sf_dir):
    """Every customer number is asked for as an ID; most have no schedule."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("schedule_id")
    )
    log = command_log(spark, sf_dir).join(ids, "schedule_id", "left_semi")
    pending = state.pending_at(log, AS_OF_MS)
    found = state.lookup(pending.select("schedule_id", "due_ms", "target_topic", "out_key"), ids)
    return found.select("schedule_id", "found", "due_ms", "target_topic", _hex("out_key"))


def _record_columns(headers: str = "headers") -> list[Column]:
    pairs = F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), F.hex(h["value"])))
    return [F.col("topic"), _hex("key"), _hex("value"), F.array_join(pairs, ",").alias("headers")]


def due_publish_rows(spark, sf_dir):
    history = life.lifecycle(command_log(spark, sf_dir), AS_OF_MS)
    return publish.publish_rows(life.fired(history)).select(*_record_columns())


def due_in_last_day(spark, sf_dir):
    history = life.lifecycle(command_log(spark, sf_dir), AS_OF_MS)
    due = life.fired(history, after_ms=AS_OF_MS - 86_400_000, until_ms=AS_OF_MS)
    return due.select(*_ENVELOPE, "due_ms", "fire_ms", _hex("out_key"))


def replay_json_log(spark, sf_dir):
    """From raw JSON records to the messages that are due: decode, fold, publish."""
    raw = json_log(spark, sf_dir)
    history = life.lifecycle(decode.decode_json(raw), AS_OF_MS, rows=raw.count())
    return publish.publish_rows(life.fired(history)).select(*_record_columns())


def fire_rows_paired(spark, sf_dir):
    fired = life.fired(life.lifecycle(command_log(spark, sf_dir), AS_OF_MS, GATE_MS))
    rows = publish.fire_rows(fired, keep=("offset", "fire_ms"))
    return rows.select("offset", "fire_ms", F.col("seq").cast("bigint"), *_record_columns())


def compact_log(spark, sf_dir):
    kept = state.compact_per_topic(command_log(spark, sf_dir), AS_OF_MS)
    return kept.select(*_ENVELOPE, "command", "due_ms", _hex("out_key"))


def compact_log_by_offset(spark, sf_dir):
    kept = state.compact_per_topic(_late_log(spark, sf_dir), AS_OF_MS)
    return kept.select(*_ENVELOPE, "command", "due_ms", _hex("out_key"))


def compact_log_safe(spark, sf_dir):
    kept = state.compact_safe(command_log(spark, sf_dir), AS_OF_MS)
    return kept.select(*_ENVELOPE, "command", *_schedule())


def _raw_columns() -> list[Column]:
    return [
        F.col("topic"),
        F.col("partition"),
        F.col("offset"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("key").cast("string").alias("key"),
    ]


def take_first_n(spark, sf_dir):
    return logs.first_of_topic(json_log(spark, sf_dir), 25).select(*_raw_columns())


def tail_per_partition(spark, sf_dir):
    return logs.last_of_partition(json_log(spark, sf_dir), 10).select(*_raw_columns())


def event_counts(spark, sf_dir):
    return metrics.event_counts(command_log(spark, sf_dir))


def state_size_metrics(spark, sf_dir):
    return metrics.state_size(command_log(spark, sf_dir), AS_OF_MS)


def state_size_complete(spark, sf_dir):
    return metrics.state_size(
        command_log(spark, sf_dir), AS_OF_MS, GATE_MS, expired_policy=life.COMPLETE
    )


def active_over_time(spark, sf_dir):
    """The number of waiting schedules after each change of it, over all of the log's time."""
    history = life.lifecycle(command_log(spark, sf_dir), AS_OF_MS)
    return metrics.active_over_time(history, per_range=1_000)


def _points(spark, sf_dir) -> DataFrame:
    """An ID and a time for each line item, spread over the users and the time of the log."""
    spread = (F.col("l_orderkey") * 1_000_003 + F.col("l_linenumber") * 7_919) % 2_678_400_000
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("u"), F.col("l_suppkey")).alias("schedule_id"),
        (spread + 1_704_067_200_000).alias("at_ms"),
    )


def pending_at_points(spark, sf_dir):
    """What waited under an ID at a time, asked once for each line item."""
    found = state.pending_at_points(command_log(spark, sf_dir), _points(spark, sf_dir))
    return found.select("schedule_id", "at_ms", "found", "offset", "due_ms", "fire_ms", _hex("out_key"))


def pending_at_points_hot(spark, sf_dir):
    """The same with a third of the commands and of the points under one ID, which is cut into slices."""
    log = command_log(spark, sf_dir).withColumn(
        "schedule_id", F.when(F.col("offset") % 3 == 0, "hot").otherwise(F.col("schedule_id"))
    )
    points = _points(spark, sf_dir).withColumn(
        "schedule_id", F.when(F.col("at_ms") % 3 == 0, "hot").otherwise(F.col("schedule_id"))
    )
    found = state.pending_at_points(log, points, slicing=FINE)
    return found.select("schedule_id", "at_ms", "found", "offset", "due_ms", "fire_ms", _hex("out_key"))


def lookup_hits(spark, sf_dir):
    return metrics.lookup_hits(command_log(spark, sf_dir), AS_OF_MS)


def command_audit(spark, sf_dir):
    return metrics.command_audit(command_log(spark, sf_dir))


def error_rows(spark, sf_dir):
    rows = decode.errors_only(decode.decode_json(json_log(spark, sf_dir)))
    return rows.select(
        *_ENVELOPE,
        F.col("class").alias("error_class"),
        F.col("cause_class").alias("error_cause"),
        F.col("message").alias("error_message"),
        F.col("cause_message").alias("error_cause_message"),
        F.array_join("paths.path", ",").alias("error_paths"),
    )


def transition_audit(spark, sf_dir):
    log = life.as_of(command_log(spark, sf_dir), AS_OF_MS)
    return life.transitions(log, life.lifecycle(log, AS_OF_MS))


def delivery_lag(spark, sf_dir):
    fired = life.fired(life.lifecycle(command_log(spark, sf_dir), AS_OF_MS, GATE_MS))
    return metrics.delivery_lag(fired)


def _fired_by_stream(spark, sf_dir, gate_ms: int | None) -> DataFrame:
    """Runs the firing query over all of the log and reads back its outbox: messages and tombstones."""
    folder = work_dir(spark, "fire")
    log, commands = command_log(spark, sf_dir), command_log(spark, sf_dir, stream=True)
    waiting = None
    if gate_ms is not None:
        waiting = state.waiting_at_gate(life.as_of(log, gate_ms), gate_ms)
        commands = commands.where(F.col("arrival_ms") > gate_ms)
    with state_partitions(spark, 8):
        fired = fire_stream(commands, waiting)
        drain(start_outbox(fired, f"{folder}/outbox", f"{folder}/checkpoint"))
    remove(spark, f"{folder}/checkpoint")
    sent = read_outbox(spark, f"{folder}/outbox")
    seq = F.col("seq").cast("bigint").alias("seq")
    return sent.select(*_ENVELOPE, "due_ms", "fire_ms", seq, *_record_columns())


def stream_fire_equals_batch(spark, sf_dir):
    """The whole log through the stream; every due time is long past, so all that can fire does."""
    return _fired_by_stream(spark, sf_dir, None)


def stream_fire_gated(spark, sf_dir):
    """The log up to the gate is folded in batch and handed over; the stream takes the rest."""
    return _fired_by_stream(spark, sf_dir, GATE_MS)


def _checkpoint(spark, sf_dir) -> str:
    """Runs the firing query over the log up to a time and returns its checkpoint. What was not due then is
    put far off, so that it still waits; the rest has fired."""
    folder = work_dir(spark, "state")
    commands = life.as_of(waiting_log(spark, sf_dir), AS_OF_MS)
    with state_partitions(spark, 8):
        drain(start_outbox(fire_stream(commands), f"{folder}/outbox", f"{folder}/checkpoint"))
    return f"{folder}/checkpoint"


def stream_state_pending(spark, sf_dir):
    """Pending schedules and their timers as the stream's own state holds them."""
    kept = inspect.pending_in_stream(spark, _checkpoint(spark, sf_dir))
    shifted = kept.withColumns({n: F.col(n) - FAR_MS for n in ("due_ms", "fire_ms", "timer_ms")})
    return shifted.select(*_ENVELOPE, *_schedule(), "fire_ms", "timer_ms")


def stream_state_lookup(spark, sf_dir):
    """Every customer number is looked up in the stream's state."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("schedule_id")
    )
    found = inspect.lookup_in_stream(spark, _checkpoint(spark, sf_dir), ids)
    due = (F.col("due_ms") - FAR_MS).alias("due_ms")
    return found.select("schedule_id", "found", due, "target_topic", _hex("out_key"))


def _told(spark, sf_dir) -> str:
    """Runs the telling query over all of the log; the folder of its tables."""
    folder = work_dir(spark, "told")
    with state_partitions(spark, 8):
        told = audit.told_stream(command_log(spark, sf_dir, stream=True))
        drain(audit.start_tables(told, f"{folder}/tables", f"{folder}/checkpoint"))
    remove(spark, f"{folder}/checkpoint")
    return f"{folder}/tables"


def stream_tables(spark, sf_dir):
    """Outgoing records, errors, command lines and steps of schedules, all from one run of the stream."""
    place = ("schedule_id", "source_topic", "partition", "offset")
    folder = _told(spark, sf_dir)

    def rows(name: str, at: str, what: str, line: Column) -> DataFrame:
        table = audit.read_told(spark, folder, name)
        told = (F.col(at).alias("at_ms"), F.col(what).alias("what"), line.alias("line"))
        return table.select(F.lit(name).alias("name"), *place, *told)

    parts = [
        rows("outbox", "fire_ms", "topic", F.hex("key")),
        rows("errors", "arrival_ms", "class", F.col("message")),
        rows("commands", "arrival_ms", "level", F.col("line")),
        rows("steps", "at_ms", "step", F.col("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def stream_event_counts(spark, sf_dir):
    """Counts of the commands by type, source and kind, kept batch by batch."""
    return audit.read_told(spark, _told(spark, sf_dir), "counts")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        classify_commands,
        effective_commands,
        decode_json_commands,
        base64_decode_fields,
        headers_to_metadata,
        encode_json_records,
        encode_json_roundtrip,
        encode_avro_roundtrip,
        avro_decode_fallback,
        merge_sources,
        merge_one_group,
        map_payload_kept,
        metadata_transformed,
        clock_shift,
        delay_clamped,
        schedule_lifecycle,
        lifecycle_gated,
        lifecycle_expired_complete,
        lifecycle_hot_id,
        lifecycle_late_timestamps,
        lifecycle_late_hot_id,
        pending_state,
        pending_late_timestamps,
        pending_in_json_log,
        state_lookup,
        due_publish_rows,
        due_in_last_day,
        replay_json_log,
        fire_rows_paired,
        compact_log,
        compact_log_by_offset,
        compact_log_safe,
        take_first_n,
        tail_per_partition,
        event_counts,
        state_size_metrics,
        state_size_complete,
        active_over_time,
        pending_at_points,
        pending_at_points_hot,
        lookup_hits,
        command_audit,
        error_rows,
        transition_audit,
        delivery_lag,
        stream_fire_equals_batch,
        stream_fire_gated,
        stream_state_pending,
        stream_state_lookup,
        stream_tables,
        stream_event_counts,
    )
}
