"""Raw log records to command rows. Errors become data; nothing in a payload can fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from delayfold.functions import avro_payload, errors, json_payload, metadata
from delayfold.functions.text import utf8
from delayfold.model import COMMANDS
from delayfold.session import prepare


def envelope(raw: DataFrame) -> DataFrame:
    """A raw log with the columns by which commands are told apart and ordered."""
    prepare(raw.sparkSession)
    return raw.withColumns(
        {
            "schedule_id": utf8(F.col("key")),
            "source_topic": F.col("topic"),
            "arrival_ms": F.unix_millis("timestamp"),
            "_entries": metadata.header_entries(F.col("headers")),
        }
    )


def is_report() -> Column:
    """Of a raw log: the deletes that only report a fired schedule. No payload is read for it."""
    entries = metadata.from_entries(metadata.header_entries(F.col("headers")))
    return F.col("value").isNull() & metadata.is_expired(entries)


def _commands(
    decoded: DataFrame, is_update: Column, error: Column, fields: dict, keep: tuple[str, ...]
) -> DataFrame:
    """Classifies (null payload: delete, good payload: update, else error) and shapes the row.

    A record without a key has no ID to act on: it is an error, and takes part in no fold.
    """
    no_key = F.col("schedule_id").isNull()
    is_delete = F.col("value").isNull() & ~no_key
    is_update = is_update & ~no_key
    error = F.when(
        no_key, errors.undecodable(F.lit(""), F.lit("no-key"), F.lit("the record has no key"))
    ).otherwise(error)
    marked = decoded.withColumn("metadata", metadata.from_entries(F.col("_entries"))).withColumns(
        {
            "command": F.when(is_delete, "delete").when(is_update, "update").otherwise("error"),
            "is_expired": metadata.is_expired(F.col("metadata")),
            "error": F.when(~is_delete & ~is_update, error).otherwise(errors.none()),
            **{
                name: F.when(~is_delete & is_update, column) for name, column in fields.items()
            },
        }
    )
    return marked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMANDS], *keep)


def decode_json(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Commands of a raw log with JSON payloads; columns in `keep` go along."""
    parsed = json_payload.check(json_payload.parse(envelope(raw)))
    cause = F.when(F.col("_read.json"), "invalid-json").otherwise("not-json")
    cause_message = F.when(
        F.col("_read.json"),
        F.concat(F.lit("JSON '"), F.col("_text"), F.lit("' did not conform to Schema")),
    ).otherwise(F.concat(F.lit("'"), F.col("_text"), F.lit("' was not valid JSON")))
    return _commands(
        parsed,
        F.col("_read.good"),
        F.when(
            F.col("_read.shape"),
            errors.untransformable(F.col("schedule_id"), F.col("_read.paths")),
        ).otherwise(errors.undecodable(F.col("schedule_id"), cause, cause_message)),
        {
            "due_ms": F.col("_read.time"),
            "target_topic": F.col("_read.topic"),
            "out_key": F.col("_read.key"),
            "out_value": F.col("_read.value"),
            "out_headers": F.col("_read.headers"),
        },
        keep,
    )


def decode_avro(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Commands of a raw log with Avro payloads: current layout first, then the one without headers."""
    parsed = envelope(raw).withColumn("_avro", avro_payload.read(F.col("value")))
    headers = F.transform(
        "_avro.headers",
        lambda h: F.struct(utf8(h["key"]).alias("key"), h["value"].alias("value")),
    )
    return _commands(
        parsed,
        F.coalesce(F.col("_avro.ok"), F.lit(False)),
        errors.undecodable(
            F.col("schedule_id"),
            F.lit("invalid-avro"),
            F.lit(f"Avro message did not conform to Schema: {avro_payload.NAME}: {avro_payload.SCHEMA}"),
        ),
        {
            "due_ms": F.col("_avro.time"),
            "target_topic": utf8(F.col("_avro.topic")),
            "out_key": F.col("_avro.key"),
            "out_value": F.col("_avro.value"),
            "out_headers": F.map_from_entries(headers),
        },
        keep,
    )


def effective(commands: DataFrame) -> DataFrame:
    """Drops deletes that only report a fired schedule; they cancel nothing."""
    return commands.where(~((F.col("command") == "delete") & F.col("is_expired")))


def errors_only(commands: DataFrame) -> DataFrame:
    """Side output: what could not be read, and why."""
    return commands.where(F.col("command") == "error").select(
        "schedule_id", "source_topic", "partition", "offset", "arrival_ms", "error.*"
    )


def map_payload(commands: DataFrame, change) -> DataFrame:
    """Applies `change` (payload columns to payload columns) to updates; the envelope stays."""
    payload = {n: F.col(n) for n in ("due_ms", "target_topic", "out_key", "out_value", "out_headers")}
    is_update = F.col("command") == "update"
    return commands.withColumns(
        {
            name: F.when(is_update, column).otherwise(F.col(name))
            for name, column in change(payload).items()
        }
    )
