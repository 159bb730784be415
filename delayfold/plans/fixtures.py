"""The command log that the registered queries read, derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from delayfold.functions import avro_payload, errors, metadata
from delayfold.functions.text import to_utf8
from delayfold.model import COMMANDS, HEADERS, RAW_LOG
from delayfold.session import prepare

AS_OF_MS = 1_706_000_000_000
LATE_MS = 7_200_000
GATE_MS = 1_704_672_000_000
FAR_MS = 100 * 365 * 86_400_000
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Base columns of every record: identity, position, due time and command class."""
    prepare(spark)
    if stream:  # a file stream reads a folder or a pattern, not the path of one file
        reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100)
        source = reader.parquet(f"{sf_dir}/events*.parquet")
    else:
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrival = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        source.withColumns({"arrival_ms": arrival, "class": F.col("event_id") % 20})
        .select(
            F.concat(F.lit("u"), F.col("user_id")).alias("schedule_id"),
            F.when(F.col("event_id") % 3 == 0, "schedules-b")
            .otherwise("schedules-a")
            .alias("source_topic"),
            (F.col("user_id") % 4).cast("int").alias("partition"),
            F.col("event_id").alias("offset"),
            "arrival_ms",
            (F.col("arrival_ms") + (k - 10) * 3_600_000).alias("due_ms"),
            F.concat(F.lit("out-"), F.col("event_type")).alias("target_topic"),
            to_utf8(F.concat(F.lit("k"), F.col("event_id"))).alias("out_key"),
            F.when(F.col("class") != 13, to_utf8(F.col("props"))).alias("out_value"),
            F.when(
                F.col("class") != 12, F.create_map(F.lit("etype"), to_utf8(F.col("event_type")))
            )
            .otherwise(F.expr("cast(map() as map<string, binary>)"))
            .alias("out_headers"),
            "class",
            "user_id",
            "event_type",
        )
    )


def _record_headers() -> Column:
    expired = F.array(
        F.struct(F.lit("Schedule:Expired").alias("key"), F.lit(b"TRUE").alias("value")),
        F.struct(F.lit("note").alias("key"), F.lit(None).cast("binary").alias("value")),
    ).cast(HEADERS)
    return F.when(F.col("class") == 15, expired).otherwise(F.array().cast(HEADERS))


def _as_log(table: DataFrame, payload: Column) -> DataFrame:
    return table.select(
        to_utf8(F.col("schedule_id")).alias("key"),
        payload.cast("binary").alias("value"),
        F.col("source_topic").alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("arrival_ms").alias("timestamp"),
        _record_headers().alias("headers"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in RAW_LOG])


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with JSON payloads, good and bad ones by class."""
    table = events(spark, sf_dir)
    quoted = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    no_headers = F.when(F.col("user_id") % 2 == 0, "").otherwise(',"headers":null')
    schedule = F.concat(
        F.lit('{"time":'),
        F.col("due_ms"),
        F.lit(',"topic":'),
        quoted(F.col("target_topic")),
        F.lit(',"key":'),
        quoted(F.when(F.col("class") == 18, "invalid-base64").otherwise(F.base64("out_key"))),
        F.lit(',"value":'),
        F.coalesce(quoted(F.base64("out_value")), F.lit("null")),
        F.when(F.col("class") == 12, no_headers).otherwise(
            F.concat(
                F.lit(',"headers":{"etype":'),
                quoted(F.base64(to_utf8(F.col("event_type")))),
                F.lit("}"),
            )
        ),
        F.lit("}"),
    )
    payload = (
        F.when(F.col("class").isin(14, 15), F.lit(None).cast("string"))
        .when(F.col("class") == 16, "foobar")
        .when(F.col("class") == 17, '{"foo":"bar"}')
        .otherwise(schedule)
    )
    return _as_log(table, to_utf8(payload))


def avro_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with Avro payloads: the older layout for odd events, bad bytes for 16 to 18."""
    table = events(spark, sf_dir)
    fields = [F.col(c) for c in ("due_ms", "target_topic", "out_key", "out_value")]
    payload = (
        F.when(F.col("class").isin(14, 15), F.lit(None).cast("binary"))
        .when(F.col("class").isin(16, 17, 18), F.lit(b"foobar"))
        .when(F.col("offset") % 2 == 1, avro_payload.write(*fields, None))
        .otherwise(avro_payload.write(*fields, F.col("out_headers")))
    )
    return _as_log(table, payload)


def late_timestamps(table: DataFrame) -> DataFrame:
    """Record times that go back within a partition: two hours for each seventh record."""
    late = F.when(F.col("offset") % 7 == 0, LATE_MS).otherwise(0)
    return table.withColumn("arrival_ms", F.col("arrival_ms") - late)


def command_log(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The decoded commands, built from the base columns without going through a payload."""
    table = events(spark, sf_dir, stream)
    kind = F.col("class")
    is_update = ~kind.isin(14, 15, 16, 17, 18)
    expired = kind == 15
    undecodable = errors.undecodable(
        F.col("schedule_id"),
        F.when(kind == 16, "not-json").otherwise("invalid-json"),
        F.when(kind == 16, "'foobar' was not valid JSON").otherwise(
            "JSON '{\"foo\":\"bar\"}' did not conform to Schema"
        ),
    )
    bad_key = F.array(
        F.struct(
            F.lit("key").alias("path"), F.lit("Illegal base64 character 2d").alias("message")
        )
    )
    table = table.withColumns(
        {
            "command": F.when(kind.isin(14, 15), "delete")
            .when(is_update, "update")
            .otherwise("error"),
            "is_expired": expired,
            "metadata": F.when(
                expired, F.create_map(F.lit("schedule:expired"), F.lit("TRUE"))
            ).otherwise(metadata.empty()),
            "error": F.when(kind.isin(16, 17), undecodable).when(
                kind == 18, errors.untransformable(F.col("schedule_id"), bad_key)
            ),
            **{
                name: F.when(is_update, F.col(name))
                for name in ("due_ms", "target_topic", "out_key", "out_value", "out_headers")
            },
        }
    )
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMANDS])


def waiting_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log as a stream; due times after AS_OF_MS are a hundred years later."""
    far = F.when(F.col("due_ms") > AS_OF_MS, FAR_MS).otherwise(0)
    return command_log(spark, sf_dir, stream=True).withColumn("due_ms", F.col("due_ms") + far)
