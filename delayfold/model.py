"""Row shapes, fixed values and configuration shared by every job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the message contract.
EXPIRED_KEY = "schedule:expired"
EXPIRED_VALUE = "true"

# Longest delay in ms: 2**63 - 1 nanoseconds, about 292 years.
MAX_DELAY_MS = 9_223_372_036_854

# Where offsets count.
LANE = ("source_topic", "partition")

# Total order of the commands of one ID, across topics and partitions; see operators/ordered.
POSITION = ("seen_ms", *LANE, "offset")

HEADERS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("value", T.BinaryType()),
        ]
    )
)

# What a log source hands over: the columns of Spark's Kafka source.
RAW_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", HEADERS),
    ]
)

ERROR = T.StructType(
    [
        T.StructField("class", T.StringType()),
        T.StructField("cause_class", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("cause_message", T.StringType()),
        T.StructField(
            "paths",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("message", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

# A decoded command.
COMMANDS = T.StructType(
    [
        T.StructField("schedule_id", T.StringType()),
        T.StructField("source_topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("arrival_ms", T.LongType()),
        T.StructField("command", T.StringType()),
        T.StructField("is_expired", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("due_ms", T.LongType()),
        T.StructField("target_topic", T.StringType()),
        T.StructField("out_key", T.BinaryType()),
        T.StructField("out_value", T.BinaryType()),
        T.StructField("out_headers", T.MapType(T.StringType(), T.BinaryType())),
        T.StructField("error", ERROR),
    ]
)

# A record on its way out: the columns Spark's Kafka sink takes.
OUTGOING = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
    ]
)


@dataclass(frozen=True)
class Topics:
    """Command topics by payload format; one of the two lists may be empty."""

    avro: tuple[str, ...] = ()
    json: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "avro", tuple(self.avro))
        object.__setattr__(self, "json", tuple(self.json))
        if not self.avro and not self.json:
            raise ValueError("both Avro and JSON topics were empty")


@dataclass(frozen=True)
class Broker:
    """Address and client properties of one side (reading or writing)."""

    bootstrap_servers: str = "localhost:9092"
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    topics: Topics
    consumer: Broker = Broker()
    producer: Broker = Broker()
