"""Command topics on Kafka: client options, bounded initial load, then follow."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from delayfold.model import RAW_LOG, Broker, Settings, Topics
from delayfold.sources.logs import merge

# Client settings that give at-least-once delivery in order.
AT_LEAST_ONCE = {
    "retries": "2147483647",
    "acks": "all",
    "max.in.flight.requests.per.connection": "1",
    "enable.idempotence": "false",
}
# Client settings for throughput.
THROUGHPUT = {
    "linger.ms": "10",
    "batch.size": "1000000",
    "buffer.memory": "80000000",
    "compression.type": "zstd",
}
# Environment variables and the client properties they set.
ENVIRONMENT = {
    "SECURITY_PROTOCOL": "security.protocol",
    "KEYSTORE_LOCATION": "ssl.keystore.location",
    "KEYSTORE_PASSWORD": "ssl.keystore.password",
    "TRUSTSTORE_LOCATION": "ssl.truststore.location",
    "TRUSTSTORE_PASSWORD": "ssl.truststore.password",
}
# Spark sets these itself and refuses them as options.
_SPARK_OWNED = ("auto.offset.reset", "enable.auto.commit", "key.deserializer", "value.deserializer")


def settings_from_env(env: Mapping[str, str] = os.environ) -> Settings:
    """Brokers, security and topic lists (comma separated) from the environment."""

    def split(name: str) -> tuple[str, ...]:
        return tuple(t.strip() for t in env.get(name, "").split(",") if t.strip())

    security = {"security.protocol": "PLAINTEXT", "ssl.endpoint.identification.algorithm": ""}
    security |= {prop: env[name] for name, prop in ENVIRONMENT.items() if name in env}
    group = {"group.id": env["CONSUMER_GROUP_ID"]} if "CONSUMER_GROUP_ID" in env else {}
    servers = env.get("KAFKA_BROKERS", "localhost:9092")
    return Settings(
        topics=Topics(avro=split("SCHEDULE_TOPICS"), json=split("JSON_SCHEDULE_TOPICS")),
        consumer=Broker(servers, security | group),
        producer=Broker(servers, security),
    )


# Readers of one service get groups of their own under this prefix; sharing one, they would disturb
# each other.
_GROUP = "group.id"


def _client_options(properties: Mapping[str, str]) -> dict[str, str]:
    return {f"kafka.{k}": str(v) for k, v in properties.items() if k not in _SPARK_OWNED}


def source_options(broker: Broker, topics: tuple[str, ...], **more: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": broker.bootstrap_servers,
        "subscribe": ",".join(topics),
        "includeHeaders": "true",
        "startingOffsets": "earliest",
        **({"groupIdPrefix": broker.properties[_GROUP]} if _GROUP in broker.properties else {}),
        **_client_options({k: v for k, v in broker.properties.items() if k != _GROUP}),
        **more,
    }


def sink_options(broker: Broker, **explicit: str) -> dict[str, str]:
    """Delivery and throughput presets win over the broker's properties, `explicit` over all."""
    properties = {**broker.properties, **AT_LEAST_ONCE, **THROUGHPUT, **explicit}
    return {
        "kafka.bootstrap.servers": broker.bootstrap_servers,
        "includeHeaders": "true",
        **_client_options(properties),
    }


def _read(reader, settings: Settings, **more: str) -> DataFrame:
    """Decodes each topic group that is configured and merges them."""
    groups = {
        kind: reader.format("kafka")
        .options(
            **source_options(
                settings.consumer,
                topics,
                **{n: _group(v, topics) if n.endswith("Offsets") else v for n, v in more.items()},
            )
        )
        .load()
        .select(*RAW_LOG.fieldNames())
        for kind, topics in (("avro", settings.topics.avro), ("json", settings.topics.json))
        if topics
    }
    return merge(**groups)


def end_offsets(spark: SparkSession, settings: Settings) -> dict[tuple[str, int], int]:
    """Where each partition of the configured topics ends now: a metadata call of the client that comes
    with the connector, no record is read."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    client = settings.consumer.properties | {"bootstrap.servers": settings.consumer.bootstrap_servers}
    for name, value in client.items():
        if name not in (*_SPARK_OWNED, _GROUP):
            properties.setProperty(name, str(value))
    reader = jvm.org.apache.kafka.common.serialization.ByteArrayDeserializer
    consumer = jvm.org.apache.kafka.clients.consumer.KafkaConsumer(properties, reader(), reader())
    try:
        places = jvm.java.util.ArrayList()
        for topic in settings.topics.avro + settings.topics.json:
            for part in consumer.partitionsFor(topic):
                places.add(jvm.org.apache.kafka.common.TopicPartition(topic, part.partition()))
        ends = consumer.endOffsets(places)
        return {(p.topic(), p.partition()): ends[p] for p in ends}
    finally:
        consumer.close()


def offsets_option(ends: Mapping[tuple[str, int], int]) -> str:
    """Offsets as an option value: where the initial load ends and the stream begins."""
    topics: dict[str, dict[str, int]] = {}
    for (topic, partition), end in sorted(ends.items()):
        topics.setdefault(topic, {})[str(partition)] = end
    return json.dumps(topics)


def _group(offsets: str, topics: tuple[str, ...]) -> str:
    """The part of an offset option that belongs to one topic group."""
    if not offsets.startswith("{"):
        return offsets
    return json.dumps({t: parts for t, parts in json.loads(offsets).items() if t in topics})


def raw_log(spark: SparkSession, settings: Settings, ending: str = "latest") -> DataFrame:
    """Everything on the configured topics up to `ending` (latest, or an `offsets_option`), undecoded."""
    topics = settings.topics.avro + settings.topics.json
    return (
        spark.read.format("kafka")
        .options(**source_options(settings.consumer, topics, endingOffsets=ending))
        .load()
        .select(*RAW_LOG.fieldNames())
    )


def load(spark: SparkSession, settings: Settings, ending: str = "latest") -> DataFrame:
    """Bounded load of all commands up to `ending`: latest, or an `offsets_option`."""
    return _read(spark.read, settings, endingOffsets=ending)


def follow(
    spark: SparkSession, settings: Settings, starting: str = "earliest", max_offsets: int = 1_000_000
) -> DataFrame:
    """Commands from `starting` on: earliest, or an `offsets_option`.

    `max_offsets` bounds a micro-batch, also when the stream has to catch up.
    """
    return _read(
        spark.readStream,
        settings,
        startingOffsets=starting,
        maxOffsetsPerTrigger=str(max_offsets),
    )
