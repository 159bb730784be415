import json

import pytest
from pyspark.sql import functions as F

from delayfold.model import RAW_LOG, Broker, Settings, Topics
from delayfold.sources import kafka, logs
from delayfold.session import work_dir
from frames import payload, records
from test_decode_avro import encode


@pytest.mark.parametrize(
    "avro, json_", [(["a"], ["b"]), (["a"], []), ([], ["b"])]
)
def test_topics(avro, json_):
    topics = Topics(avro, json_)
    assert topics.avro == tuple(avro) and topics.json == tuple(json_)


def test_no_topics():
    with pytest.raises(ValueError, match="both Avro and JSON topics were empty"):
        Topics()
    with pytest.raises(ValueError, match="both Avro and JSON topics were empty"):
        kafka.settings_from_env({})


def test_settings_from_env():
    settings = kafka.settings_from_env(
        {
            "KAFKA_BROKERS": "b1:9092,b2:9092",
            "SCHEDULE_TOPICS": "a, b",
            "JSON_SCHEDULE_TOPICS": "c",
            "SECURITY_PROTOCOL": "SSL",
            "KEYSTORE_LOCATION": "/k",
            "CONSUMER_GROUP_ID": "g",
        }
    )
    assert settings.topics == Topics(("a", "b"), ("c",))
    assert settings.consumer.bootstrap_servers == "b1:9092,b2:9092"
    assert settings.consumer.properties["group.id"] == "g"
    assert "group.id" not in settings.producer.properties
    assert settings.producer.properties["security.protocol"] == "SSL"
    assert settings.producer.properties["ssl.keystore.location"] == "/k"


def test_source_options():
    broker = Broker("b:1", {"security.protocol": "SSL", "auto.offset.reset": "latest"})
    options = kafka.source_options(broker, ("a", "b"), maxOffsetsPerTrigger="5")
    assert options == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "a,b",
        "includeHeaders": "true",
        "startingOffsets": "earliest",
        "kafka.security.protocol": "SSL",
        "maxOffsetsPerTrigger": "5",
    }


def test_sink_options():
    broker = Broker("b:1", {"linger.ms": "100", "batch.size": "500000", "client.id": "x"})
    options = kafka.sink_options(broker)
    assert options["kafka.acks"] == "all"
    assert options["kafka.retries"] == "2147483647"
    assert options["kafka.max.in.flight.requests.per.connection"] == "1"
    assert options["kafka.enable.idempotence"] == "false"
    assert options["kafka.linger.ms"] == "10" and options["kafka.batch.size"] == "1000000"
    assert options["kafka.buffer.memory"] == "80000000"
    assert options["kafka.compression.type"] == "zstd" and options["kafka.client.id"] == "x"
    assert kafka.sink_options(broker, **{"linger.ms": "3"})["kafka.linger.ms"] == "3"


def test_offsets_option():
    option = kafka.offsets_option({("b", 0): 0, ("a", 1): 4, ("a", 0): 10})
    assert json.loads(option) == {"a": {"0": 10, "1": 4}, "b": {"0": 0}}


def test_readers_get_groups_of_their_own():
    options = kafka.source_options(Broker("b:1", {"group.id": "g"}), ("a",))
    assert options["groupIdPrefix"] == "g" and "kafka.group.id" not in options


def test_merge(spark):
    avro = records(spark, [encode(5, "out", b"k", b"v"), "foobar"], topic="a")
    json_ = records(spark, [payload(), None], topic="j")
    both = logs.merge(avro=avro, json=json_).collect()
    assert sorted((r.source_topic, r.offset, r.command) for r in both) == [
        ("a", 0, "update"),
        ("a", 1, "error"),
        ("j", 0, "update"),
        ("j", 1, "delete"),
    ]
    assert logs.merge(json=json_).count() == 2 and logs.merge(avro=avro).count() == 2
    with pytest.raises(ValueError, match="both Avro and JSON topics were empty"):
        logs.merge()


def test_table_log(spark, tmp_path):
    path = str(tmp_path / "log")
    records(spark, [payload(), None]).write.parquet(path)
    log = logs.read_table(spark, path)
    assert log.schema == RAW_LOG and log.count() == 2
    stream = logs.follow_table(spark, path, max_files=1)
    assert stream.isStreaming and stream.schema == RAW_LOG


@pytest.mark.parametrize("n", [1, 3, 2_000])
def test_first_and_last(spark, n):
    log = spark.range(5_000).select(
        F.lit("t").alias("topic"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    first = sorted(r.offset for r in logs.first_of_topic(log, n).collect())
    assert first == list(range(n))
    last = {(r.partition, r.offset) for r in logs.last_of_partition(log, n).collect()}
    ones = [i for i in range(5_000) if i % 3 == 0][-n:]
    zeros = [i for i in range(5_000) if i % 3][-n:]
    assert last == {(1, i) for i in ones} | {(0, i) for i in zeros}


def test_work_dir_is_under_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert work_dir(spark, "x").startswith(shared or "/")
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_settings_hold_both_sides():
    settings = Settings(Topics(json=("j",)))
    assert settings.consumer == settings.producer == Broker()
