from pyspark.sql import functions as F

from delayfold.functions import metadata
from delayfold.operators import lifecycle as life, metrics, publish
from delayfold.operators.decode import decode_json, map_payload
from delayfold.operators.encode import to_avro_records, to_json_records
from frames import b64, commands, payload, records


def up(at, due=100, **more):
    return {"arrival_ms": at, "due_ms": due, **more}


def record(r):
    return (
        r.topic,
        bytes(r.key),
        None if r.value is None else bytes(r.value),
        [(h.key, bytes(h.value)) for h in r.headers],
    )


def test_message_and_tombstone(spark):
    frame, _ = commands(spark, [up(1, 2, out_value=None), up(1, 2, schedule_id="é", offset=9)])
    fired = life.fired(life.lifecycle(frame))
    rows = publish.fire_rows(fired, keep=("offset",)).orderBy("offset", "seq").collect()
    assert [(r.offset, r.seq) for r in rows] == [(0, 0), (0, 1), (9, 0), (9, 1)]
    assert [record(r) for r in rows] == [
        ("out", b"k0", None, [("h", b"x")]),
        ("t", b"a", None, [("schedule:expired", b"true")]),
        ("out", b"k1", b"v", [("h", b"x")]),
        ("t", "é".encode(), None, [("schedule:expired", b"true")]),
    ]
    assert sorted(map(record, publish.publish_rows(fired).collect()))[1] == record(rows[2])
    assert {record(r)[0] for r in publish.tombstone_rows(fired).collect()} == {"t"}


def test_tombstone_read_back_is_an_expired_delete(spark):
    frame, _ = commands(spark, [up(1, 2)])
    back = publish.tombstone_rows(life.fired(life.lifecycle(frame))).select(
        "key", "value", "topic", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
        F.timestamp_millis(F.lit(5)).alias("timestamp"), "headers",
    )
    row = decode_json(back).first()
    assert (row.schedule_id, row.command, row.is_expired) == ("a", "delete", True)


def test_metadata_union_has_an_identity_and_the_right_side_wins(spark):
    maps = [{}, {"a": "1"}, {"a": "2", "b": "3"}, {"schedule:expired": "no"}]
    pairs = [(x, y, z) for x in maps for y in maps for z in maps]
    kind = "map<string,string>"
    frame = spark.createDataFrame(pairs, f"x {kind}, y {kind}, z {kind}")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rows = frame.select(
        "x", "y", "z",
        metadata.combine(x, y).alias("xy"),
        metadata.combine(metadata.combine(x, y), z).alias("left"),
        metadata.combine(x, metadata.combine(y, z)).alias("right"),
        metadata.combine(metadata.empty(), x).alias("id_left"),
        metadata.combine(x, metadata.empty()).alias("id_right"),
        metadata.is_expired(metadata.expire(x)).alias("expired"),
        metadata.transform(x, lambda m: F.transform_values(m, lambda _, v: F.upper(v))).alias("changed"),
    ).collect()
    for r in rows:
        assert r.xy == {**r.x, **r.y}
        assert r.left == r.right == {**r.x, **r.y, **r.z}
        assert r.id_left == r.id_right == r.x
        assert r.expired is True
        assert r.changed == {k: v.upper() for k, v in r.x.items()}


def test_changing_the_payload_keeps_the_envelope(spark):
    frame, _ = commands(spark, [up(1), {"arrival_ms": 2, "command": "delete"}])
    same = map_payload(frame, lambda p: p)
    assert same.collect() == frame.collect()
    one = lambda p: {"due_ms": p["due_ms"] + 1}
    two = lambda p: {"due_ms": p["due_ms"] * 2}
    both = lambda p: two({**p, **one(p)})
    stepwise = map_payload(map_payload(frame, one), two)
    assert stepwise.collect() == map_payload(frame, both).collect()
    assert [r.due_ms for r in stepwise.orderBy("offset").collect()] == [202, None]


def test_writers(spark):
    frame, _ = commands(spark, [up(1, 5, out_value=None), up(1, 5)])
    written = to_json_records(frame, keep=("offset",)).orderBy("offset").collect()
    assert written[0].value.decode() == (
        '{"time":5,"topic":"out","key":"%s","value":null,"headers":{"h":"%s"}}'
        % (b64("k0"), b64("x"))
    )
    assert (written[0].topic, bytes(written[0].key)) == ("t", b"a")
    avro = to_avro_records(frame, keep=("offset",)).orderBy("offset").first()
    assert bytes(avro.value) == b"\x0a\x06out\x04k0\x00\x02\x02h\x02x\x00"


def test_event_counts_and_audit(spark):
    raw = records(spark, [payload(), None, "foobar", "{}", payload(key="-")])
    late = records(spark, [None], headers=[("schedule:expired", b"true")])
    frame = decode_json(raw.unionByName(late))
    counts = {tuple(r)[:-1]: r.events for r in metrics.event_counts(frame).collect()}
    assert counts == {
        ("update", "t", None, None, None): 1,
        ("delete", "t", "canceled", None, None): 1,
        ("delete", "t", "expired", None, None): 1,
        ("error", "t", None, "decode", "not-json"): 1,
        ("error", "t", None, "decode", "invalid-json"): 1,
        ("error", "t", None, "transformation", "transformation"): 1,
    }
    lines = {(r.level, r.line) for r in metrics.command_audit(frame).collect()}
    assert ("info", "Decoded UPDATE for [id0] from t") in lines
    assert ("info", "Decoded DELETE type=[canceled] for [id1] from t") in lines
    assert ("info", "Decoded DELETE type=[expired] for [id0] from t") in lines
    assert ("error", "Error decoding [id2] from t") in lines


def test_state_size_and_lookups(spark):
    rows = [
        up(1, schedule_id="a"),  # miss
        up(2, schedule_id="a"),  # hit
        {"arrival_ms": 3, "command": "delete", "schedule_id": "a"},  # hit
        {"arrival_ms": 4, "command": "delete", "schedule_id": "a"},  # miss
        {"arrival_ms": 4, "command": "delete", "is_expired": True},  # no lookup
        up(5, 6, schedule_id="a"),  # miss
        up(9, schedule_id="a"),  # miss, the last one has fired
        {"arrival_ms": 10, "command": "error", "schedule_id": "a"},  # hit
        up(11, schedule_id="b"),  # miss
    ]
    frame, _ = commands(spark, rows)
    size = metrics.state_size(frame, 50).first()
    assert tuple(size) == (1, 1, 1, 1, 0, 1)
    closed, _ = commands(spark, [up(1, 9), {"arrival_ms": 10, "command": "delete", "is_expired": True}])
    size = metrics.state_size(closed, 50, 20, expired_policy="complete").first()
    assert size.completed == 1 and sum(size) == 1
    hits = {r.command: (r.lookups, r.hits, r.misses) for r in metrics.lookup_hits(frame, 50).collect()}
    assert hits == {"update": (5, 1, 4), "delete": (2, 1, 1), "error": (1, 1, 0)}


def test_delivery_lag(spark):
    frame, _ = commands(spark, [up(i, i, schedule_id=str(i)) for i in range(1, 101)])
    lag = metrics.delivery_lag(life.fired(life.lifecycle(frame, gate_ms=150))).first()
    assert (lag.messages, lag.p50_ms, lag.p99_ms, lag.max_ms) == (100, 99, 148, 149)
    assert lag.within_100_ms == 51 and lag.total_ms == sum(150 - i for i in range(1, 101))
