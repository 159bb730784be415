import json

import pytest
from pyspark.sql import functions as F

from delayfold.operators.decode import decode_json, errors_only
from frames import b64, payload, records

UPDATE, DELETE, NOT_JSON, SHAPE, FIELD = "update", "delete", "not-json", "invalid-json", "transformation"

CASES = {
    "plain": (payload(), UPDATE),
    "no headers": (payload(headers=...), UPDATE),
    "null headers": (payload(headers=None), UPDATE),
    "no value": (payload(value=...), UPDATE),
    "null value": (payload(value=None), UPDATE),
    "extra field": (payload(other=[1]), UPDATE),
    "white space": (" \n" + payload() + "\t ", UPDATE),
    "lowest time": (payload(time=-(2**63)), UPDATE),
    "highest time": (payload(time=2**63 - 1), UPDATE),
    "time too high": (payload(time=2**63), SHAPE),
    "time far too high": (payload(time=10**40), SHAPE),
    "time as text": (payload(time="12"), UPDATE),
    "time as spaced text": (payload(time=" 12"), SHAPE),
    "time as word": (payload(time="soon"), SHAPE),
    "time with exponent text": (payload(time="1e3"), UPDATE),
    "time fraction": (payload().replace('"time": 5', '"time": 1.5'), SHAPE),
    "time whole decimal": (payload().replace('"time": 5', '"time": 1.0'), UPDATE),
    "time exponent": (payload().replace('"time": 5', '"time": 1e3'), UPDATE),
    "time long exponent": (payload().replace('"time": 5', '"time": 1706000000000123457e0'), UPDATE),
    "time highest exponent": (payload().replace('"time": 5', '"time": 9223372036854775807e0'), UPDATE),
    "time tiny fraction": (
        payload().replace('"time": 5', '"time": 5.0000000000000000000000001'), SHAPE
    ),
    "time shifted": (payload().replace('"time": 5', '"time": -12.50e1'), UPDATE),
    "time zero": (payload().replace('"time": 5', '"time": 0.0e99999'), UPDATE),
    "time huge exponent": (payload().replace('"time": 5', '"time": "1e99999"'), SHAPE),
    "time bool": (payload(time=True), SHAPE),
    "time null": (payload(time=None), SHAPE),
    "time absent": (payload(time=...), SHAPE),
    "topic number": (payload(topic=1), SHAPE),
    "topic null": (payload(topic=None), SHAPE),
    "key number": (payload(key=1), SHAPE),
    "key absent": (payload(key=...), SHAPE),
    "value number": (payload(value=1), SHAPE),
    "value object": (payload(value={}), SHAPE),
    "header number": (payload(headers={"a": 1}), SHAPE),
    "header null": (payload(headers={"a": None}), SHAPE),
    "headers list": (payload(headers=["a"]), SHAPE),
    "headers text": (payload(headers="a"), SHAPE),
    "word": ("foobar", NOT_JSON),
    "empty": ("", NOT_JSON),
    "other object": ('{"foo":"bar"}', SHAPE),
    "null literal": ("null", SHAPE),
    "array": ("[1]", SHAPE),
    "number": ("7", SHAPE),
    "single quotes": (payload().replace('"', "'"), NOT_JSON),
    "trailing text": (payload() + " x", NOT_JSON),
    "trailing value": (payload() + "," + payload(), NOT_JSON),
    "closing bracket": (payload() + "] x", NOT_JSON),
    "brackets around": (payload() + "], [1", NOT_JSON),
    "cut off": (payload()[:-1], NOT_JSON),
    "repeated field": (payload()[:-1] + ', "time": 9}', UPDATE),
    "bracket in text": (payload(topic="a]b"), UPDATE),
    "bad key": (payload(key="invalid-base64"), FIELD),
    "line break in key": (payload(key="a2V5\n"), FIELD),
    "bad header": (payload(headers={"a": "-", "b": b64("x")}), FIELD),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = decode_json(records(spark, [text for text, _ in CASES.values()])).collect()
    return dict(zip(CASES, sorted(rows, key=lambda r: r.offset)))


@pytest.mark.parametrize("name", CASES)
def test_outcome(decoded, name):
    row, expected = decoded[name], CASES[name][1]
    got = row.command if row.error is None else row.error.cause_class
    assert got == expected
    if expected != UPDATE:
        assert row.error["class"] == (FIELD if expected == FIELD else "decode")
        assert row.due_ms is None and row.out_key is None and row.out_headers is None


def test_values(decoded):
    plain = decoded["plain"]
    assert (plain.due_ms, plain.target_topic) == (5, "out")
    assert bytes(plain.out_key) == b"key" and bytes(plain.out_value) == b"value"
    assert {k: bytes(v) for k, v in plain.out_headers.items()} == {"h": b"x"}
    assert plain.schedule_id == "id0" and plain.source_topic == "t"
    assert plain.arrival_ms == 1_704_067_200_000
    for name in ("no headers", "null headers"):
        assert decoded[name].out_headers == {}
    for name in ("no value", "null value"):
        assert decoded[name].command == "update" and decoded[name].out_value is None
    times = {
        "lowest time": -(2**63),
        "highest time": 2**63 - 1,
        "time as text": 12,
        "time with exponent text": 1000,
        "time whole decimal": 1,
        "time exponent": 1000,
        "time long exponent": 1706000000000123457,
        "time highest exponent": 2**63 - 1,
        "time shifted": -125,
        "time zero": 0,
        "repeated field": 9,
    }
    assert {n: decoded[n].due_ms for n in times} == times


def test_error_messages(decoded):
    def error(name):
        return decoded[name].error, decoded[name].schedule_id

    found, key = error("word")
    assert found.message == f"Failed to decode [{key}]"
    assert found.cause_message == "'foobar' was not valid JSON"
    found, key = error("other object")
    assert found.cause_message == "JSON '{\"foo\":\"bar\"}' did not conform to Schema"
    found, key = error("bad key")
    assert found.message == (
        f"Failed to decode [{key}]: error transforming key: Illegal base64 character 2d"
    )
    found, _ = error("bad header")
    assert [p.path for p in found.paths] == ["headers(a)"]


def test_null_payload_is_a_delete(spark):
    row = decode_json(records(spark, [None])).first()
    assert (row.command, row.is_expired, row.error) == ("delete", False, None)


@pytest.mark.parametrize(
    "name, value, expired",
    [
        ("schedule:expired", b"true", True),
        ("Schedule:EXPIRED", b"TRUE", True),
        ("schedule:expired", b"false", False),
        ("schedule:expired", b"", False),
        ("schedule:expired", None, False),
        ("other", b"true", False),
    ],
)
def test_expired_flag(spark, name, value, expired):
    row = decode_json(records(spark, [None], headers=[(name, value)])).first()
    assert row.is_expired is expired


def test_headers_become_metadata(spark):
    headers = [("foo", b"bar"), ("bee", None), ("Dup", b"1"), ("dUP", b"2"), ("bad", b"\xff")]
    row = decode_json(records(spark, [payload()], headers=headers)).first()
    assert row.metadata == {"foo": "bar", "dup": "2", "bad": "�"}


def test_errors_do_not_stop_the_rest(spark):
    frame = decode_json(records(spark, ["foobar", payload(), None, "{}"]))
    assert [r.command for r in frame.orderBy("offset").collect()] == [
        "error",
        "update",
        "delete",
        "error",
    ]
    assert [r.cause_class for r in errors_only(frame).orderBy("offset").collect()] == [
        "not-json",
        "invalid-json",
    ]


def test_long_payload_is_read_whole(spark):
    value = bytes(range(256)) * 4_000
    text = payload(value=b64(value), headers={f"h{i}": b64(str(i)) for i in range(300)})
    row = decode_json(records(spark, [text])).first()
    assert bytes(row.out_value) == value and len(row.out_headers) == 300


def test_a_filter_does_not_parse_twice(spark):
    frame = decode_json(records(spark, ["foobar"])).where("command = 'error' and due_ms is null")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # once for the payload, once inside the branch for texts that hold a bracket
    assert plan.count("parseJson") == 2


def test_a_record_without_a_key_is_an_error(spark):
    raw = records(spark, [payload(), None]).withColumn("key", F.lit(None).cast("binary"))
    rows = decode_json(raw).collect()
    assert {(r.command, r.error.cause_class, r.schedule_id) for r in rows} == {("error", "no-key", None)}


def test_json_numbers_in_payload_match_python(spark):
    text = payload(time=1_706_000_000_123)
    assert decode_json(records(spark, [text])).first().due_ms == json.loads(text)["time"]
