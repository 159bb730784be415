import io

import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from delayfold.functions import avro_payload
from delayfold.operators.decode import decode_avro
from frames import records


def varint(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = io.BytesIO()
    while n > 127:
        out.write(bytes([n & 127 | 128]))
        n >>= 7
    out.write(bytes([n]))
    return out.getvalue()


def sized(data: bytes) -> bytes:
    return varint(len(data)) + data


def encode(time, topic, key, value, headers=None, block_sizes=False):
    body = varint(time) + sized(topic.encode()) + sized(key)
    body += b"\x00" if value is None else b"\x02" + sized(value)
    if headers is None:
        return body
    entries = [sized(k.encode()) + sized(v) for k, v in headers]
    if entries and block_sizes:
        joined = b"".join(entries)
        body += varint(-len(entries)) + varint(len(joined)) + joined
    elif entries:
        for entry in entries:  # one block per entry
            body += varint(1) + entry
    return body + b"\x00"


def read(spark, payloads):
    rows = decode_avro(records(spark, payloads)).orderBy("offset").collect()
    return [
        None
        if r.command != "update"
        else (
            r.due_ms,
            r.target_topic,
            bytes(r.out_key),
            None if r.out_value is None else bytes(r.out_value),
            {k: bytes(v) for k, v in r.out_headers.items()},
        )
        for r in rows
    ]


def test_layouts_and_bad_bytes(spark):
    many = [(f"h{i}", b"x" * i) for i in range(200)]
    cases = [
        (encode(5, "t", b"k", b"v", [("h", b"x")]), (5, "t", b"k", b"v", {"h": b"x"})),
        (encode(-(2**63), "", b"", None, []), (-(2**63), "", b"", None, {})),
        (encode(2**63 - 1, "é", b"\x00", b"", many, True), (2**63 - 1, "é", b"\x00", b"", dict(many))),
        (encode(5, "t", b"k", b"v", many), (5, "t", b"k", b"v", dict(many))),
        (encode(5, "t", b"k", b"v"), (5, "t", b"k", b"v", {})),
        (encode(5, "t", b"k", None), (5, "t", b"k", None, {})),
        (encode(5, "t", b"k", b"v", [("h", b"1"), ("h", b"2")]), (5, "t", b"k", b"v", {"h": b"2"})),
        (b"foobar", None),
        (b"", None),
        (encode(5, "t", b"k", b"v")[:-1], None),
        (varint(5) + varint(-3), None),
        (b"\xff" * 11, None),
        (varint(5) + sized(b"t") + sized(b"k") + varint(2), None),
        # headers cut off: readable in the older layout, which ignores what follows
        (encode(5, "t", b"k", b"v", [("h", b"x")])[:-2], (5, "t", b"k", b"v", {})),
    ]
    assert read(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_null_payload_and_error(spark):
    rows = decode_avro(records(spark, [None, "foobar"])).orderBy("offset").collect()
    assert [r.command for r in rows] == ["delete", "error"]
    assert (rows[1].error["class"], rows[1].error.cause_class) == ("decode", "invalid-avro")


SCHEDULES = st.lists(
    st.tuples(
        st.integers(-(2**63), 2**63 - 1),
        st.text(max_size=70),
        st.binary(max_size=200),
        st.none() | st.binary(max_size=200),
        st.dictionaries(st.text(max_size=5), st.binary(max_size=5), max_size=4),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(SCHEDULES, st.booleans())
def test_written_bytes_are_the_wire_format_and_read_back(spark, schedules, with_headers):
    schema = T.StructType.fromDDL(
        "i int, time bigint, topic string, key binary, value binary, headers map<string,binary>"
    )
    data = [
        (i, t, topic, bytearray(k), None if v is None else bytearray(v),
         {n: bytearray(b) for n, b in h.items()})
        for i, (t, topic, k, v, h) in enumerate(schedules)
    ]
    frame = spark.createDataFrame(data, schema)
    columns = [F.col(c) for c in ("time", "topic", "key", "value")]
    written = avro_payload.write(*columns, F.col("headers") if with_headers else None)
    got = [bytes(r.b) for r in frame.select("i", written.alias("b")).orderBy("i").collect()]
    plain = [s if with_headers else (*s[:4], {}) for s in schedules]
    assert read(spark, got) == [tuple(s) for s in plain]
    for blob, (t, topic, k, v, h) in zip(got, schedules):
        if not with_headers:
            assert blob == encode(t, topic, k, v)
        elif len(h) < 2:
            assert blob == encode(t, topic, k, v, list(h.items()))


@pytest.mark.parametrize("size", [0, 1])
def test_small_batches(spark, size):
    assert read(spark, [encode(5, "t", b"k", b"v", [])] * size) == [(5, "t", b"k", b"v", {})] * size
