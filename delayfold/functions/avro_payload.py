"""Avro binary command payloads, without the optional Avro package.

Writing is plain column expressions. Reading needs a position that moves through each payload, so it
is an Arrow function: it advances one cursor per row, all rows of a batch together.

Wire layout, in this order: time (zig-zag varint), topic (string), key (bytes), value (union of null
and bytes), headers (map of bytes). The older layout has no headers.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from delayfold.functions.text import to_utf8

# Fixed value: the layout an unreadable payload is held against last, as errors name it.
NAME = "AvroScheduleWithoutHeaders"
SCHEMA = json.dumps(
    {
        "type": "record",
        "name": NAME,
        "fields": [
            {"name": "time", "type": "long"},
            {"name": "topic", "type": "string"},
            {"name": "key", "type": "bytes"},
            {"name": "value", "type": ["null", "bytes"]},
        ],
    },
    separators=(",", ":"),
)

DECODED = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("time", T.LongType()),
        T.StructField("topic", T.BinaryType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]
                )
            ),
        ),
    ]
)


class _Cursors:
    """One read position per row over the bytes of a batch. A row that cannot be read is not `ok`."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.pos, self.end = data, start.astype(np.int64), end.astype(np.int64)
        self.ok = np.ones(len(start), bool)

    def long(self, rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        unfinished = self.ok[rows]
        for shift in range(0, 70, 7):
            at_end = unfinished & (self.pos[rows] >= self.end[rows])
            self.ok[rows[at_end]] = False
            unfinished &= ~at_end
            at = np.flatnonzero(unfinished)
            if not at.size:
                break
            byte = self.data[self.pos[rows[at]]]
            self.pos[rows[at]] += 1
            value[at] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
            unfinished[at] = byte > 127
        self.ok[rows[unfinished]] = False
        return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)

    def bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.long(rows)
        fits = self.ok[rows] & (size >= 0) & (size <= self.end[rows] - self.pos[rows])
        self.ok[rows] &= fits
        start, size = self.pos[rows], np.where(fits, size, 0)
        self.pos[rows] += size
        return start, size

    def map(self, rows: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Entries as (rows, key start, key size, value start, value size), one step per tuple."""
        left = np.zeros(len(rows), np.int64)
        unfinished = self.ok[rows]
        steps = []
        while unfinished.any():
            fresh = np.flatnonzero(unfinished & (left == 0))
            count = self.long(rows[fresh])
            self.long(rows[fresh[count < 0]])  # a negative count is followed by the block's size
            left[fresh] = np.abs(count)
            unfinished[fresh[count == 0]] = False
            unfinished &= self.ok[rows] & (left >= 0)
            at = np.flatnonzero(unfinished)
            if at.size:
                steps.append((rows[at], *self.bytes(rows[at]), *self.bytes(rows[at])))
                left[at] -= 1
                unfinished &= self.ok[rows]
        self.ok[rows] &= left == 0
        return steps


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    size = np.where(valid, size, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.BinaryArray.from_buffers(
        pa.binary(),
        len(size),
        [
            pa.array(valid, pa.bool_()).buffers()[1],
            pa.py_buffer(offsets.astype(np.int32).tobytes()),
            pa.py_buffer(data[index].tobytes()),
        ],
    )


def _layout(data: np.ndarray, start: np.ndarray, end: np.ndarray, with_headers: bool) -> dict:
    cursors = _Cursors(data, start, end)
    rows = np.arange(len(start))
    found = {"time": cursors.long(rows), "topic": cursors.bytes(rows), "key": cursors.bytes(rows)}
    branch = cursors.long(rows)
    cursors.ok &= (branch == 0) | (branch == 1)
    filled = np.flatnonzero(cursors.ok & (branch == 1))
    value = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    value[0][filled], value[1][filled] = cursors.bytes(filled)
    steps = cursors.map(rows) if with_headers else []
    return {**found, "value": value, "filled": branch == 1, "steps": steps, "ok": cursors.ok}


def _decode(payloads: pa.Array) -> pa.Array:
    payloads = payloads.cast(pa.binary())
    total = len(payloads)
    _, offset_buffer, data_buffer = payloads.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[payloads.offset : payloads.offset + total + 1]
    data = np.frombuffer(data_buffer or b"", np.uint8)
    present = np.asarray(payloads.is_valid().to_numpy(zero_copy_only=False), bool)
    start, end = offsets[:-1], offsets[1:]

    read = _layout(data, start, end, with_headers=True)
    read["ok"] &= present
    steps = [[column[read["ok"][step[0]]] for column in step] for step in read["steps"]]
    rest = np.flatnonzero(present & ~read["ok"])
    if rest.size:
        older = _layout(data, start[rest], end[rest], with_headers=False)
        for name in ("time", "filled", "ok"):
            read[name][rest] = older[name]
        for name in ("topic", "key", "value"):
            read[name][0][rest], read[name][1][rest] = older[name]

    ok = read["ok"]
    owner, *places = (
        np.concatenate(columns) for columns in zip(*steps)
    ) if steps else (np.zeros(0, np.int64) for _ in range(5))
    order = np.argsort(owner, kind="stable")
    key_start, key_size, value_start, value_size = (place[order] for place in places)
    every = np.ones(len(order), bool)
    entry = pa.StructArray.from_arrays(
        [_slices(data, key_start, key_size, every), _slices(data, value_start, value_size, every)],
        names=["key", "value"],
    )
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=total))])
    return pa.StructArray.from_arrays(
        [
            pa.array(ok),
            pa.array(read["time"], mask=~ok),
            _slices(data, *read["topic"], ok),
            _slices(data, *read["key"], ok),
            _slices(data, *read["value"], ok & read["filled"]),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), entry),
        ],
        names=DECODED.fieldNames(),
    )


def read(payload: Column) -> Column:
    """Struct of `DECODED`: the current layout, else the one without headers, else not `ok`."""

    @F.arrow_udf(DECODED)
    def decode_avro_payload(payloads: pa.Array) -> pa.Array:
        return _decode(payloads)

    return decode_avro_payload(payload)


def _varint(number: Column, longest: int) -> Column:
    zigzag = F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, 63))
    pieces = []
    for i in range(longest):
        rest = F.shiftrightunsigned(zigzag, 7 * i)
        bits = rest.bitwiseAND(127)
        if i < longest - 1:
            bits += F.when(F.shiftrightunsigned(zigzag, 7 * (i + 1)) != 0, 128).otherwise(0)
        byte = F.unhex(F.lpad(F.hex(bits), 2, "0"))
        pieces.append(byte if i == 0 else F.when(rest != 0, byte).otherwise(F.lit(b"")))
    return F.concat(*pieces)


def _sized(content: Column) -> Column:
    return F.concat(_varint(F.octet_length(content).cast("bigint"), 5), content)


def write(
    due: Column, topic: Column, key: Column, value: Column, headers: Column | None
) -> Column:
    """Avro payload of a schedule; without `headers` in the older layout."""
    fields = [
        _varint(due, 10),
        _sized(to_utf8(topic)),
        _sized(key),
        F.when(value.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x02"), _sized(value))),
    ]
    if headers is not None:
        entries = F.transform(
            F.map_entries(headers),
            lambda h: F.concat(_sized(to_utf8(h["key"])), _sized(h["value"])),
        )
        block = F.aggregate(
            entries,
            _varint(F.size(headers).cast("bigint"), 5),
            lambda done, entry: F.concat(done, entry),
        )
        fields.append(
            F.when(F.size(headers) == 0, F.lit(b"\x00")).otherwise(F.concat(block, F.lit(b"\x00")))
        )
    return F.concat(*fields)
