"""Small command and record frames for the tests."""

from __future__ import annotations

import base64
import contextlib
import io
import json
from datetime import datetime, timezone

from delayfold.model import COMMANDS, RAW_LOG


def commands(spark, rows):
    """Rows as dicts; what is left out gets a plain value."""
    filled = []
    for i, row in enumerate(rows):
        update = row.get("command", "update") == "update"
        filled.append(
            {
                "schedule_id": "a",
                "source_topic": "t",
                "partition": 0,
                "offset": i,
                "arrival_ms": i,
                "command": "update",
                "is_expired": False,
                "metadata": {},
                "due_ms": 1_000 if update else None,
                "target_topic": "out" if update else None,
                "out_key": bytearray(b"k%d" % i) if update else None,
                "out_value": bytearray(b"v") if update else None,
                "out_headers": {"h": bytearray(b"x")} if update else None,
                "error": None,
                **row,
            }
        )
    data = [tuple(r[n] for n in COMMANDS.fieldNames()) for r in filled]
    return spark.createDataFrame(data, COMMANDS), filled


def records(spark, values, topic="t", headers=()):
    """Raw records with the given payloads (text, bytes or None)."""
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [
        (
            b"id%d" % i,
            None if v is None else bytearray(v.encode() if isinstance(v, str) else v),
            topic,
            0,
            i,
            at,
            [(k, None if x is None else bytearray(x)) for k, x in headers],
        )
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, RAW_LOG)


def b64(data) -> str:
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def payload(**change) -> str:
    """JSON payload; `...` removes a field."""
    fields = {
        "time": 5,
        "topic": "out",
        "key": b64("key"),
        "value": b64("value"),
        "headers": {"h": b64("x")},
        **change,
    }
    return json.dumps({k: v for k, v in fields.items() if v is not ...})


def formatted_plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()
