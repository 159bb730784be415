import base64
import binascii

import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from delayfold.functions.text import base64_bytes, base64_problem, is_base64, utf8

GOOD = {"a2V5": b"key", "a2V": b"ke", "a2": b"k", "a2U=": b"ke", "aw==": b"k", "": b"", "+/+/": b"\xfb\xff\xbf"}
BAD = {
    "invalid-base64": "Illegal base64 character 2d",
    "a2V5\n": "Illegal base64 character 0a",
    "a2 V5": "Illegal base64 character 20",
    "a": "Input byte[] should at least have 2 bytes for base64 bytes",
    "=": "Input byte[] should at least have 2 bytes for base64 bytes",
    "a2V5=": "Input byte array has wrong 4-byte ending unit",
    "a2=": "Input byte array has wrong 4-byte ending unit",
    "a2V=5": "Input byte array has incorrect ending byte",
    "a===": "Input byte array has incorrect ending byte",
    "a2V5a": "Last unit does not have enough valid bits",
}


def test_strict_base64(spark):
    rows = spark.createDataFrame([(t,) for t in [*GOOD, *BAD, None]], "t string").select(
        "t", base64_bytes(F.col("t")).alias("b"), base64_problem(F.col("t")).alias("p")
    )
    found = {r.t: (None if r.b is None else bytes(r.b), r.p) for r in rows.collect()}
    assert found == {
        **{t: (b, None) for t, b in GOOD.items()},
        **{t: (None, p) for t, p in BAD.items()},
        None: (None, None),
    }


@settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.binary(max_size=300), min_size=30, max_size=60))
def test_bytes_survive_base64(spark, blobs):
    frame = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    rows = frame.select("b", F.base64("b").alias("t")).select(
        "b", "t", base64_bytes(F.col("t")).alias("back")
    )
    for r in rows.collect():
        assert bytes(r.back) == bytes(r.b) and r.t == base64.b64encode(bytes(r.b)).decode()


@settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.text(alphabet="Aa0+/=- \n", max_size=9), min_size=100, max_size=200))
def test_base64_check_agrees_with_a_strict_decoder(spark, texts):
    def strict(text):
        bare = text.rstrip("=")
        if "=" in text and len(text) % 4:
            return False
        try:
            base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
        except binascii.Error:
            return False
        return len(text) - len(bare) <= 2

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", is_base64(F.col("t")).alias("ok")
    )
    for r in rows.collect():
        assert r.ok == strict(r.t), repr(r.t)


@pytest.mark.parametrize("raw, text", [(b"ok", "ok"), (b"a\xffb", "a�b"), (b"\xe2\x82", "�")])
def test_broken_utf8_is_replaced(spark, raw, text):
    frame = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert frame.select(utf8(F.col("b"))).first()[0] == text
