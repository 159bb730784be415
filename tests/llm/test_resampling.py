import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from delayfold.llm import resampling
from delayfold.llm.queries import ORACLES, QUERIES
from llm.conftest import ROWS
from oracle import connect, differences

TARGET = [(1, "one two three don't été"), (2, None), (3, "abc " * 40), (4, "x" * 1500 + " ONE")]


def features(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(words[i : i + n]) for n in range(1, size + 1) for i in range(len(words) - n + 1)], len(words)


def brute_force(rows, target, size, buckets, percent, least, seed):
    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, size)[0])

    s, t = counted([t for _, t in rows]), counted([t for _, t in target])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    out = []
    for i, text in rows:
        found, words = features(text, size)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, words >= least])
    drawable = sorted((o for o in out if o[5]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for rank, o in enumerate(drawable[: percent * len(drawable) // 100]):
        o[4] = rank + 1
    return sorted((tuple(o[:5]) for o in out), key=repr)


@pytest.mark.parametrize("size, buckets, percent", [(1, 10_000, 10), (1, 50, 100), (3, 997, 60)])
def test_equals_brute_force(spark, docs, size, buckets, percent):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    more = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS rank", "3 AS bucket")
    got = resampling.resampled(more, target, size, buckets, percent, least_words=2, seed=7).collect()
    expected = brute_force(ROWS, TARGET, size, buckets, percent, 2, 7)
    assert sorted(map(tuple, got), key=repr) == expected


def test_empty_tables(spark, docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(no_docs, nothing).count() == 0
    got = resampling.resampled(docs, nothing, least_words=2, seed=7).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(ROWS, [], 1, 10_000, 10, 2, 7)


def test_checksums_of_any_length():
    pick = np.random.default_rng(3)
    data = pick.integers(0, 256, 20_000).astype(np.uint8)
    starts = pick.integers(0, 15_000, 400)
    ends = starts + np.concatenate([pick.integers(0, 40, 390), pick.integers(1000, 5000, 10)])
    expected = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.checksums(data, starts, ends).tolist() == expected


def test_query_equals_sql(spark):
    folder, name = "/root/testdata/sf0.001", "op13_importance_resampling"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""
