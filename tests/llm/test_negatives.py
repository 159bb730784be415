import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from delayfold.llm import negatives
from delayfold.llm.queries import ORACLES, QUERIES
from oracle import connect, differences

SCHEMA = "vec_id long, label int, embedding array<double>, row string, planes int"


def mined(rows, scale=256, positives=5, k=3):
    kept = [
        (i, label, [math.floor(scale * x) for x in v], n)
        for n, (i, label, v) in enumerate(rows)
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, a, _ in kept:
        if i % 3:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, m) for j, m, b, _ in kept if j != i)
        for p, j, m in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(inside[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r)[:6] for r in negatives.hard_negatives(frame, F.col("vec_id") % 3 == 0, **kw).collect())


@pytest.mark.parametrize("block", [8192, 7])
def test_equals_brute_force(spark, block):
    pick = np.random.default_rng(block)
    rows = [(i, int(pick.integers(4)), [float(x) for x in pick.standard_normal(11) + 0.7]) for i in range(150)]
    rows += [(150, 1, [0.0] * 11), (153, 2, [0.5, 0.25]), (156, 1, []), (159, 1, None), (162, None, [1.0])]
    rows += [(165, 0, [None, 1.0]), (168, 0, [float("inf")]), (None, 1, [1.0]), (171, 9, [3.0] * 11)]
    rows += [(174 + i, 1 + i % 2, rows[6][2]) for i in range(5)]  # ties
    rows += [(180, 1, [-40.0, 9000.0])]  # more planes than the others
    assert run(spark, rows, block=block) == mined(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.75, 0.0])]
    got = run(spark, rows)
    assert got == mined(rows)
    assert len(got) == 4  # two anchor rows, each with both rows of vec_id 1


def test_few_none_and_huge(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [-1.0])]) == []  # no negative in range
    # Both scores count as the largest long, so the negative's share is beyond the range.
    assert run(spark, [(0, 1, [2e10, 1.0]), (1, 1, [2e10, 1.0]), (2, 2, [1.4e10, 0.0])], scale=4) == []
    assert run(spark, [(0, 1, [1e9]), (1, 1, [1e7]), (2, 2, [9e6])], scale=4) == mined(
        [(0, 1, [1e9]), (1, 1, [1e7]), (2, 2, [9e6])], scale=4
    )


def test_tables_give_products():
    pick = np.random.default_rng(0)
    for low, high in ((-5, 6), (0, 1), (-1, 0), (0, 200), (-(2**40), 2**40), (-(2**61), 2**61)):
        rows, anchors = pick.integers(low, high, (40, 13)), pick.integers(low, high, (6, 16))
        planes, bits = negatives.to_planes(rows)
        assert np.array_equal(negatives.from_planes(planes)[:, :13], rows)
        got = negatives.scores(planes, negatives.subset_sums(anchors, bits))
        want = np.pad(rows, ((0, 0), (0, 3))).astype(object) @ anchors.T.astype(object)
        assert (got == want).all()


def test_query_equals_sql(spark):
    folder, name = "/root/testdata/sf0.001", "op11_hard_negative_mining"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""
