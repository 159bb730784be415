import random
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from delayfold.operators import lifecycle as life, metrics, state
from delayfold.operators.ordered import Slicing, placed
from delayfold.operators.running import running_sum
from frames import commands, formatted_plan
from replay_model import in_order, replay

POINTS = "schedule_id string, at_ms long"


def random_log(spark, seed, n=1_500):
    pick, rows = random.Random(seed), []
    for i in range(n):
        kind = pick.choice(["update"] * 5 + ["delete", "error"])
        at = i + pick.randrange(-30, 30) + 100
        rows.append(
            {
                "schedule_id": "hot" if pick.random() < 0.5 else f"u{pick.randrange(9)}",
                "arrival_ms": at,
                "partition": pick.randrange(2),
                "source_topic": pick.choice(["t", "\U0001f600"]),
                "command": kind,
                "is_expired": pick.random() < 0.3,
                "due_ms": at + pick.randrange(-20, 60) if kind == "update" else None,
            }
        )
    return commands(spark, rows)


def expected_at(filled, points, gate):
    ordered = in_order(c for c in filled if not (c["command"] == "delete" and c["is_expired"]))
    out = []
    for name, at in points:
        last = [c for c in ordered if c["schedule_id"] == name and at is not None and c["seen_ms"] <= at][-1:]
        waits = [c for c in last if c["command"] == "update" and max(c["seen_ms"], c["due_ms"], gate) > at]
        out.append((name, at, bool(waits), waits[0]["offset"] if waits else None))
    return out


@pytest.mark.parametrize("slicing", [Slicing(), Slicing(least=100, samples=10)])
@pytest.mark.parametrize("gate", [0, 500])
def test_points_find_what_waits(spark, slicing, gate):
    log, filled = random_log(spark, 5)
    pick = random.Random(6)
    points = [(f"u{pick.randrange(11)}" if pick.random() < 0.4 else "hot", pick.randrange(-5, 1_800)) for _ in range(900)]
    points += [points[0], points[0], (None, 5), ("hot", None), ("hot", None), ("", 7)]
    frame = spark.createDataFrame(points, POINTS).withColumn("found", F.lit("x"))
    got = state.pending_at_points(log, frame, gate, slicing=slicing).collect()
    assert sorted(((r.schedule_id, r.at_ms, r.found, r.offset) for r in got), key=repr) == sorted(
        expected_at(filled, points, gate), key=repr
    )
    assert all((r.due_ms is not None) == r.found for r in got)


@pytest.mark.parametrize("expected", [1, 600, 200_000])
def test_rows_are_placed_among_many_cuts_by_short_arrays(spark, expected):
    pick, n = random.Random(2), 70_000
    cuts = spark.range(1, n + 1).selectExpr("'hot' as id", "id * 2 as _cut", "cast(id as int) as _number")
    few = [("a", 5, 1), ("a", 5, 2), ("a", 9, 3)]
    cuts = cuts.unionByName(spark.createDataFrame(few, "id string, _cut long, _number int"))
    ats = [0, 1, 2, 3, 511, 512, 513, 1024, 131_071, 131_072, 2 * n - 1, 2 * n, 2 * n + 9]
    ats += [pick.randrange(2 * n) for _ in range(300)]
    rows = [("hot", at) for at in ats] + [("a", 4), ("a", 5), ("a", 9), ("cold", 7)]
    frame = spark.createDataFrame(rows, "id string, at long")
    got = placed(frame, cuts, ["id"], F.col("at"), "n", expected)
    wanted = [("hot", at, min(n, at // 2)) for at in ats] + [("a", 4, 0), ("a", 5, 2), ("a", 9, 3), ("cold", 7, 0)]
    assert sorted(map(tuple, got.select("id", "at", "n").collect())) == sorted(wanted)
    if expected > 70_000:
        assert formatted_plan(got).count("BroadcastHashJoin") >= 2


def test_points_of_empty_tables(spark):
    log, _ = random_log(spark, 1, 20)
    none = spark.createDataFrame([], POINTS)
    assert state.pending_at_points(log, none).count() == 0
    some = spark.createDataFrame([("hot", 90)], POINTS)
    assert [r.found for r in state.pending_at_points(log.limit(0), some).collect()] == [False]


def test_points_are_sorted_in_one_shuffle(spark):
    log, _ = random_log(spark, 1, 20)
    some = spark.createDataFrame([("hot", 90)], POINTS)
    plan = formatted_plan(state.pending_at_points(log, some, rows=20))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("per_range", [1_000_000, 7, 1])
def test_running_sum(spark, per_range):
    pick = random.Random(per_range)
    rows = [(pick.randrange(-50, 50), pick.randrange(-3, 4)) for _ in range(400)] + [(7, 1)] * 300 + [(None, 9)]
    table = spark.createDataFrame(rows, "at long, value long")
    sums = Counter()
    for at, value in rows[:-1]:
        sums[at] += value
    ats = sorted(sums)
    expected = list(zip(ats, [sums[a] for a in ats], accumulate(sums[a] for a in ats)))
    got = running_sum(table, "at", "value", "total", per_range)
    assert sorted(map(tuple, got.collect())) == expected
    assert running_sum(table.limit(0), "at", "value", "total", per_range).count() == 0


@pytest.mark.parametrize("as_of", [None, 900])
def test_active_over_time(spark, as_of):
    log, filled = random_log(spark, 8)
    ends = replay(filled, as_of)
    seen = {c["offset"]: c["seen_ms"] for c in in_order(
        c for c in filled
        if (as_of is None or c["arrival_ms"] <= as_of) and not (c["command"] == "delete" and c["is_expired"])
    )}
    change = Counter()
    for offset, (_, closed) in ends.items():
        change[seen[offset]] += 1
        if closed is not None:
            change[closed] -= 1
    ats = sorted(change)
    expected = list(zip(ats, [change[a] for a in ats], accumulate(change[a] for a in ats)))
    got = metrics.active_over_time(life.lifecycle(log, as_of), per_range=100).collect()
    assert sorted((r.at_ms, r.change, r.active) for r in got) == expected
    waiting = sum(what == "pending" for what, _ in ends.values())
    assert expected[-1][2] == waiting
