import random

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from delayfold.functions import clock
from delayfold.model import MAX_DELAY_MS
from delayfold.operators import lifecycle as life, state
from delayfold.operators.ordered import Slicing, split
from frames import commands
from replay_model import replay

FINE = Slicing(least=8, samples=2)


def outcomes(spark, rows, **how):
    frame, _ = commands(spark, rows)
    history = life.lifecycle(frame, **how).collect()
    return {r.offset: (r.outcome, r.closed_ms) for r in history}


def update(at, due, **more):
    return {"arrival_ms": at, "due_ms": due, **more}


def delete(at, **more):
    return {"arrival_ms": at, "command": "delete", **more}


def report(at, **more):
    return delete(at, is_expired=True, **more)


def error(at, **more):
    return {"arrival_ms": at, "command": "error", **more}


RULES = {
    "fires when due": ([update(1, 9)], {}, {0: ("fired", 9)}),
    "identity is the id, not the topic": (
        [update(1, 9), update(2, 9, source_topic="u")],
        {},
        {0: ("superseded", 2), 1: ("fired", 9)},
    ),
    "other ids do not matter": (
        [update(1, 9), update(2, 9, schedule_id="b")],
        {},
        {0: ("fired", 9), 1: ("fired", 9)},
    ),
    "update replaces": ([update(1, 9), update(5, 7)], {}, {0: ("superseded", 5), 1: ("fired", 7)}),
    "delete cancels": ([update(1, 9), delete(5)], {}, {0: ("canceled", 5)}),
    "delete of nothing": ([delete(5)], {}, {}),
    "fired-report is ignored": ([update(1, 9), report(5)], {}, {0: ("fired", 9)}),
    "error cancels": ([update(1, 9), error(5)], {}, {0: ("canceled_by_error", 5)}),
    "error with expired flag cancels": (
        [update(1, 9), error(5, is_expired=True)],
        {},
        {0: ("canceled_by_error", 5)},
    ),
    "past due fires on arrival": ([update(50, 9)], {}, {0: ("fired", 50)}),
    "lowest due time is past due": ([update(50, -(2**63))], {}, {0: ("fired", 50)}),
    "far future is clamped": ([update(50, 2**63 - 1)], {}, {0: ("fired", 50 + MAX_DELAY_MS)}),
    "a command after firing changes nothing": ([update(1, 9), delete(10)], {}, {0: ("fired", 9)}),
    "on a tie the command wins": ([update(1, 9), delete(9)], {}, {0: ("canceled", 9)}),
    "same ms, later offset wins": (
        [update(1, 0), update(1, 0)],
        {},
        {0: ("superseded", 1), 1: ("fired", 1)},
    ),
    "within a partition the offset decides": (
        [update(100, 500), delete(50)],
        {},
        {0: ("canceled", 100)},
    ),
    "a clock that went back fires late": (
        [update(100, 500), update(50, 60)],
        {},
        {0: ("superseded", 100), 1: ("fired", 100)},
    ),
    "partitions are merged by the running time": (
        [update(100, 500, partition=1), update(40, 90, partition=0)],
        {},
        {0: ("fired", 500), 1: ("fired", 90)},
    ),
    "pending as of": ([update(1, 9)], {"as_of_ms": 8}, {0: ("pending", None)}),
    "fired as of": ([update(1, 9)], {"as_of_ms": 9}, {0: ("fired", 9)}),
    "later commands are not seen": (
        [update(1, 9), delete(5)],
        {"as_of_ms": 4},
        {0: ("pending", None)},
    ),
    "gate holds back": ([update(1, 9)], {"gate_ms": 20}, {0: ("fired", 20)}),
    "behind the gate a command cancels": (
        [update(1, 9), delete(15)],
        {"gate_ms": 20},
        {0: ("canceled", 15)},
    ),
    "behind the gate a fired-report is ignored": (
        [update(1, 9), report(10)],
        {"gate_ms": 20},
        {0: ("fired", 20)},
    ),
    "or completes": (
        [update(1, 9), report(10)],
        {"gate_ms": 20, "expired_policy": "complete"},
        {0: ("completed", 10)},
    ),
    "a report of an older schedule keeps the newer update": (
        [update(1, 9), update(10, 15), report(11)],
        {"gate_ms": 20, "expired_policy": "complete"},
        {0: ("superseded", 10), 1: ("fired", 20)},
    ),
    "the second report closes": (
        [update(1, 9), report(5), report(12)],
        {"gate_ms": 20, "expired_policy": "complete"},
        {0: ("completed", 12)},
    ),
    "a report after firing changes nothing": (
        [update(1, 9), report(10)],
        {"expired_policy": "complete"},
        {0: ("fired", 9)},
    ),
}


def rules_by_setting():
    """All rules with the same settings as one log: IDs and offsets of each rule set apart."""
    groups = {}
    for number, (rows, how, expected) in enumerate(RULES.values()):
        log, wanted, _ = groups.setdefault(str(how), ([], {}, how))
        base = 100 * number
        log += [
            {**r, "schedule_id": f"{number}{r.get('schedule_id', 'a')}", "offset": base + i}
            for i, r in enumerate(rows)
        ]
        wanted |= {base + offset: end for offset, end in expected.items()}
    return groups


BY_SETTING = rules_by_setting()


@pytest.mark.parametrize("how", BY_SETTING)
@pytest.mark.parametrize("slicing", [Slicing(), Slicing(least=1, samples=1)])
def test_rules(spark, how, slicing):
    rows, expected, settings_ = BY_SETTING[how]
    got = outcomes(spark, rows, **settings_, slicing=slicing)
    names = list(RULES)
    wrong = {names[o // 100]: got.get(o) for o in expected.keys() | got.keys() if got.get(o) != expected.get(o)}
    assert not wrong


def test_unknown_policy(spark):
    with pytest.raises(ValueError, match="unknown expired policy"):
        outcomes(spark, [update(1, 9)], expired_policy="drop")


ROWS = st.lists(
    st.fixed_dictionaries(
        {
            "schedule_id": st.sampled_from("aaaaaaabc"),
            "source_topic": st.sampled_from("tu"),
            "partition": st.integers(0, 1),
            "arrival_ms": st.integers(0, 60),
            "due_ms": st.integers(-5, 90),
            "command": st.sampled_from(["update"] * 5 + ["delete", "delete", "error"]),
            "is_expired": st.booleans(),
        }
    ),
    min_size=20,
    max_size=300,
)


@settings(
    max_examples=6,
    deadline=None,
    phases=[Phase.explicit, Phase.generate],
    suppress_health_check=list(HealthCheck),
)
@given(ROWS, st.sampled_from([None, 30, 60]), st.sampled_from([0, 25]), st.booleans())
def test_replay_equals_the_simulation(spark, rows, as_of, gate, complete):
    rows = [
        {**r, "due_ms": r["due_ms"] if r["command"] == "update" else None} for r in rows
    ]
    frame, filled = commands(spark, rows)
    expected = replay(filled, as_of, gate, complete)
    policy = life.COMPLETE if complete else life.IGNORE
    for slicing in (Slicing(), FINE):
        got = life.lifecycle(frame, as_of, gate, policy, slicing=slicing).collect()
        assert {r.offset: (r.outcome, r.closed_ms) for r in got} == expected
    if as_of is not None and not complete:
        pending = {r.offset for r in state.pending_at(frame, as_of, gate).collect()}
        if gate <= as_of:
            assert pending == {o for o, (what, _) in expected.items() if what == "pending"}


def hot_log(spark, n=30_000):
    """Nine tenths of the commands belong to one ID, a third of them in one ms."""
    base = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("u"), F.col("id") % 500))
        .otherwise("hot")
        .alias("schedule_id"),
        F.lit("t").alias("source_topic"),
        (F.col("id") % 3).cast("int").alias("partition"),
        F.col("id").alias("offset"),
        F.when(F.col("id") % 3 == 0, 500_000).otherwise(F.col("id") * 30).alias("arrival_ms"),
        F.when(F.col("id") % 7 == 0, "delete").otherwise("update").alias("command"),
        (F.col("id") % 14 == 0).alias("is_expired"),
    )
    return base.withColumn(
        "due_ms",
        F.when(F.col("command") == "update", F.col("arrival_ms") + F.col("offset") % 97 - 40),
    )


@pytest.mark.parametrize("policy", [life.IGNORE, life.COMPLETE])
def test_hot_id_is_cut_and_the_result_is_whole(spark, policy):
    log = hot_log(spark)
    slicing = Slicing(least=600, samples=20)
    columns = ["offset", "outcome", "closed_ms", "fire_ms", "next_ms"]
    cut = life.lifecycle(log, 900_000, 100_000, policy, slicing=slicing).select(*columns)
    whole = life.lifecycle(log, 900_000, 100_000, policy).select(*columns)
    assert sorted(cut.collect()) == sorted(whole.collect())


def test_no_slice_holds_much_of_a_hot_id(spark):
    log, slicing = hot_log(spark), Slicing(least=600, samples=20)
    cold, hot = split(log, slicing=slicing)
    assert {r.schedule_id for r in hot.rows.select("schedule_id").distinct().collect()} == {"hot"}
    sizes = hot.rows.groupBy("schedule_id", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * slicing.least
    assert hot.rows.count() + cold.rows.count() == 30_000


def test_slices_follow_the_log(spark):
    assert Slicing().every(10) == Slicing().every(10**9) == 1_000
    assert Slicing().every(10**13) == 100_000


def test_records_without_a_key_take_part_in_nothing(spark):
    frame, _ = commands(spark, [update(1, 9, schedule_id=None), update(2, 9)])
    assert [r.offset for r in life.lifecycle(frame).collect()] == [1]
    assert [r.offset for r in state.pending_at(frame, 5).collect()] == [1]


def test_transitions(spark):
    rows = [update(1, 9), update(5, 7), update(8, 99), delete(40), error(41, schedule_id="b"), report(42)]
    frame, _ = commands(spark, rows)
    steps = life.transitions(frame, life.lifecycle(frame, 50)).collect()
    assert sorted((r.offset, r.at_ms, r.step) for r in steps) == [
        (0, 1, "scheduled"),
        (0, 5, "superseded"),
        (1, 5, "scheduled"),
        (1, 7, "fired"),
        (2, 8, "scheduled"),
        (2, 40, "canceled"),
        (3, 40, "cancel"),
        (4, 41, "cancel"),
    ]
    assert {r.line for r in steps if r.step == "cancel"} == {"Canceled Schedule [a]", "Canceled Schedule [b]"}


def test_fired_between(spark):
    frame, _ = commands(spark, [update(1, d, schedule_id=str(d)) for d in (5, 6, 7)])
    fired = life.fired(life.lifecycle(frame), after_ms=5, until_ms=6).collect()
    assert [r.due_ms for r in fired] == [6]


@pytest.mark.parametrize(
    "due, now, wait",
    [
        (10, 3, 7),
        (3, 10, 0),
        (-(2**63), 1, 0),
        (2**63 - 1, 1, MAX_DELAY_MS),
        (2**63 - 1, -1, MAX_DELAY_MS),
        (MAX_DELAY_MS + 1, 1, MAX_DELAY_MS),
    ],
)
def test_delay(spark, due, now, wait):
    frame = spark.createDataFrame([(due, now)], "due bigint, now bigint")
    assert frame.select(clock.delay_ms(F.col("due"), F.col("now"))).first()[0] == wait


def test_clock(spark):
    now, later = spark.range(1).select(clock.now_ms(), clock.shifted_now_ms(F.lit(5))).first()
    assert later - now == 5_000


def test_random_logs_of_many_ids(spark):
    pick = random.Random(7)
    rows = [
        {
            "schedule_id": str(pick.randrange(300)),
            "arrival_ms": pick.randrange(5_000),
            "command": (kind := pick.choice(["update", "update", "update", "delete", "error"])),
            "due_ms": pick.randrange(8_000) if kind == "update" else None,
            "is_expired": pick.random() < 0.5,
        }
        for _ in range(4_000)
    ]
    frame, filled = commands(spark, rows)
    got = life.lifecycle(frame, 4_500, 1_000, life.COMPLETE).collect()
    assert {r.offset: (r.outcome, r.closed_ms) for r in got} == replay(filled, 4_500, 1_000, True)
