import pytest

import __spark_entry__ as entry
from conftest import SMALL
from delayfold.plans import fixtures as fx
from delayfold.plans.oracles import ORACLES as SQL
from delayfold.plans.queries import QUERIES
from delayfold.operators import lifecycle as life
from oracle import connect, differences

assert QUERIES.items() <= entry.queries().items()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["topic", "key", "value", "headers"] and frame.count() == 135


# Outcome counts of the fixture log, known from an independent simulation.
COUNTS = {
    ("0.001", 0): (135, 9, 346, 24, 70),
    ("0.001", fx.GATE_MS): (107, 9, 368, 27, 73),
    ("0.01", 0): (1205, 93, 3347, 243, 706),
    ("0.01", fx.GATE_MS): (846, 93, 3635, 258, 762),
}


@pytest.mark.parametrize("sf, gate", COUNTS)
def test_outcome_counts(spark, sf, gate):
    log = fx.command_log(spark, f"/root/testdata/sf{sf}")
    counts = life.lifecycle(log, fx.AS_OF_MS, gate).groupBy("outcome").count().collect()
    names = ("fired", "pending", "superseded", "canceled", "canceled_by_error")
    assert tuple(dict(map(tuple, counts))[n] for n in names) == COUNTS[sf, gate]
