import pytest

from conftest import SMALL
from delayfold.operators import state
from delayfold.operators import lifecycle as life
from delayfold.operators.decode import decode_avro, decode_json
from delayfold.plans import fixtures as fx
from delayfold.plans.queries import FINE, QUERIES
from delayfold.sources.logs import read_table
from frames import formatted_plan

BATCH = {n: q for n, q in QUERIES.items() if not n.startswith("stream_")}


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    plan = formatted_plan(BATCH[name](spark, SMALL))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    if not name.startswith("state_size"):  # one row of counters
        assert "SinglePartition" not in plan


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


REPLAYS = ["schedule_lifecycle", "lifecycle_expired_complete", "due_publish_rows", "replay_json_log"]


@pytest.mark.parametrize("name", REPLAYS)
def test_ordinary_ids_are_shuffled_once(spark, name):
    """Both windows of ordinary IDs use one shuffle by ID; the rest of the plan is that of hot IDs."""
    plan = executed(BATCH[name](spark, SMALL))
    assert plan.count("REPARTITION_BY_COL") == 1
    assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("slicing", [life.Slicing(), FINE])
def test_the_plan_does_not_depend_on_the_size(spark, slicing):
    """Scans: the sample, ordinary IDs, and hot IDs with their edges. Each reads only what it needs."""
    raw = fx.json_log(spark, SMALL)
    frame = life.lifecycle(decode_json(raw), fx.AS_OF_MS, rows=1_000, slicing=slicing)
    plan = executed(frame)
    assert plan.count("Scan parquet") == executed(
        life.lifecycle(decode_json(raw), fx.AS_OF_MS, rows=10**12)
    ).count("Scan parquet")


@pytest.mark.parametrize("name", ["compact_log", "event_counts"])
def test_one_shuffle(spark, name):
    plan = executed(BATCH[name](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("decode", [decode_json, decode_avro])
def test_filters_on_the_envelope_pass_the_decoder(spark, tmp_path, decode):
    fx.json_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    log = decode(read_table(spark, str(tmp_path / "log")))
    plan = formatted_plan(log.where("source_topic = 'schedules-a' and schedule_id = 'u3'"))
    assert "EqualTo(topic,schedules-a)" in plan
    scan_side = plan[plan.index("PushedFilters") :]
    below = scan_side[: scan_side.find("Generate") if "Generate" in scan_side else scan_side.find("ArrowEval")]
    assert "u3" in below


def test_time_filters_reach_the_scan_of_a_raw_log(spark, tmp_path):
    fx.json_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    frame = state.pending_in_log(read_table(spark, str(tmp_path / "log")), fx.AS_OF_MS)
    assert "LessThan(timestamp" in formatted_plan(frame)
    plan = executed(frame)  # the root comes first
    assert plan.count("parseJson") == 2 and plan.index("parseJson") < plan.index("WindowGroupLimit")


NO_SHUFFLE = ["decode_json_commands", "avro_decode_fallback", "merge_sources", "encode_json_records"]


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_shuffle(spark, name):
    assert "Exchange" not in BATCH[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pending_state", "compact_log", "take_first_n"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    plan = BATCH[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_only_needed_columns_are_read(spark):
    plan = formatted_plan(state.pending_at(fx.command_log(spark, SMALL), fx.AS_OF_MS).select("offset"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,props:string>" in plan
