"""The registered queries as DuckDB SQL over the base columns of `events`.

The SQL knows the rule by which each command was made, so it never parses a payload.
"""

from __future__ import annotations

from delayfold.functions.avro_payload import NAME, SCHEMA
from delayfold.plans.fixtures import AS_OF_MS, GATE_MS, LATE_MS

_ORDER = "seen_ms, source_topic, partition, \"offset\""
# The largest record time of an ID in its partition so far.
_SEEN = """max(arrival_ms) OVER (PARTITION BY schedule_id, source_topic, partition ORDER BY "offset"
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_ms"""
_ENVELOPE = "schedule_id, source_topic, partition, \"offset\", arrival_ms"
_SCHEDULE = "due_ms, target_topic, out_key, out_value, out_headers"

_EV = """ev AS (
  SELECT 'u' || user_id AS schedule_id,
         CASE WHEN event_id % 3 = 0 THEN 'schedules-b' ELSE 'schedules-a' END AS source_topic,
         CAST(user_id % 4 AS INTEGER) AS partition, event_id AS "offset",
         epoch_us(ts) // 1000 AS arrival_ms,
         epoch_us(ts) // 1000
           + (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) - 10) * 3600000 AS all_due_ms,
         'out-' || event_type AS all_target, event_type, props, user_id, event_id % 20 AS cls
  FROM events)"""

_CMD = f"""{_EV}, cmd AS (
  SELECT *, CASE WHEN cls IN (14, 15) THEN 'delete' WHEN cls IN (16, 17, 18) THEN 'error'
                 ELSE 'update' END AS command,
         cls = 15 AS is_expired,
         CASE WHEN cls < 14 OR cls = 19 THEN all_due_ms END AS due_ms,
         CASE WHEN cls < 14 OR cls = 19 THEN all_target END AS target_topic,
         CASE WHEN cls < 14 OR cls = 19 THEN hex('k' || "offset") END AS out_key,
         CASE WHEN cls < 13 OR cls = 19 THEN hex(props) END AS out_value,
         CASE WHEN cls < 12 OR cls IN (13, 19) THEN 'etype=' || hex(event_type)
              WHEN cls = 12 THEN '' END AS out_headers,
         CASE WHEN cls IN (16, 17) THEN 'decode' WHEN cls = 18 THEN 'transformation'
              END AS error_class,
         CASE cls WHEN 16 THEN 'not-json' WHEN 17 THEN 'invalid-json'
                  WHEN 18 THEN 'transformation' END AS error_cause,
         CASE WHEN cls IN (16, 17) THEN 'Failed to decode [' || schedule_id || ']'
              WHEN cls = 18 THEN 'Failed to decode [' || schedule_id
                || ']: error transforming key: Illegal base64 character 2d' END AS error_message,
         CASE cls WHEN 16 THEN '''foobar'' was not valid JSON'
                  WHEN 17 THEN 'JSON ''{{"foo":"bar"}}'' did not conform to Schema'
              END AS error_cause_message,
         CASE WHEN cls IN (16, 17) THEN '' WHEN cls = 18 THEN 'key' END AS error_paths
  FROM ev)"""

# Each seventh record is stamped two hours early; its place in the partition stays.
_LATE = f"""late AS (
  SELECT * REPLACE (arrival_ms - CASE WHEN "offset" % 7 = 0 THEN {LATE_MS} ELSE 0 END AS arrival_ms)
  FROM cmd),"""

_DECODED = (
    f"{_ENVELOPE}, command, is_expired, {_SCHEDULE}, "
    "error_class, error_cause, error_message, error_cause_message, error_paths"
)
_HISTORY = f"{_ENVELOPE}, due_ms, fire_ms, next_ms, outcome, closed_ms"


def _history(
    gate: int = 0, source: str = "cmd", as_of: int | None = AS_OF_MS, complete: bool = False
) -> str:
    """CTE chain ending in `life`: every update up to `as_of` with its outcome."""
    seen = "true" if as_of is None else f"arrival_ms <= {as_of}"
    reached = "true" if as_of is None else f"fire_ms <= {as_of}"
    completed = (
        """(SELECT min(r.seen_ms) FROM reports r
            WHERE r.schedule_id = u.schedule_id AND r.before = u.pos
              AND u.due_ms <= r.seen_ms AND r.seen_ms <= u.fire_ms)"""
        if complete
        else "CAST(NULL AS BIGINT)"
    )
    counts = "true" if complete else "NOT (command = 'delete' AND is_expired)"
    return f"""{_CMD}, {_LATE if source.startswith("late") else ""}
{_hot("late" if source.startswith("late") else "cmd") if source.endswith("hot") else ""} timed AS (
  SELECT *, {_SEEN} FROM {source.removeprefix("late_")} WHERE {seen} AND {counts}),
seen AS (
  SELECT *, row(seen_ms, source_topic, partition, "offset") AS pos,
         greatest(seen_ms, due_ms, {gate}) AS fire_ms
  FROM timed),
nxt AS (
  SELECT *, lead(seen_ms) OVER w AS next_ms, lead(command) OVER w AS next_command
  FROM seen WHERE NOT (command = 'delete' AND is_expired)
  WINDOW w AS (PARTITION BY schedule_id ORDER BY {_ORDER})),
reports AS (
  SELECT * FROM (
    SELECT *, last_value(CASE WHEN NOT (command = 'delete' AND is_expired) THEN pos END
                         IGNORE NULLS) OVER (
             PARTITION BY schedule_id ORDER BY {_ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM seen)
  WHERE command = 'delete' AND is_expired),
ended AS (
  SELECT *, {completed} AS completed_ms FROM nxt u WHERE command = 'update'),
judged AS (
  SELECT *, CASE WHEN completed_ms IS NOT NULL THEN 'completed'
                 WHEN next_ms IS NULL OR fire_ms < next_ms
                   THEN CASE WHEN {reached} THEN 'fired' ELSE 'pending' END
                 WHEN next_command = 'update' THEN 'superseded'
                 WHEN next_command = 'delete' THEN 'canceled'
                 ELSE 'canceled_by_error' END AS outcome
  FROM ended),
life AS (
  SELECT * REPLACE (coalesce(completed_ms, next_ms) AS next_ms),
         CASE outcome WHEN 'completed' THEN completed_ms WHEN 'fired' THEN fire_ms
                      WHEN 'pending' THEN NULL ELSE next_ms END AS closed_ms
  FROM judged)"""


def _hot(source: str = "cmd") -> str:
    return f"""hot AS (
  SELECT * REPLACE (CASE WHEN "offset" % 3 = 0 THEN 'hot' ELSE schedule_id END AS schedule_id)
  FROM {source}),"""


def _waiting(source: str = "cmd") -> str:
    return f"""{_CMD}, {_LATE if source == "late" else ""} timed AS (
  SELECT *, {_SEEN} FROM {source}
  WHERE arrival_ms <= {AS_OF_MS} AND NOT (command = 'delete' AND is_expired)),
last AS (
  SELECT *, greatest(seen_ms, due_ms) AS fire_ms,
         row_number() OVER (PARTITION BY schedule_id ORDER BY seen_ms DESC,
           source_topic DESC, partition DESC, "offset" DESC) AS rn
  FROM timed),
pending AS (
  SELECT * FROM last WHERE rn = 1 AND command = 'update' AND fire_ms > {AS_OF_MS})"""


_PENDING = _waiting()

def _compacted(source: str) -> str:
    return f""", newest AS (
  SELECT *, row_number() OVER (PARTITION BY source_topic, partition, schedule_id
    ORDER BY "offset" DESC) AS rn FROM {source})
SELECT {_ENVELOPE}, command, due_ms, out_key FROM newest
WHERE rn = 1 AND NOT (command = 'delete' AND arrival_ms < {AS_OF_MS} - 3600000)"""


_PUBLISH = "target_topic AS topic, out_key AS key, out_value AS value, out_headers AS headers"
_TOMBSTONE = (
    "source_topic AS topic, hex(schedule_id) AS key, CAST(NULL AS VARCHAR) AS value, "
    "'schedule:expired=' || hex('true') AS headers"
)


def _outbox(chain: str) -> str:
    """Message and tombstone of everything that fired."""
    return f"""{chain}
SELECT {_ENVELOPE}, due_ms, fire_ms, CAST(0 AS BIGINT) AS seq, {_PUBLISH} FROM life
WHERE outcome = 'fired'
UNION ALL
SELECT {_ENVELOPE}, due_ms, fire_ms, 1, {_TOMBSTONE} FROM life WHERE outcome = 'fired'"""


_PLACE = 'schedule_id, source_topic, partition, "offset"'

_COUNTS = """SELECT command AS message_type, source_topic AS message_source,
       CASE WHEN command = 'delete' THEN CASE WHEN is_expired THEN 'expired'
            ELSE 'canceled' END END AS delete_type,
       error_class AS error_type, error_cause, count(*) AS events
FROM cmd GROUP BY ALL"""


def _audit() -> str:
    return f"""SELECT {_ENVELOPE}, CASE WHEN command = 'error' THEN 'error' ELSE 'info' END AS level,
       CASE command
         WHEN 'update' THEN 'Decoded UPDATE for [' || schedule_id || '] from ' || source_topic
         WHEN 'delete' THEN 'Decoded DELETE type=['
           || CASE WHEN is_expired THEN 'expired' ELSE 'canceled' END
           || '] for [' || schedule_id || '] from ' || source_topic
         ELSE 'Error decoding [' || schedule_id || '] from ' || source_topic END AS line,
       error_message
FROM cmd"""


def _steps(as_of: int | None = None) -> str:
    """Steps of the schedules in `life`, and the cancels up to a time."""
    until = "" if as_of is None else f"arrival_ms <= {as_of} AND"
    return f"""SELECT schedule_id, source_topic, partition, "offset", target_topic, due_ms,
       'scheduled' AS step, arrival_ms AS at_ms, 'Scheduled [' || schedule_id || ']' AS line
FROM life
UNION ALL
SELECT schedule_id, source_topic, partition, "offset", target_topic, due_ms, outcome, closed_ms,
       CASE WHEN outcome = 'fired'
              THEN 'Scheduled [' || schedule_id || '] to ' || target_topic || ' due at ' || due_ms
            END
FROM life WHERE outcome <> 'pending'
UNION ALL
SELECT schedule_id, source_topic, partition, "offset", NULL, NULL, 'cancel', arrival_ms,
       'Canceled Schedule [' || schedule_id || ']'
FROM cmd WHERE {until} command <> 'update'
  AND NOT (command = 'delete' AND is_expired)"""


def _at_points(source: str) -> str:
    """The last command of each ID and ms, joined to the points by time."""
    user = "CASE WHEN at_ms % 3 = 0 THEN 'hot' ELSE supplier END" if source == "hot" else "supplier"
    return f"""WITH {_CMD}, {_hot() if source == "hot" else ""} timed AS (
  SELECT *, {_SEEN} FROM {source} WHERE NOT (command = 'delete' AND is_expired)),
last AS (
  SELECT *, greatest(seen_ms, due_ms) AS fire_ms FROM timed
  QUALIFY row_number() OVER (PARTITION BY schedule_id, seen_ms
    ORDER BY source_topic DESC, partition DESC, "offset" DESC) = 1),
spread AS (
  SELECT 'u' || l_suppkey AS supplier,
         1704067200000 + (l_orderkey * 1000003 + l_linenumber * 7919) % 2678400000 AS at_ms
  FROM lineitem),
points AS (SELECT {user} AS schedule_id, at_ms FROM spread),
joined AS (
  SELECT p.schedule_id, p.at_ms, coalesce(c.command = 'update' AND c.fire_ms > p.at_ms, false) AS found,
         c."offset", c.due_ms, c.fire_ms, c.out_key
  FROM points p ASOF LEFT JOIN last c ON p.schedule_id = c.schedule_id AND p.at_ms >= c.seen_ms)
SELECT schedule_id, at_ms, found, CASE WHEN found THEN "offset" END AS "offset",
       CASE WHEN found THEN due_ms END AS due_ms, CASE WHEN found THEN fire_ms END AS fire_ms,
       CASE WHEN found THEN out_key END AS out_key
FROM joined"""


_UPDATES = "WHERE command = 'update'"
_JSON = """'{"time":' || due_ms || ',"topic":"' || target_topic
  || '","key":"' || to_base64(CAST('k' || "offset" AS BLOB))
  || '","value":' || CASE WHEN cls = 13 THEN 'null'
       ELSE '"' || to_base64(CAST(props AS BLOB)) || '"' END
  || ',"headers":' || CASE WHEN cls = 12 THEN '{}'
       ELSE '{"etype":"' || to_base64(CAST(event_type AS BLOB)) || '"}' END || '}'"""

ORACLES: dict[str, str] = {
    "classify_commands": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, is_expired, NOT (command = 'delete' AND is_expired) AS takes_effect
FROM cmd""",
    "effective_commands": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command FROM cmd WHERE NOT (command = 'delete' AND is_expired)""",
    "decode_json_commands": f"WITH {_CMD} SELECT {_DECODED} FROM cmd",
    "avro_decode_fallback": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, is_expired, due_ms, target_topic, out_key, out_value,
       CASE WHEN command <> 'update' THEN NULL WHEN "offset" % 2 = 1 THEN ''
            ELSE out_headers END AS out_headers,
       CASE WHEN command = 'error' THEN 'decode' END AS error_class,
       CASE WHEN command = 'error' THEN 'invalid-avro' END AS error_cause,
       CASE WHEN command = 'error' THEN 'Failed to decode [' || schedule_id || ']'
            END AS error_message,
       CASE WHEN command = 'error' THEN
         'Avro message did not conform to Schema: {NAME}: {SCHEMA}' END AS error_cause_message,
       CASE WHEN command = 'error' THEN '' END AS error_paths
FROM cmd""",
    "merge_one_group": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, due_ms, target_topic, out_key FROM cmd""",
    "map_payload_kept": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, is_expired, due_ms + 60000 AS due_ms,
       target_topic || '-retry' AS target_topic, out_key, out_value, out_headers FROM cmd""",
    "metadata_transformed": f"""WITH {_CMD}
SELECT "offset", 'source' AS name, upper(source_topic) AS value FROM cmd
UNION ALL SELECT "offset", 'schedule:expired', 'TRUE' FROM cmd WHERE is_expired""",
    "clock_shift": f"""WITH {_EV}
SELECT "offset", CAST(cls * 1000 AS BIGINT) AS shift_ms FROM ev""",
    "merge_sources": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, due_ms, target_topic, out_key FROM cmd
WHERE source_topic = 'schedules-a'
UNION ALL
SELECT {_ENVELOPE}, command, due_ms, target_topic, out_key FROM cmd
WHERE source_topic = 'schedules-b'""",
    "base64_decode_fields": f"""WITH {_EV}
SELECT "offset", 'key' AS path,
       CASE WHEN cls NOT IN (17, 18) THEN hex('k' || "offset") END AS bytes,
       CASE cls WHEN 18 THEN 'Illegal base64 character 2d'
                WHEN 17 THEN 'Illegal base64 character 0a' END AS problem
FROM ev
UNION ALL
SELECT "offset", 'value', CASE WHEN cls <> 13 THEN hex(props) END, NULL FROM ev""",
    "headers_to_metadata": f"""WITH {_EV}
SELECT "offset", 'k' AS name, all_target AS value FROM ev
UNION ALL SELECT "offset", 'etype', 'merged' FROM ev
UNION ALL SELECT "offset", 'source', source_topic FROM ev
UNION ALL SELECT "offset", 'schedule:expired', 'true' FROM ev""",
    "encode_json_records": f"""WITH {_CMD}
SELECT "offset", source_topic AS topic, schedule_id AS key, {_JSON} AS payload
FROM cmd {_UPDATES}""",
    "encode_json_roundtrip": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, {_SCHEDULE} FROM cmd {_UPDATES}""",
    "encode_avro_roundtrip": f"""WITH {_CMD}
SELECT {_ENVELOPE}, command, {_SCHEDULE} FROM cmd {_UPDATES}""",
    "delay_clamped": f"""WITH {_EV}, due AS (
  SELECT "offset", CAST(CASE cls WHEN 0 THEN 9223372036854775807
    WHEN 1 THEN -9223372036854775808 ELSE all_due_ms END AS HUGEINT) AS due FROM ev)
SELECT "offset",
       CAST(least(greatest(due - {AS_OF_MS}, 0), 9223372036854) AS BIGINT) AS delay_ms
FROM due""",
    "schedule_lifecycle": f"WITH {_history()} SELECT {_HISTORY} FROM life",
    "lifecycle_gated": f"WITH {_history(GATE_MS)} SELECT {_HISTORY} FROM life",
    "lifecycle_expired_complete": (
        f"WITH {_history(GATE_MS, complete=True)} SELECT {_HISTORY} FROM life"
    ),
    "lifecycle_hot_id": (
        f"WITH {_history(GATE_MS, 'hot', complete=True)} SELECT {_HISTORY} FROM life"
    ),
    "lifecycle_late_timestamps": (
        f"WITH {_history(GATE_MS, 'late', complete=True)} SELECT {_HISTORY}, seen_ms FROM life"
    ),
    "lifecycle_late_hot_id": (
        f"WITH {_history(GATE_MS, 'late_hot', complete=True)} SELECT {_HISTORY}, seen_ms FROM life"
    ),
    "pending_late_timestamps": f"""WITH {_waiting("late")}
SELECT {_ENVELOPE}, {_SCHEDULE}, seen_ms, fire_ms FROM pending""",
    "pending_in_json_log": f"""WITH {_PENDING}
SELECT {_ENVELOPE}, {_SCHEDULE}, seen_ms, fire_ms FROM pending""",
    "pending_state": f"WITH {_PENDING} SELECT {_ENVELOPE}, {_SCHEDULE}, fire_ms FROM pending",
    "state_lookup": f"""WITH {_PENDING}
SELECT 'u' || c_custkey AS schedule_id, p.schedule_id IS NOT NULL AS found,
       due_ms, target_topic, out_key
FROM customer LEFT JOIN pending p ON p.schedule_id = 'u' || c_custkey""",
    "due_publish_rows": f"""WITH {_history()}
SELECT {_PUBLISH} FROM life WHERE outcome = 'fired'""",
    "due_in_last_day": f"""WITH {_history()}
SELECT {_ENVELOPE}, due_ms, fire_ms, out_key FROM life
WHERE outcome = 'fired' AND fire_ms > {AS_OF_MS - 86_400_000}""",
    "replay_json_log": f"""WITH {_history()}
SELECT {_PUBLISH} FROM life WHERE outcome = 'fired'""",
    "fire_rows_paired": f"""WITH {_history(GATE_MS)}
SELECT "offset", fire_ms, CAST(0 AS BIGINT) AS seq, {_PUBLISH} FROM life WHERE outcome = 'fired'
UNION ALL
SELECT "offset", fire_ms, 1, {_TOMBSTONE} FROM life WHERE outcome = 'fired'""",
    "compact_log": f"WITH {_CMD} {_compacted('cmd')}",
    "compact_log_by_offset": f"WITH {_CMD}, {_LATE} {_compacted('late').removeprefix(', ')}",
    "compact_log_safe": f"""WITH {_PENDING}
SELECT {_ENVELOPE}, command, {_SCHEDULE} FROM pending""",
    "take_first_n": f"""WITH {_EV}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_topic ORDER BY "offset", partition) AS rank
  FROM ev)
SELECT source_topic AS topic, partition, "offset", rank, schedule_id AS key
FROM ranked WHERE rank <= 25""",
    "tail_per_partition": f"""WITH {_EV}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_topic, partition
    ORDER BY "offset" DESC) AS rank FROM ev)
SELECT source_topic AS topic, partition, "offset", rank, schedule_id AS key
FROM ranked WHERE rank <= 10""",
    "event_counts": f"WITH {_CMD} {_COUNTS}",
    "state_size_metrics": f"""WITH {_history()}
SELECT count(*) FILTER (outcome = 'pending') AS active,
       count(*) FILTER (outcome = 'superseded') AS superseded,
       count(*) FILTER (outcome = 'canceled') AS canceled,
       count(*) FILTER (outcome = 'canceled_by_error') AS canceled_by_error,
       count(*) FILTER (outcome = 'completed') AS completed,
       count(*) FILTER (outcome = 'fired') AS fired
FROM life""",
    "state_size_complete": f"""WITH {_history(GATE_MS, complete=True)}
SELECT count(*) FILTER (outcome = 'pending') AS active,
       count(*) FILTER (outcome = 'superseded') AS superseded,
       count(*) FILTER (outcome = 'canceled') AS canceled,
       count(*) FILTER (outcome = 'canceled_by_error') AS canceled_by_error,
       count(*) FILTER (outcome = 'completed') AS completed,
       count(*) FILTER (outcome = 'fired') AS fired
FROM life""",
    "active_over_time": f"""WITH {_history()}, changes AS (
  SELECT seen_ms AS at_ms, 1 AS change FROM life
  UNION ALL SELECT closed_ms, -1 FROM life WHERE closed_ms IS NOT NULL)
SELECT at_ms, CAST(sum(change) AS BIGINT) AS change,
       CAST(sum(sum(change)) OVER (ORDER BY at_ms) AS BIGINT) AS active
FROM changes GROUP BY at_ms""",
    "pending_at_points": _at_points("cmd"),
    "pending_at_points_hot": _at_points("hot"),
    "lookup_hits": f"""WITH {_CMD}, timed AS (SELECT *, arrival_ms AS seen_ms FROM cmd), asked AS (
  SELECT *, lag(command) OVER w AS last_command,
         greatest(lag(arrival_ms) OVER w, lag(due_ms) OVER w) AS last_fire_ms
  FROM timed WHERE arrival_ms <= {AS_OF_MS} AND NOT (command = 'delete' AND is_expired)
  WINDOW w AS (PARTITION BY schedule_id ORDER BY {_ORDER}))
SELECT command, count(*) AS lookups,
       count(*) FILTER (last_command = 'update' AND last_fire_ms >= arrival_ms) AS hits,
       count(*) - count(*) FILTER (last_command = 'update' AND last_fire_ms >= arrival_ms)
         AS misses
FROM asked GROUP BY command""",
    "command_audit": f"WITH {_CMD} {_audit()}",
    "error_rows": f"""WITH {_CMD}
SELECT {_ENVELOPE}, error_class, error_cause, error_message, error_cause_message, error_paths
FROM cmd WHERE command = 'error'""",
    "transition_audit": f"WITH {_history()} {_steps(AS_OF_MS)}",
    "delivery_lag": f"""WITH {_history(GATE_MS)}, late AS (
  SELECT target_topic, fire_ms - greatest(due_ms, arrival_ms) AS lag
  FROM life WHERE outcome = 'fired')
SELECT target_topic, count(*) AS messages, count(*) FILTER (lag <= 100) AS within_100_ms,
       quantile_disc(lag, 0.5) AS p50_ms, quantile_disc(lag, 0.99) AS p99_ms,
       max(lag) AS max_ms, CAST(sum(lag) AS BIGINT) AS total_ms
FROM late GROUP BY target_topic""",
    "stream_fire_equals_batch": _outbox(f"WITH {_history(as_of=None)}"),
    "stream_tables": f"""WITH {_history(as_of=None)}
SELECT 'outbox' AS name, {_PLACE}, fire_ms AS at_ms, target_topic AS what, out_key AS line
FROM life WHERE outcome = 'fired'
UNION ALL
SELECT 'outbox', {_PLACE}, fire_ms, source_topic, hex(schedule_id) FROM life WHERE outcome = 'fired'
UNION ALL
SELECT 'errors', {_PLACE}, arrival_ms, error_class, error_message FROM cmd WHERE command = 'error'
UNION ALL
SELECT 'commands', {_PLACE}, arrival_ms, level, line FROM ({_audit()})
UNION ALL
SELECT 'steps', {_PLACE}, at_ms, step, line FROM ({_steps()})""",
    "stream_event_counts": f"WITH {_CMD} {_COUNTS}",
    "stream_state_pending": f"""WITH {_PENDING}
SELECT {_ENVELOPE}, {_SCHEDULE}, fire_ms, fire_ms AS timer_ms FROM pending""",
    "stream_state_lookup": f"""WITH {_PENDING}
SELECT 'u' || c_custkey AS schedule_id, p.schedule_id IS NOT NULL AS found,
       due_ms, target_topic, out_key
FROM customer LEFT JOIN pending p ON p.schedule_id = 'u' || c_custkey""",
    "stream_fire_gated": _outbox(f"WITH {_history(GATE_MS, as_of=None)}"),
}
