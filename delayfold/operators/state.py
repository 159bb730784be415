"""Pending schedules as of a time, lookups in them, and compaction of the command log."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from delayfold.functions import clock
from delayfold.model import LANE, POSITION, RAW_LOG
from delayfold.operators.decode import decode_avro, decode_json, effective, envelope, is_report
from delayfold.operators.lifecycle import as_of
from delayfold.operators.ordered import ID, Ordered, Slicing, split


def _first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest(commands: DataFrame) -> DataFrame:
    """Last command per ID in the order of operators/ordered, with its `seen_ms`.

    Spark applies the rank limit before the shuffle too, so each map task sends one row per ID and
    partition at most, however hot the ID; the largest record times are summed up the same way.
    """
    named = commands.where(F.col(ID).isNotNull())
    last = _first(named, [ID, *LANE], [F.col("offset").desc()])
    seen = named.groupBy(ID, *LANE).agg(F.max("arrival_ms").alias("seen_ms"))
    return _first(last.join(seen, [ID, *LANE]), [ID], [F.col(name).desc() for name in POSITION])


def _waiting(last: DataFrame, gate_ms: int) -> DataFrame:
    fire_ms = clock.fire_ms(F.col("seen_ms"), F.col("due_ms"), gate_ms)
    return last.where(F.col("command") == "update").withColumn("fire_ms", fire_ms)


def pending_at(commands: DataFrame, as_of_ms: int, gate_ms: int = 0) -> DataFrame:
    """The schedules waiting at `as_of_ms`, one row per ID, with their `fire_ms`."""
    waiting = _waiting(latest(effective(as_of(commands, as_of_ms))), gate_ms)
    return waiting.where(F.col("fire_ms") > as_of_ms)


def waiting_at_gate(loaded: DataFrame, gate_ms: int) -> DataFrame:
    """The schedules held back while the log was `loaded`: nothing of it has fired yet."""
    return _waiting(latest(effective(loaded)), gate_ms)


def latest_in_log(
    raw: DataFrame, json_topics: Collection[str] | None = None, until_ms: int | None = None
) -> DataFrame:
    """`latest` of a raw log, ranked before any payload is decoded: key, position and headers decide.

    json_topics: the topics with JSON payloads (all, if None); the others hold Avro.
    """
    if until_ms is not None:  # on the stored column, so that the scan can skip by it
        raw = raw.where(F.col("timestamp") < F.timestamp_millis(F.lit(until_ms + 1)))
    told = envelope(raw.where(~is_report()))
    last = latest(told).select(*RAW_LOG.fieldNames(), "seen_ms")
    if json_topics is None:
        return decode_json(last, keep=("seen_ms",))
    is_json = F.col("topic").isin(list(json_topics))
    as_json = decode_json(last.where(is_json), keep=("seen_ms",))
    return as_json.unionByName(decode_avro(last.where(~is_json), keep=("seen_ms",)))


def pending_in_log(
    raw: DataFrame, as_of_ms: int, gate_ms: int = 0, json_topics: Collection[str] | None = None
) -> DataFrame:
    """`pending_at` of a raw log; only the last record of each ID is decoded."""
    waiting = _waiting(latest_in_log(raw, json_topics, as_of_ms), gate_ms)
    return waiting.where(F.col("fire_ms") > as_of_ms)


def waiting_in_log(raw: DataFrame, gate_ms: int, json_topics: Collection[str] | None = None) -> DataFrame:
    """`waiting_at_gate` of a raw log; only the last record of each ID is decoded."""
    return _waiting(latest_in_log(raw, json_topics), gate_ms)


def lookup(pending: DataFrame, ids: DataFrame) -> DataFrame:
    """The pending schedule of each asked ID; `found` tells hits from misses."""
    hits = pending.withColumn("found", F.lit(True))
    return ids.join(hits, ID, "left").withColumn("found", F.coalesce("found", F.lit(False)))


# Sorts after every topic, so that a point comes after the commands of its ms.
_POINTS = chr(0x10FFFF)


def pending_at_points(
    commands: DataFrame,
    points: DataFrame,
    gate_ms: int = 0,
    rows: int | None = None,
    slicing: Slicing = Slicing(),
) -> DataFrame:
    """What waited under an ID at a time, for many such points: the points' schedule_id and at_ms, `found`,
    and the schedule's columns, null where nothing waited.

    An as-of join without a pair of ranges: points are put between the commands of their ID, in one order,
    and take over the last command before them. So it costs one shuffle of both tables by ID, and the IDs
    with many commands or points are cut into slices like those of a replay (operators/ordered). Commands
    count at their `seen_ms`, those of the point's own ms included. Each point gives one row, repeated
    points too; points without an ID or a time find nothing.
    """
    kept = (*LANE, "offset", "arrival_ms", "due_ms", "target_topic", "out_key", "out_value", "out_headers")
    asked = points.select(ID, F.col("at_ms").cast("bigint").alias("at_ms"))
    is_whole = F.col(ID).isNotNull() & F.col("at_ms").isNotNull()
    log = effective(commands).select(ID, "command", *kept, F.lit(None).cast("bigint").alias("at_ms"))
    as_rows = asked.where(is_whole).select(
        ID,
        F.lit(None).cast("string").alias("command"),
        F.lit(_POINTS).alias("source_topic"),
        F.lit(0).alias("partition"),
        F.col("at_ms").alias("offset"),  # a lane of its own, in order of time
        F.col("at_ms").alias("arrival_ms"),
        *[F.lit(None).cast(log.schema[n].dataType).alias(n) for n in kept[4:]],
        "at_ms",
    )
    found = []
    for part in split(log.unionByName(as_rows), rows, slicing):
        fire_ms = clock.fire_ms(F.col("seen_ms"), F.col("due_ms"), gate_ms)
        command = F.when(F.col("command").isNotNull(), F.struct("command", *kept, fire_ms.alias("fire_ms")))
        ordered = Ordered(part.rows, part.cut).add_last_before("_last", command).done()
        found.append(ordered.where(F.col("at_ms").isNotNull()).select(ID, "at_ms", "_last"))
    last = reduce(DataFrame.unionByName, found)
    waits = (F.col("_last.command") == "update") & (F.col("_last.fire_ms") > F.col("at_ms"))
    nothing = asked.where(~is_whole).withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    shown = last.withColumn("_last", F.when(waits, F.col("_last"))).unionByName(nothing)
    columns = [F.col(f"_last.{n}").alias(n) for n in (*kept, "fire_ms")]
    return shown.select(ID, "at_ms", F.col("_last").isNotNull().alias("found"), *columns)


def compact_per_topic(commands: DataFrame, now_ms: int, retention_ms: int = 3_600_000) -> DataFrame:
    """What the broker's log compaction leaves: the record with the highest offset per topic, partition
    and ID, without the deletes that are older than the retention time. Records without a key stay."""
    named = commands.where(F.col(ID).isNotNull())
    last = _first(named, [ID, *LANE], [F.col("offset").desc()])
    too_old = (F.col("command") == "delete") & (F.col("arrival_ms") < now_ms - retention_ms)
    return last.where(~too_old).unionByName(commands.where(F.col(ID).isNull()))


def compact_safe(commands: DataFrame, as_of_ms: int, gate_ms: int = 0) -> DataFrame:
    """Only the commands that still wait. Replaying them gives the same pending schedules, also where
    per-topic compaction would lose or revive one."""
    return pending_at(commands, as_of_ms, gate_ms).select(*commands.columns)
