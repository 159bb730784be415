"""One firing query that also tells what it read and did: several tables from one pass over the log.

The rows of a micro-batch are tagged. Every command goes through as it was read, on the lanes that fired
schedules take, apart from the keyed state; the state adds what fired and what was closed. A micro-batch's
rows are kept while its tables are written, each under a folder named by the batch, which is replaced when
the batch runs again. So a stop between a write and its commit leaves no row twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from delayfold.model import COMMANDS, ERROR
from delayfold.operators.decode import errors_only
from delayfold.operators.lifecycle import STEPS, cancel_steps, update_steps
from delayfold.operators.metrics import command_audit, event_counts
from delayfold.operators.publish import fire_rows
from delayfold.session import prepare
from delayfold.streaming.resolve import PACKED, READ, resolve_and_tell
from delayfold.streaming.run import ORIGIN, trigger
from delayfold.streaming.timers import FIRED, PENDING, PendingSchedules, keyed

COMMAND, FIRED_KIND, CLOSED = "command", "fired", "closed"

# What the state hands on: a command, or a schedule with what became of it.
TAGGED = T.StructType(
    [T.StructField("kind", T.StringType()), *FIRED.fields]
    + [
        T.StructField("command", T.StringType()),
        T.StructField("is_expired", T.BooleanType()),
        T.StructField("error", ERROR),
        T.StructField("outcome", T.StringType()),
        T.StructField("closed_ms", T.LongType()),
    ]
)
_EMPTY = dict.fromkeys([*TAGGED.fieldNames(), PACKED])
_CLOSED_BY = {"update": "superseded", "delete": "canceled", "error": "canceled_by_error"}

TABLES = ("outbox", "errors", "commands", "steps", "counts")


def tagged_rows(resolved: pa.RecordBatch, now: int) -> pa.Table:
    """What was read, fired and closed within a micro-batch, as `TAGGED`."""
    told = resolved.column("told")
    fired, read = pc.is_null(told), pc.fill_null(pc.equal(told, READ), False)
    closed = pc.invert(pc.or_(fired, read))
    outcome = pa.array([_CLOSED_BY.get(t) for t in told.to_pylist()], pa.string())
    kind = pc.if_else(fired, FIRED_KIND, pc.if_else(read, COMMAND, CLOSED))
    only = {"command": read, "is_expired": read, "error": read, "closed_ms": closed}
    columns = {n: resolved.column(n) for n in resolved.schema.names if n in TAGGED.fieldNames()}
    for name, where in only.items():
        column = columns[name]
        columns[name] = pc.if_else(where, column, pa.nulls(len(column), column.type))
    columns |= {"kind": kind, "outcome": outcome}
    columns["fired_ms"] = pc.if_else(fired, pa.scalar(now, pa.int64()), pa.scalar(None, pa.int64()))
    return pa.table({n: columns[n] for n in TAGGED.fieldNames()})


class TellingSchedules(PendingSchedules):
    """The same state; its rows are tagged, and a schedule that is closed says so."""

    output = TAGGED

    def _tagged(self, kind: str, row: Row, **more) -> Row:
        known = {n: row[n] for n in PENDING.fieldNames()}
        return Row(**{**_EMPTY, **known, "kind": kind, **more})

    def _fired(self, schedule: Row, now: int) -> Row:
        return self._tagged(FIRED_KIND, schedule, fired_ms=now)

    def _closed(self, schedule: Row, by: Row) -> Iterator[Row]:
        outcome = _CLOSED_BY[by["closed_by"]]
        yield self._tagged(CLOSED, schedule, outcome=outcome, closed_ms=by["seen_ms"])


def told_stream(commands: DataFrame, waiting: DataFrame | None = None, held: bool = False) -> DataFrame:
    """Stream of commands to stream of tagged rows; see `fire_stream` for `waiting` and `held`.

    All commands take part: those without an ID and the reports of fired schedules are only told. Rows
    without an ID are dealt evenly.
    """
    tagged = keyed(resolve_and_tell(commands, tagged_rows, held), TellingSchedules(held), waiting)
    return tagged.withColumn("out_headers", F.map_from_entries("out_headers"))


def tables_of(tagged: DataFrame) -> dict[str, DataFrame]:
    """The tables that tagged rows hold: outgoing records, errors, a line for each command, the steps of
    schedules with their lines, and counts of the commands."""
    told = tagged.where(F.col("kind") == COMMAND)
    read = told.withColumn("metadata", F.lit(None).cast(COMMANDS["metadata"].dataType))
    read = read.select(*COMMANDS.fieldNames(), "seen_ms")
    fired = tagged.where(F.col("kind") == FIRED_KIND)
    ends = tagged.where(F.col("kind") != COMMAND).withColumns(
        {
            "outcome": F.coalesce("outcome", F.lit("fired")),
            "closed_ms": F.coalesce("closed_ms", "fire_ms"),
        }
    )
    opened = read.where(F.col("command") == "update").withColumns(
        {"outcome": F.lit(None).cast("string"), "closed_ms": F.lit(None).cast("bigint")}
    )
    steps = [update_steps(opened, scheduled=True), update_steps(ends, scheduled=False), cancel_steps(read)]
    return {
        "outbox": fire_rows(fired, keep=ORIGIN),
        "errors": errors_only(read),
        "commands": command_audit(read),
        "steps": reduce(DataFrame.unionByName, [s.select(*STEPS) for s in steps]),
        "counts": event_counts(read),
    }


def write_tables(path: str):
    """Writes the tables of one micro-batch. Running a batch again replaces what it wrote before."""

    def write(tagged: DataFrame, batch_id: int) -> None:
        tagged = tagged.persist()
        try:
            # Counting runs every partition of the state once, also in a batch without rows.
            if not tagged.count():
                return
            for name, table in tables_of(tagged).items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            tagged.unpersist()

    return write


def start_tables(
    told: DataFrame, path: str, checkpoint: str, every: str = "1 second", until_now: bool = False
) -> StreamingQuery:
    """Starts the query on tables under `path`, one for each of `TABLES`."""
    prepare(told.sparkSession)
    return (
        told.writeStream.foreachBatch(write_tables(path))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every, until_now))
        .start()
    )


def read_told(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the `TABLES`, with the batch_id of each row; counts are summed up over the batches."""
    table = spark.read.parquet(f"{path}/{name}")
    if name != "counts":
        return table
    keys = [c for c in table.columns if c not in ("events", "batch_id")]
    return table.groupBy(*keys).agg(F.sum("events").alias("events"))
