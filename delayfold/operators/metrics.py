"""Counters, audits and delivery lag as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from delayfold.functions import clock
from delayfold.operators.decode import effective
from delayfold.operators.lifecycle import as_of, lifecycle
from delayfold.operators.ordered import Ordered, Slicing, split
from delayfold.operators.running import running_sum


def event_counts(commands: DataFrame) -> DataFrame:
    """Decoded commands by type, source and kind of delete or error."""
    is_delete = F.col("command") == "delete"
    return (
        commands.groupBy(
            F.col("command").alias("message_type"),
            F.col("source_topic").alias("message_source"),
            F.when(
                is_delete, F.when(F.col("is_expired"), "expired").otherwise("canceled")
            ).alias("delete_type"),
            F.col("error.class").alias("error_type"),
            F.col("error.cause_class").alias("error_cause"),
        )
        .agg(F.count("*").alias("events"))
    )


def observed(commands: DataFrame, name: str = "commands") -> DataFrame:
    """The same commands; their counts by type show up in the progress of each batch of a stream."""
    is_delete = F.col("command") == "delete"
    return commands.observe(
        name,
        F.count_if(F.col("command") == "update").alias("update"),
        F.count_if(is_delete & ~F.col("is_expired")).alias("delete_canceled"),
        F.count_if(is_delete & F.col("is_expired")).alias("delete_expired"),
        F.count_if(F.col("error.class") == "decode").alias("error_decode"),
        F.count_if(F.col("error.class") == "transformation").alias("error_transformation"),
    )


def state_size(commands: DataFrame, as_of_ms: int, gate_ms: int = 0, **replay) -> DataFrame:
    """One row: schedules waiting now, and how often one was overwritten or removed on the way."""
    history = lifecycle(commands, as_of_ms, gate_ms, **replay)
    counted = {"active": "pending"} | {
        name: name for name in ("superseded", "canceled", "canceled_by_error", "completed", "fired")
    }
    return history.agg(
        *[F.count_if(F.col("outcome") == what).alias(name) for name, what in counted.items()]
    )


def active_over_time(history: DataFrame, per_range: int = 1_000_000) -> DataFrame:
    """How many schedules wait after each ms in which that number may change: at_ms, change, active.

    `history` is that of `lifecycle`. An update counts from the time it was seen to the time it was closed;
    what opens and closes in one ms leaves a row with a change of 0 there.
    """
    steps = F.array(
        F.struct(F.col("seen_ms").alias("at_ms"), F.lit(1).cast("bigint").alias("change")),
        F.struct(F.col("closed_ms").alias("at_ms"), F.lit(-1).cast("bigint").alias("change")),
    )
    changes = history.select(F.explode(steps).alias("_step")).select("_step.*")
    return running_sum(changes, "at_ms", "change", "active", per_range)


def lookup_hits(
    commands: DataFrame,
    as_of_ms: int,
    gate_ms: int = 0,
    rows: int | None = None,
    slicing: Slicing = Slicing(),
) -> DataFrame:
    """Each effective command looks its ID up once; a hit finds a schedule that still waits."""
    asked = []
    for part in split(effective(as_of(commands, as_of_ms)), rows, slicing):
        fire_ms = clock.fire_ms(F.col("seen_ms"), F.col("due_ms"), gate_ms)
        ordered = Ordered(part.rows.withColumn("fire_ms", fire_ms), part.cut)
        ordered = ordered.add_last_before("_last", F.struct("command", "fire_ms"))
        asked.append(ordered.done().select("command", "_last", "seen_ms"))
    hit = (F.col("_last.command") == "update") & (F.col("_last.fire_ms") >= F.col("seen_ms"))
    counted = reduce(DataFrame.unionByName, asked).groupBy("command")
    return counted.agg(F.count("*").alias("lookups"), F.count_if(hit).alias("hits")).withColumn(
        "misses", F.col("lookups") - F.col("hits")
    )


def command_audit(commands: DataFrame) -> DataFrame:
    """One line per decoded command. The lines."""
    key, source = F.coalesce("schedule_id", F.lit("")), F.col("source_topic")
    line = (
        F.when(
            F.col("command") == "update",
            F.concat(F.lit("Decoded UPDATE for ["), key, F.lit("] from "), source),
        )
        .when(
            F.col("command") == "delete",
            F.concat(
                F.lit("Decoded DELETE type=["),
                F.when(F.col("is_expired"), "expired").otherwise("canceled"),
                F.lit("] for ["),
                key,
                F.lit("] from "),
                source,
            ),
        )
        .otherwise(F.concat(F.lit("Error decoding ["), key, F.lit("] from "), source))
    )
    return commands.select(
        "schedule_id",
        "source_topic",
        "partition",
        "offset",
        "arrival_ms",
        F.when(F.col("command") == "error", "error").otherwise("info").alias("level"),
        line.alias("line"),
        F.col("error.message").alias("error_message"),
    )


def delivery_lag(fired: DataFrame, fired_ms: str = "fire_ms") -> DataFrame:
    """How late messages left, by target topic: fired minus the later of due and arrival.

    All numbers are exact. Messages are counted by lag before anything is shuffled; a percentile is the
    lag at which the running count reaches its rank, so a topic's rows are never sorted themselves.
    """
    arrival = "seen_ms" if "seen_ms" in fired.columns else "arrival_ms"
    lag = F.col(fired_ms) - F.greatest("due_ms", arrival)
    counts = fired.groupBy("target_topic", lag.alias("_lag")).agg(F.count("*").alias("_n"))
    topic = Window.partitionBy("target_topic")
    until_here = topic.orderBy("_lag").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns(
        {"_upto": F.sum("_n").over(until_here), "_all": F.sum("_n").over(topic)}
    )

    def percentile(share: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("_lag")))

    return ranked.groupBy("target_topic").agg(
        F.sum("_n").alias("messages"),
        F.coalesce(F.sum(F.when(F.col("_lag") <= 100, F.col("_n"))), F.lit(0)).alias("within_100_ms"),
        percentile(0.5).alias("p50_ms"),
        percentile(0.99).alias("p99_ms"),
        F.max("_lag").alias("max_ms"),
        F.sum(F.col("_lag") * F.col("_n")).alias("total_ms"),
    )
