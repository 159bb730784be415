"""Neighbours in the command order of each ID, also when one ID holds much of the log.

Within a partition the offset decides; record times, which producers set, may go backwards there. A
command counts as *seen* at the largest record time its ID has had in that partition so far, and
commands of an ID from several partitions are merged by that time.

A window over `schedule_id` alone would sort all commands of an ID in one task. IDs that hold more rows
than one task should sort are found in a sample of the log, whatever its size, and kept apart: their
rows are cut into slices, the windows run per slice, and what crosses a cut comes from tables with one
row per slice. All other IDs are shuffled once. No row is dropped; cuts only decide which task sorts it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from delayfold.model import LANE, POSITION

ID = "schedule_id"


@dataclass(frozen=True)
class Slicing:
    """How finely hot IDs are cut.

    least: an ID with fewer rows, or a slice of so many, is sorted by one task.
    slices: the most slices a log is cut into; bounds the tables that are broadcast. A log with more
        than least * slices rows gets larger slices.
    samples: sampled rows per slice.
    """

    least: int = 1_000_000
    slices: int = 100_000
    samples: int = 1_000

    def every(self, rows: int) -> int:
        """One in so many rows is sampled."""
        return max(1, max(self.least, -(-rows // self.slices)) // self.samples)


def position() -> Column:
    return F.struct(*POSITION)


_POWERS = [2**bit for bit in reversed(range(31))]


def passed(cuts: str, at: Column) -> Column:
    """How many of the sorted `cuts` are at or before `at`, found by halving steps, as many as it takes."""
    bits = F.length(F.bin(F.size(cuts)))
    steps = F.slice(F.array(*map(F.lit, _POWERS)), F.lit(len(_POWERS) + 1) - bits, bits)
    return F.aggregate(
        steps,
        F.lit(0),
        lambda passed, step: F.when(
            F.get(cuts, passed + step - 1) <= at, passed + step
        ).otherwise(passed),
    )


# Cuts are told apart by so many at a time.
_FAN = 256


def placed(
    rows: DataFrame, cuts: DataFrame, group: list[str], at: Column, name: str, expected: int
) -> DataFrame:
    """Adds as `name` how many of the cuts of its group a row is at or after; 0 in a group without cuts.

    The cuts (`_cuts`) are broadcast as a tree. On its way down a row meets short arrays, never all cuts of its
    group: its cost does not grow with their number. expected: about the most cuts of a group, which sets
    the height; with more of them only the array at the root is longer.
    """
    height = 0
    while 2 * _FAN ** (height + 1) < expected:  # a root of two blocks saves a level
        height += 1
    found = rows.withColumn("_block", F.lit(0))
    for level in reversed(range(height + 1)):
        # Every so many'th cut; those that a level above has told apart already are left out.
        step = _FAN**level
        here = cuts.where(F.col("_number") % step == 0)
        number, block = F.expr(f"cast(_number div {step} as int)"), F.lit(0)
        if level < height:
            here = here.where(number % _FAN != 0)
            block = F.expr(f"cast(_number div {step * _FAN} as int)")
        blocks = here.groupBy(*group, block.alias("_block")).agg(
            F.array_sort(F.collect_list("_cut")).alias("_cuts")
        )
        inside = F.when(F.col("_cuts").isNull(), 0).otherwise(passed("_cuts", at))
        found = (
            found.join(F.broadcast(blocks), [*group, "_block"], "left")
            .withColumn("_block", F.col("_block") * (_FAN if level < height else 1) + inside)
            .drop("_cuts")
        )
    return found.withColumnRenamed("_block", name)


class Ordered:
    """Commands with the slice of each row, ready for neighbour columns."""

    def __init__(self, rows: DataFrame, cut: bool):
        self.rows, self.cut = rows, cut
        self._window = Window.partitionBy(ID, "_slice").orderBy(*POSITION)

    def where(self, condition: Column) -> Ordered:
        """Leaves rows out; the others keep their slices, so no new shuffle is needed."""
        return Ordered(self.rows.where(condition), self.cut)

    def _fill(self, name: str, rows: DataFrame, edges: DataFrame) -> Ordered:
        # One row per slice, of which there are at most `slices` and one for each hot ID.
        filled = rows.join(F.broadcast(edges), [ID, "_slice"], "left").withColumn(
            name, F.coalesce(name, "_edge")
        )
        return Ordered(filled.drop("_edge"), self.cut)

    def add_next(self, name: str, value: Column) -> Ordered:
        """Adds `value` of the next command of the ID; null on the last one. `value` is never null."""
        rows = self.rows.withColumn(name, F.lead(value).over(self._window))
        if not self.cut:
            return Ordered(rows, False)
        first = self.rows.groupBy(ID, "_slice").agg(F.min_by(value, position()).alias("_edge"))
        across = Window.partitionBy(ID).orderBy("_slice")
        return self._fill(name, rows, first.withColumn("_edge", F.lead("_edge").over(across)))

    def add_last_before(self, name: str, value: Column) -> Ordered:
        """Adds the latest non-null `value` among the earlier commands of the ID."""
        before = Window.unboundedPreceding, -1
        rows = self.rows.withColumn(
            name, F.last(value, ignorenulls=True).over(self._window.rowsBetween(*before))
        )
        if not self.cut:
            return Ordered(rows, False)
        last = self.rows.groupBy(ID, "_slice").agg(
            F.max_by(value, F.when(value.isNotNull(), position())).alias("_edge")
        )
        across = Window.partitionBy(ID).orderBy("_slice").rowsBetween(*before)
        return self._fill(
            name, rows, last.withColumn("_edge", F.last("_edge", ignorenulls=True).over(across))
        )

    def done(self) -> DataFrame:
        return self.rows.drop("_slice")


def _cuts(sample: DataFrame, group: list[str], order: Column, samples: int) -> DataFrame:
    """Every so many'th sampled row of each group is a cut, `_cut` with its `_number` from 1."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return (
        sample.withColumn("_n", number)
        .where(F.col("_n") % samples == 0)
        .select(*group, order.alias("_cut"), F.expr(f"cast(_n div {samples} as int)").alias("_number"))
    )


def _seen(rows: DataFrame, part: Column) -> DataFrame:
    lane = Window.partitionBy(ID, *LANE, part).orderBy("offset")
    until_here = lane.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seen_ms", F.max("arrival_ms").over(until_here))


def with_seen(commands: DataFrame) -> DataFrame:
    """Adds `seen_ms`, with one shuffle by ID, which later windows over the ID use too."""
    return _seen(commands.repartition(ID), F.lit(0))


def split(commands: DataFrame, rows: int | None = None, slicing: Slicing = Slicing()) -> list[Ordered]:
    """The commands of ordinary IDs and, cut into slices, those of hot ones. Rows without an ID go.

    `rows` is the size of the log if known; else it is counted (a footer read on parquet).
    """
    rows = commands.count() if rows is None else rows
    every = slicing.every(rows)
    named = commands.where(F.col(ID).isNotNull())
    sample = named.select(ID, "arrival_ms", *LANE, "offset").where(
        F.pmod(F.xxhash64(*LANE, "offset"), F.lit(every)) == 0
    )
    # Any points of the order will do as cuts, so record times stand in for `seen_ms`.
    point = F.struct(F.col("arrival_ms").alias("seen_ms"), *LANE, "offset")
    cuts = _cuts(sample, [ID], point, slicing.samples)
    hot_ids = cuts.where(F.col("_number") == 1).select(ID)
    expected = rows // (every * slicing.samples) + 1
    cold = with_seen(named.join(F.broadcast(hot_ids), ID, "left_anti"))

    lane_cuts = _cuts(sample, [ID, *LANE], F.col("offset"), slicing.samples)
    hot = named.join(F.broadcast(hot_ids), ID, "left_semi")
    hot = placed(hot, lane_cuts, [ID, *LANE], F.col("offset"), "_part", expected)
    parts = hot.groupBy(ID, *LANE, "_part").agg(F.max("arrival_ms").alias("_most"))
    earlier = (
        Window.partitionBy(ID, *LANE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = parts.withColumn("_before", F.max("_most").over(earlier)).drop("_most")
    seen = (
        _seen(hot, F.col("_part"))
        .join(F.broadcast(before), [ID, *LANE, "_part"])
        .withColumn("seen_ms", F.greatest("seen_ms", "_before"))
        .drop("_part", "_before")
        .withColumn("_at", position())
    )
    seen = placed(seen, cuts, [ID], F.col("_at"), "_slice", expected).drop("_at")
    return [Ordered(cold.withColumn("_slice", F.lit(0)), False), Ordered(seen, True)]


def top_rows(table: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group. Two steps, so that no task ranks a whole large group."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = table.withColumn("_part", F.pmod(F.xxhash64("partition", "offset"), F.lit(parts)))
    for keys in ([*group, "_part"], group):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        spread = spread.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return spread.drop("_part").withColumnRenamed("_rank", "rank")
