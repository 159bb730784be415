"""Running sums over a whole table, without bringing its order together in one task.

A window without partitions would sort everything in a single task. Here the range of the ordering value
is cut at a bounded number of points; tasks sum up within their range and the sums of the ranges before
are added. The ordering value is a number. Cuts are plain values, so a range is a function of the row: a task that runs again, after an
executor is lost, gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from delayfold.operators.ordered import passed
from delayfold.session import written

_RANGES = 10_000


def running_sum(table: DataFrame, at: str, value: str, name: str, per_range: int = 1_000_000) -> DataFrame:
    """One row for each distinct non-null `at`: the sum of `value` there and, as `name`, of all up to it.

    Rows of one `at` are summed up before anything is shuffled, so one that holds most rows is one row. The
    table is read once; its sums are written to the work folder, as they are needed for the cuts too.
    `per_range` rows are sorted by one task; a table of more than ten thousand such ranges gets larger ones.
    """
    summed = table.where(F.col(at).isNotNull()).groupBy(at).agg(F.sum(value).alias(value))
    sums = written(summed, "sums")
    ranges = min(_RANGES, -(-sums.count() // per_range))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sums.agg(F.percentile_approx(at, shares, 10 * ranges)).first()[0] if shares else []
    # One literal, however many cuts.
    text = ",".join(map(str, sorted(set(cuts or []))))
    cut = (F.split(F.lit(text), ",") if text else F.array()).cast(f"array<{dict(sums.dtypes)[at]}>")
    placed = sums.withColumn("_cuts", cut).withColumn("_range", passed("_cuts", F.col(at))).drop("_cuts")
    carried, total = [], 0
    for row in placed.groupBy("_range").agg(F.sum(value).alias("_sum")).orderBy("_range").collect():
        carried.append((row["_range"], total))  # one row for each range
        total += row["_sum"] or 0
    kind = dict(placed.agg(F.sum(value).alias("_sum")).dtypes)["_sum"]
    before = sums.sparkSession.createDataFrame(carried, f"_range int, _carried {kind}")
    here = Window.partitionBy("_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_inside", F.sum(value).over(here))
        .join(F.broadcast(before), "_range")
        .select(at, value, (F.col("_inside") + F.col("_carried")).alias(name))
    )
