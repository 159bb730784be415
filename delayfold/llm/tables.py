"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from delayfold.llm import arrays
from delayfold.session import work_dir


# Bytes of an Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session cut Arrow batches by size, for good: ten thousand long texts are more than tasks
    should hold twice, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows once and reads them back, so that a lost executor costs no recomputation."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_starts(rows: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Numbers of the rows at which one of the key columns changes, 0 included."""
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for key in keys:
        column = rows.column(key)
        values = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(
            zero_copy_only=False
        )
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 4 << 20
) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `keys`: about `limit` bytes, or one larger group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, int(limit * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size < limit:
                continue
            rows = pa.Table.from_batches(held)
            last = int(run_starts(rows, keys)[-1])
            if last:
                yield rows.slice(0, last)
                rows = rows.slice(last)
                size = rows.nbytes
            held = rows.to_batches()
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    arrays.hand_back()


def each_group(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """One table for each group of rows sorted by `keys`."""
    for rows in whole_groups(batches, keys):
        rows = rows.combine_chunks()
        starts = run_starts(rows, keys)
        for start, end in zip(starts, np.append(starts[1:], rows.num_rows)):
            yield rows.slice(start, end - start)


def text_flag(judge: Callable[[arrays.Chunk], np.ndarray], column: str = "text") -> Column:
    """A condition on a text column. Only the texts travel to Python and only flags come back; the other
    columns of the rows stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = pa.record_batch([texts], ["text"])
            flags = [np.asarray(judge(chunk), bool) for chunk in arrays.text_chunks(iter([rows]))]
            yield pa.array(np.concatenate([*flags, np.zeros(0, bool)]))

    # The hints say how it is called; they are set here as the module's hints are text.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(F.col(column))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, written once, with `rank` from 0 in an order that leaves no ties.

    They are dealt by ranges of that order, so a row's rank is its place in its range after the sizes of
    the ranges before: one number for each range is all that is brought together.
    """
    spark = rows.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()  # number of the range, then place in it
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = stored(
        dealt.withColumn("range", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)),
        "ranked",
    )
    before, done = [], 0
    for r in placed.groupBy("range").count().orderBy("range").collect():
        before.append((r["range"], done))
        done += r["count"]
    offsets = spark.createDataFrame(before or [(0, 0)], "range long, before long")
    with_rank = placed.join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + F.col("place"))
    return with_rank.drop("range", "place", "before")
