"""Command logs kept in tables, and reads over parts of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from delayfold.model import RAW_LOG
from delayfold.operators.decode import decode_avro, decode_json
from delayfold.operators.ordered import top_rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A bounded log of raw records in parquet."""
    return spark.read.schema(RAW_LOG).parquet(path)


def follow_table(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as a stream: files that appear under `path` are new records, read in micro-batches of
    at most `max_files` files."""
    reader = spark.readStream.schema(RAW_LOG).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def merge(avro: DataFrame | None = None, json: DataFrame | None = None) -> DataFrame:
    """Both groups of raw records as one command table; a group without topics is left out."""
    decoded = []
    if avro is not None:
        decoded.append(decode_avro(avro))
    if json is not None:
        decoded.append(decode_json(json))
    if not decoded:
        raise ValueError("both Avro and JSON topics were empty")
    return reduce(DataFrame.unionByName, decoded)


def first_of_topic(log: DataFrame, n: int) -> DataFrame:
    """The first `n` records of each topic."""
    return top_rows(log, ["topic"], [F.col("offset"), F.col("partition")], n)


def last_of_partition(log: DataFrame, n: int) -> DataFrame:
    """The last `n` records of each partition."""
    return top_rows(log, ["topic", "partition"], [F.col("offset").desc()], n)
