"""Importance resampling towards a target: hashed n-gram features, log ratios, Gumbel noise.

A feature's bucket comes from its CRC. A task takes the distinct features of about a megabyte of text,
lays those of equal length out as the rows of one matrix of bytes and updates all their CRCs column by
column; then every occurrence gets its feature's bucket. Spark adds up the counts of the buckets, a table
of fixed size; a second pass sums the gains of each document, and the draw is a ranking over ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from delayfold.llm import arrays
from delayfold.llm.tables import stored

_CHUNK = 1 << 20
_WIDE = 1024  # bytes from which a feature is long enough to be worth a call of its own
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after lower-casing


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows at once, one column after the other."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes and the number of each row's own."""
    n, width = matrix.shape
    if width <= 8:
        padded = np.zeros((n, 8), np.uint8)
        padded[:, :width] = matrix
        keys = padded.view(np.uint64).ravel()
    else:
        keys = np.ascontiguousarray(matrix).view(np.dtype((np.void, width))).ravel()
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return matrix[first], which


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes."""
    result = np.zeros(len(starts), np.uint32)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        length = int(lengths[group[0]])
        if length >= _WIDE:
            result[group] = [zlib.crc32(data[a : a + length]) for a in starts[group]]
            continue
        distinct, which = _distinct(data[starts[group, None] + np.arange(length)])
        result[group] = crc_rows(distinct)[which]
    return result


def _features(chunk: arrays.Chunk, size: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words: buckets of its features in text order, and where each text's begin."""
    data = arrays.ascii_lower(chunk.data)
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.offsets] = True
    before, after = np.append(False, inside), np.append(inside, False)
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    first = np.searchsorted(starts, chunk.offsets)
    if size > 1:  # words back to back, one blank between
        lengths = ends - starts
        place = np.cumsum(lengths + 1) - lengths - 1
        spaced = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
        at = np.repeat(place - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        spaced[at] = data[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        data, starts, ends = spaced, place, place + lengths
    text = np.repeat(np.arange(len(chunk)), np.diff(first))
    for words in range(1, size + 1):
        last = np.arange(words - 1, len(starts))
        last = last[text[last] == text[last - words + 1]]
        numbers = checksums(data, starts[last - words + 1], ends[last]) % np.uint32(buckets)
        yield numbers.astype(np.int64), np.searchsorted(text[last], np.arange(len(chunk) + 1))


def _counted(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for chunk in arrays.text_chunks(batches, limit=_CHUNK):
            for numbers, _ in _features(chunk, size, buckets):
                total += np.bincount(numbers, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, size: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of all whole texts fall into each bucket that has any."""
    counted = texts.select("text").mapInArrow(_counted(size, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket, from the counts of both sides: 1000 times the log of the ratio of its
    shares, each count one too many, rounded down."""
    spark = source.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    s_all, t_all = (float(c.agg(F.sum("n")).first()[0] or 0) for c in (source, target))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    )
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weighted(size: int, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches, limit=_CHUNK):
            n, words, weight = (np.zeros(len(chunk), np.int64) for _ in range(3))
            for numbers, first in _features(chunk, size, len(gain)):
                total = np.concatenate([[0], np.cumsum(gain[numbers])])
                weight += total[first[1:]] - total[first[:-1]]
                n += np.diff(first)
                words = np.maximum(words, np.diff(first))  # there are as many runs of one word
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(n), pa.array(words), pa.array(weight)],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    return run


def _noise(seed: int) -> Column:
    """1000 times a standard Gumbel value that only depends on doc_id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296))).cast("long")


def _ranked(docs: DataFrame, percent: int) -> DataFrame:
    """A rank for the first `percent` of the drawable rows, by score, then doc_id.

    Rows are dealt by ranges of that order, so a row's rank is its place in its range after the sizes of
    the ranges before; one number for each range is all that is brought together.
    """
    spark = docs.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = docs.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # number of the range, then place in it
    placed = stored(
        dealt.withColumn("range", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)),
        "draw",
    )
    sizes = placed.groupBy("range").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("drawable"), True)).alias("drawable")
    ).orderBy("range").collect()
    before, done = [], 0
    for r in sizes:
        before.append((r["range"], done))
        done += r["n"]
    drawn = percent * sum(r["drawable"] for r in sizes) // 100
    offsets = spark.createDataFrame(before or [(0, 0)], "range long, before long")
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(offsets), "range").withColumn("rank", F.when(rank <= drawn, rank))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    size: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Both tables have a text. Words are runs of ASCII letters and digits and of all other characters beyond
    ASCII, A-Z lower-cased; features are runs of 1 to `size` words with a blank between, repeats counted.
    A document's weight sums its features' gains and its score adds noise fixed by `seed` and doc_id. Of
    the N documents with `least_words` words or more, floor(percent * N / 100) with the highest scores are
    drawn, ties to the smaller doc_id.

    A null or empty text has no features and weighs 0; so does every text if both tables are empty. Rows
    without doc_id share one noise and come last among equals; repeated rows count each, in a fixed but
    arbitrary order. Other columns are ignored, an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source, aim = (stored(bucket_counts(t, size, buckets), "buckets") for t in (texts, target))
    gain = np.zeros(buckets, np.int64)
    for row in gains(source, aim, buckets).collect():  # as many as there are buckets
        gain[row["bucket"]] = row["gain"]
    weighed = texts.mapInArrow(
        _weighted(size, gain), "doc_id long, n_features long, n_words long, weight long"
    )
    scored = stored(
        weighed.select(
            "doc_id", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("drawable"), F.monotonically_increasing_id().alias("row"),
        ),
        "scored",
    )
    return _ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")
