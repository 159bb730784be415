"""Exact top-k inner products by buckets of vector length.

Vectors are grouped by length, each bucket a tenth longer than the one before, and dealt to blocks.
The longest vectors give every query a first k-th score to beat. A query visits a bucket only if its
length times the bucket's largest reaches that score. Inside, the local threshold (the cosine that a
vector of the bucket would need) decides how the bucket is pruned: by the query's largest coordinate
where the threshold is high, by length where it is low. What is left is verified with exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from delayfold.llm.tables import stored

_RATIO = 1.1
_SEEDS = 2048
_HIGH = 0.5  # local cosine threshold from which coordinates prune better than lengths
_LONGS = np.iinfo(np.int64)


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, lengths, vectors = batch.column("vec_id").to_pylist(), [], [], []
            for vec_id, vector in zip(ids, batch.column("embedding")):
                if vec_id is None or not vector.is_valid:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
                if not np.isfinite(x).all():
                    continue
                whole = np.clip(np.floor(x * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                rows.append(vec_id)
                lengths.append(float(np.linalg.norm(whole.astype(np.float64))))
                vectors.append(whole.tobytes())
            length = np.array(lengths, np.float64)
            bucket = np.floor(np.log(np.maximum(length, 0.5)) / np.log(_RATIO)).astype(np.int64)
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(length), pa.array(bucket), pa.array(vectors, pa.binary())],
                ["vec_id", "length", "bucket", "vector"],
            )

    return run


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of 64-bit integers; shorter vectors end in zeros."""
    rows = [np.frombuffer(v, np.int64) for v in column.to_pylist()]
    width = max([len(r) for r in rows] + [width or 0])
    if all(len(r) == width for r in rows) and rows:
        return np.stack(rows)
    matrix = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    return matrix


def _products(matrix: np.ndarray, query: np.ndarray, exact_float: bool) -> np.ndarray:
    """Inner products as integers; doubles are exact while no sum can reach 2**53."""
    if exact_float:
        return (matrix.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    sums = (matrix.astype(object) * query.astype(object)).sum(axis=1)
    return np.array([min(max(int(s), _LONGS.min), _LONGS.max) for s in sums], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    return float(a.max(initial=0)) * float(b.max(initial=0)) < 2.0**52


def _first_scores(seeds: pa.Table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = seeds.column("vec_id").to_numpy(), seeds.column("length").to_numpy()
        matrix = _matrix(seeds.column("vector"))
        for batch in batches:
            to_beat = []
            queries = _matrix(batch.column("vector"), matrix.shape[1])
            known = np.pad(matrix, ((0, 0), (0, queries.shape[1] - matrix.shape[1])))
            exact = _fits(lengths, batch.column("length").to_numpy())
            for vec_id, query in zip(batch.column("vec_id").to_pylist(), queries):
                scores = np.sort(_products(known[ids != vec_id], query, exact))
                to_beat.append(int(scores[-k]) if len(scores) >= k else None)
            yield pa.record_batch(
                [*batch.columns, pa.array(to_beat, pa.int64())], [*batch.schema.names, "to_beat"]
            )

    return run


def _search(k: int):
    """Best of one block of vectors for the queries that visit it."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids = candidates.column("vec_id").to_numpy()
        lengths = candidates.column("length").to_numpy()
        query_lengths = queries.column("length").to_numpy()
        asked = _matrix(queries.column("vector"))
        matrix = _matrix(candidates.column("vector"), asked.shape[1])
        asked = np.pad(asked, ((0, 0), (0, matrix.shape[1] - asked.shape[1])))
        unit = matrix / np.maximum(lengths, 1e-300)[:, None]
        exact = _fits(lengths, query_lengths)
        found = []
        own, number = queries.column("vec_id").to_pylist(), queries.column("row").to_pylist()
        to_beats = queries.column("to_beat").to_pylist()
        for row, query_id, query, length, to_beat in zip(number, own, asked, query_lengths, to_beats):
            keep = ids != query_id
            if to_beat is not None and length > 0:
                slack = 1e-9 * length * lengths.max(initial=0) + 1e-9
                local = (to_beat - slack) / (length * lengths.max(initial=0)) if lengths.any() else -1.0
                if local > _HIGH:
                    focus = int(np.abs(query).argmax())
                    a, b = query[focus] / length, unit[:, focus]
                    most = a * b + np.sqrt(np.maximum(0, 1 - a * a) * np.maximum(0, 1 - b * b))
                    keep &= length * lengths * (most + 1e-9) >= to_beat - slack
                else:
                    keep &= length * lengths >= to_beat - slack
            some = np.flatnonzero(keep)
            scores = _products(matrix[some], query, exact)
            top = _best(ids[some], scores, k)
            found.append((np.full(len(top), row), np.full(len(top), query_id), ids[some][top], scores[top]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), columns)))

    return run


def top_products(
    vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query with all other rows.

    `vectors` has vec_id and embedding; `is_query` is a condition on vec_id. A component x counts as
    floor(scale * x). Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without vec_id. A shorter vector counts as ending in zeros. Ties go to the smaller vec_id; rows
    with the query's vec_id are its own; of several query rows with one vec_id each is asked for itself. Fewer than k rows are returned whole. Products beyond 64 bits
    count as the largest or smallest long.
    """
    spark = vectors.sparkSession
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _integers(scale), "vec_id long, length double, bucket long, vector binary"
    )
    # A number for each row, the same for all that follows, as it is written once.
    whole = stored(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    seeds = whole.orderBy(F.desc("length"), "vec_id").limit(_SEEDS).toArrow()
    queries = whole.where(is_query).mapInArrow(
        _first_scores(seeds, k), "vec_id long, length double, bucket long, vector binary, row long, to_beat long"
    )
    # One row for each bucket: a few hundred at most, whatever the number of vectors.
    sizes = whole.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    buckets = sizes.select("bucket", "longest", F.ceil(F.col("n") / block).alias("blocks"))
    n_queries = whole.where(is_query).count()
    query_blocks = F.lit(max(1, -(-n_queries // block))).cast("long")

    hashed = F.xxhash64("row")
    every_query_block = F.explode(F.sequence(F.lit(0).cast("long"), query_blocks - 1))
    dealt = (
        whole.join(F.broadcast(buckets.select("bucket", "blocks")), "bucket")
        .withColumn("block", F.pmod(hashed, "blocks"))
        .select("bucket", "block", every_query_block.alias("query_block"), "vec_id", "length", "vector")
    )
    reach = F.col("to_beat").isNull() | (
        F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("to_beat")
    )
    places = buckets.collect()
    if not places:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kinds = dict(buckets.dtypes)
    table = F.array(
        *[F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in p.asDict().items()]) for p in places]
    )
    visits = (
        queries.drop("bucket")
        .withColumn("query_block", F.pmod(F.xxhash64("row"), query_blocks))
        .withColumn("place", F.explode(table))
        .select("query_block", "row", "vec_id", "length", "vector", "to_beat", "place.*")
        .where(reach)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", "block", "query_block", "row", "vec_id", "length", "vector", "to_beat")
    )
    keys = ["bucket", "block", "query_block"]
    local = (
        dealt.groupBy(*keys)
        .cogroup(visits.groupBy(*keys))
        .applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
