"""Connected components of an undirected graph.

Tasks first contract what they hold, `LOCAL` links at a time, to links from each node to the smallest
it is connected with there. One task's worth of links is then done. More go on by alternating stars:
each round points the neighbours of every node at its smallest neighbour, and a logarithmic number of
rounds is enough in practice. Rounds shuffle links by node, aggregate before the shuffle, and end in a
written table, so neither a hot node nor a lost executor holds up the job. The driver sees only a count
and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from delayfold.llm.tables import stored

LOCAL = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a - b, and the smallest node each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        now = now[now]
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        nodes, roots = least_reachable(links.column("a").to_numpy(), links.column("b").to_numpy())
        moved = nodes != roots
        return pa.record_batch([pa.array(nodes[moved]), pa.array(roots[moved])], ["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= 2 * LOCAL:
            yield told(held)
            held, count = [], 0
    if count:
        yield told(held)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    `edges` has two long columns. Null ends and loops link nothing; repeated links count once.
    """
    a, b = edges.columns
    start = (
        edges.where(f"`{a}` != `{b}`")
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    start = stored(start, "links")
    tasks = -(-start.count() // LOCAL)
    now = stored(start.repartition(max(1, tasks)).mapInArrow(_contract, "a long, b long"), "links")
    state = _checksum(now) if tasks > 1 else None
    while state is not None:
        now = stored(_small_star(_large_star(now)), "links")
        after = _checksum(now)
        state = None if after == state else after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
