"""Hard-negative mining with exact scores by the method of Four Russians.

Components are whole numbers. A row is kept as bit planes: bit b of all its components, eight components
a byte, in two's complement. For each anchor and each group of eight components a table holds the sum of
the anchor's components over all 256 subsets; a row's byte of plane b picks the sum over the components
that have bit b. So a score is read from the tables plane by plane, highest first: double what there is,
add what the bytes pick; the highest plane counts negatively. No product is ever formed.

Rows are dealt to blocks and anchors to blocks, and a task scores one against the other. Positives come
from blocks of one label, negatives from blocks of all rows, so no pair is scored twice for either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from delayfold.llm.tables import stored

_ANCHORS = 128  # scored together: their tables should stay in a processor's cache
_ROWS = 1024
_LONGS = np.iinfo(np.int64)


# ---------------------------------------------------------------- planes and tables


def to_planes(whole: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes of rows of whole numbers, as (row, plane, group); planes from the highest down."""
    low, high = int(whole.min(initial=0)), int(whole.max(initial=0))
    bits = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    n, width = whole.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.int64)
    padded[:, :width] = whole
    planes = [
        np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits - 1, -1, -1)
    ]
    return np.stack(planes, axis=1), bits


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = planes.shape[1]
    whole = np.zeros((len(planes), planes.shape[2] * 8), np.int64)
    for plane in range(bits):
        ones = np.unpackbits(planes[:, plane], axis=1, bitorder="little").astype(np.int64)
        whole = 2 * whole + (ones if plane else -ones)
    return whole


def same_shape(raw: list[bytes], bits: list[int], planes: int = 1, groups: int = 0) -> np.ndarray:
    """Planes of several rows brought to one form: the sign goes on in higher planes, components end in 0."""
    groups = max([groups] + [len(r) // b for r, b in zip(raw, bits)])
    planes = max([planes, *bits])
    if raw and all(b == planes and len(r) == planes * groups for r, b in zip(raw, bits)):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), planes, groups)
    out = np.zeros((len(raw), planes, groups), np.uint8)
    for i, (r, b) in enumerate(zip(raw, bits)):
        own = np.frombuffer(r, np.uint8).reshape(b, -1)
        out[i, planes - b :, : own.shape[1]] = own
        out[i, : planes - b, : own.shape[1]] = own[:1]
    return out


def subset_sums(anchors: np.ndarray, bits: int) -> np.ndarray:
    """(group, subset, anchor): sums of each group's components over every subset.

    The type holds every score of rows with so many planes; beyond 64 bits these are Python's integers.
    """
    reach = max((sum(abs(x) for x in row) for row in anchors.tolist()), default=0) << bits
    kind = np.int32 if reach < 1 << 31 else np.int64 if reach < 1 << 56 else object
    grouped = anchors.reshape(len(anchors), anchors.shape[1] // 8, 8).astype(kind)
    sums = np.zeros((grouped.shape[1], 256, len(anchors)), kind)
    for i in range(8):
        sums[:, 1 << i : 2 << i] = sums[:, : 1 << i] + grouped[:, :, i].T[:, None, :]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(row, anchor): inner products, shifted and added from the tables."""
    total = np.zeros((len(planes), sums.shape[2]), sums.dtype)
    for plane in range(planes.shape[1]):
        total += total
        for group in range(planes.shape[2]):
            picked = sums[group].take(planes[:, plane, group], axis=0)
            if plane:
                total += picked
            else:
                total -= picked
    return total if sums.dtype == object else total.astype(np.int64)


# ---------------------------------------------------------------- tasks


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            by_width: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            rows = zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"))
            for vec_id, label, vector in rows:
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
                if np.isfinite(x).all():
                    whole = np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype(np.int64)
                    by_width.setdefault(len(x), []).append((vec_id, label, whole))
            for found in by_width.values():
                planes, bits = to_planes(np.stack([f[2] for f in found]))
                columns[0] += [f[0] for f in found]
                columns[1] += [f[1] for f in found]
                columns[2] += [bits] * len(found)
                columns[3] += [p.tobytes() for p in planes]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)], ["vec_id", "label", "bits", "planes"]
            )

    return run


class _Block:
    """Rows in ascending order of vec_id, ready to be scored against anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        raw, bits = anchors.column("planes").to_pylist(), anchors.column("bits").to_pylist()
        mine = same_shape(rows.column("planes").to_pylist(), rows.column("bits").to_pylist())
        self._asked = same_shape(raw, bits, groups=mine.shape[2])
        self._planes = np.zeros((*mine.shape[:2], self._asked.shape[2]), np.uint8)
        self._planes[:, :, : mine.shape[2]] = mine
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))

    def scored(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and scores of each anchor."""
        for at in range(0, len(self._asked), _ANCHORS):
            sums = subset_sums(from_planes(self._asked[at : at + _ANCHORS]), self._planes.shape[1])
            parts = [scores(self._planes[i : i + _ROWS], sums) for i in range(0, len(self._planes), _ROWS)]
            whole = np.concatenate(parts)
            if whole.dtype == object:
                whole = np.minimum(np.maximum(whole, _LONGS.min), _LONGS.max)
            for i in range(whole.shape[1]):
                yield at + i, whole[:, i]


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, earlier ones first among equals."""
    if len(score) > k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.argsort(-score[near], kind="stable")[:k]]


def _nearest(k: int):
    """The first k rows of a block of one label for each anchor of that label."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            block = _Block(rows, anchors)
            own, number = anchors.column("vec_id").to_pylist(), anchors.column("row").to_pylist()
            for i, score in block.scored():
                others = np.flatnonzero(block.ids != own[i])
                top = others[_first(score[others], k)]
                found[0] += [number[i]] * len(top)
                found[1] += block.ids[top].tolist()
                found[2] += score[top].tolist()
        columns = [pa.array(c, pa.int64()) for c in found]
        return pa.table(dict(zip(("row", "vec_id", "score"), columns)))

    return run


def _between(k: int, low: int, high: int):
    """The first k rows of other labels in a block whose scores lie in the range of each positive."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            block = _Block(rows, anchors)
            own, number, label, wanted = (
                anchors.column(c).to_pylist() for c in ("vec_id", "row", "label", "positives")
            )
            for i, score in block.scored():
                others = np.flatnonzero((block.labels != label[i]) & (block.ids != own[i]))
                if score.dtype != object and max([abs(p) for p in wanted[i]], default=0) >= 1 << 56:
                    score = score.astype(object)
                part = 100 * score[others]
                for place, positive in enumerate(wanted[i]):
                    inside = others[(part >= low * positive) & (part <= high * positive)]
                    top = inside[_first(score[inside], k)]
                    found[0] += [number[i]] * len(top)
                    found[1] += [place] * len(top)
                    found[2] += block.ids[top].tolist()
                    found[3] += score[top].tolist()
        columns = [pa.array(c, pa.int64()) for c in found]
        return pa.table(dict(zip(("row", "place", "vec_id", "score"), columns)))

    return run


# ---------------------------------------------------------------- the job


def _numbers(until: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(until, 1) - 1).cast("long")))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row.

    `vectors` has vec_id, label and embedding, `is_anchor` is a condition on vec_id. A component x counts
    as floor(scale * x), a score is the inner product of two rows. An anchor's positives are its first
    `positives` other rows of its label, by score, then vec_id; fewer are taken whole. For each, the first
    `negatives` rows of other labels follow whose score, times 100, lies between `low` and `high` times
    the positive's score; a positive without any has no rows.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. A shorter
    vector counts as ending in zeros. Rows that share an anchor's vec_id are never its positives or
    negatives; of several anchor rows with one vec_id each is mined for itself, and anchor_row tells them
    apart. Other columns are ignored, an empty table gives no rows. Components count as at most 2**62,
    scores beyond 64 bits as the largest or smallest long.

    Every anchor is scored against every row, which grows with the square of a table whose anchors are a
    share of it; rows and anchors are repeated for each block of the other side.
    """
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    packed = whole.mapInArrow(_packed(scale), "vec_id long, label long, bits int, planes binary")
    # A number for each row, the same for all that follows, as it is written once.
    rows = stored(packed.withColumn("row", F.monotonically_increasing_id()), "planes")
    # Columns of their own, so that both sides of a pairing can be told apart.
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns])
    sizes = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.count(F.when(is_anchor, True)).alias("asked")
    ).agg(F.max("n"), F.sum("n"), F.max("asked"), F.sum("asked")).first()
    in_label, in_all, asked_in_label, asked_in_all = (-(-(n or 0) // block) for n in sizes)

    def dealt(table: DataFrame, blocks: int, other_blocks: int, mine: str, other: str) -> DataFrame:
        """Each row in one block of its side, once for each block of the other side."""
        of_row = F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)).cast("long"))
        return table.withColumn(mine, of_row).withColumn(other, _numbers(other_blocks))

    keys = ["label", "block", "asked"]
    near = (
        dealt(rows, in_label, asked_in_label, "block", "asked")
        .groupBy(*keys)
        .cogroup(dealt(anchors, asked_in_label, in_label, "asked", "block").groupBy(*keys))
        .applyInArrow(_nearest(positives), "row long, vec_id long, score long")
    )
    first = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("place", (F.row_number().over(first) - 1).cast("long")).where(F.col("place") < positives)
    best = stored(best, "positives")

    listed = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("best"))
    asked = anchors.join(listed, "row").withColumn("positives", F.col("best.score")).drop("best")
    keys = ["block", "asked"]
    found = (
        dealt(rows, in_all, asked_in_all, "block", "asked")
        .groupBy(*keys)
        .cogroup(dealt(asked, asked_in_all, in_all, "asked", "block").groupBy(*keys))
        .applyInArrow(_between(negatives, low, high), "row long, place long, vec_id long, score long")
    )
    first = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    chosen = best.select(
        "row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(names, "row")
    return ranked.join(chosen, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), F.col("row").alias("anchor_row"),
    )
