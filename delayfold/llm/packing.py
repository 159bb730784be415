"""Best-fit packing of documents into sequences of several permitted lengths.

What is planned with is not rows but how many there are of each length, so one plan covers the table,
however many rows it has and however they are dealt to tasks. Lengths go from long to short; each goes
where the least room is left that is enough. If there is none, a bin is opened, of the size that costs
least for each token it can still hope to hold. Bins that look alike are handled together: a step of the
plan says that so many items of one length go, so many to a bin, into bins with consecutive numbers. All
this is tried with every permitted length as the longest one opened; the cheapest plan counts. In the end
every bin shrinks to the shortest permitted length that holds its contents.

The plan is the one that best fit makes item by item. Its steps are bounded by the lengths and rooms there
can be, not by rows. A row finds its step by its rank among all rows, from long to short.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from delayfold.llm import token_files
from delayfold.llm.tables import ranked, stored

CAPACITIES = (1024, 2048, 4096, 8192)


def training_cost(capacity: int) -> float:
    """Steps for each token, attention over the sequence, and a fixed part for each sequence."""
    return 64 + capacity + capacity * capacity / 32768


def _shrunk(content: int, capacities: Sequence[int], cost: Callable[[int], float]) -> int:
    return min((c for c in capacities if c >= content), key=lambda c: (cost(c), c))


@dataclass
class Plan:
    """Steps in the order of falling lengths, as columns.

    first: items before the step, in falling order. low: number of its first bin. each: items to a bin.
    fill: contents of its bins before. length: of its items. Bins from `ends[i - 1]` to `ends[i]` have
    `contents[i]` and `capacities[i]`.
    """

    first: np.ndarray
    low: np.ndarray
    each: np.ndarray
    fill: np.ndarray
    length: np.ndarray
    ends: np.ndarray
    contents: np.ndarray
    capacities: np.ndarray
    cost: float

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset and capacity of items by their rank in falling order."""
        step = np.searchsorted(self.first, rank, side="right") - 1
        number = rank - self.first[step]
        each = self.each[step]
        bins = self.low[step] + number // each
        offset = self.fill[step] + number % each * self.length[step]
        return bins, offset, self.capacities[np.searchsorted(self.ends, bins, side="right")]


class _Bins:
    """Open bins by the room they have left, alike ones together as (first number, how many, contents)."""

    def __init__(self):
        self._mask, self._with_room = 0, {}
        self.full: list[tuple[int, int, int]] = []
        self.opened = 0

    def add(self, room: int, low: int, n: int, content: int) -> None:
        if not room:
            self.full.append((low, n, content))
            return
        heapq.heappush(self._with_room.setdefault(room, []), (content, low, n))
        self._mask |= 1 << room

    def take(self, length: int) -> tuple[int, int, int, int] | None:
        """Room, first number, how many and contents of the bins with the least room that is enough; of
        bins of several sizes with the same room, the emptiest."""
        fitting = self._mask >> length
        if not fitting:
            return None
        room = length + (fitting & -fitting).bit_length() - 1
        bins = self._with_room[room]
        content, low, n = heapq.heappop(bins)
        if not bins:
            self._mask ^= 1 << room
        return room, low, n, content

    def all(self) -> list[tuple[int, int, int]]:
        partly = [(low, n, content) for bins in self._with_room.values() for content, low, n in bins]
        return sorted(self.full + partly)


def _plan(
    counts: Sequence[tuple[int, int]], capacities: Sequence[int], cost: Callable[[int], float]
) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Steps and bins for falling (length, number of items)."""
    bins, steps, before = _Bins(), [], 0
    left, largest = sum(length * n for length, n in counts), max(capacities)
    for length, n in counts:
        if not length:  # takes no room: all in one bin, the first one if there is any
            found = bins.all()
            if found:
                low, _, content = found[0]
            else:
                low, content = 0, 0
                bins.add(min(capacities, key=lambda c: (cost(c), c)), 0, 1, 0)
            steps.append((before, low, n, content, 0))
            before += n
            continue
        while n:
            taken = bins.take(length)
            if taken is None:
                enough = [c for c in capacities if c >= length]
                room = min(enough, key=lambda c: (cost(c) / max(1, min(c, left)), c))
                # Towards the end what is left decides on the size, so bins are opened one by one.
                many = max(1, min(n // (room // length), (left - largest) // (room // length * length)))
                taken = (room, bins.opened, many, 0)
                bins.opened += many
            room, low, many, content = taken
            each = room // length
            used = min(many, n // each)
            if used:
                steps.append((before, low, each, content, length))
                bins.add(room - each * length, low, used, content + each * length)
                items = used * each
            else:
                used, items = 1, n
                steps.append((before, low, n, content, length))
                bins.add(room - n * length, low, 1, content + n * length)
            if many > used:
                bins.add(room, low + used, many - used, content)
            before, n, left = before + items, n - items, left - items * length
    return steps, bins.all()


def best_plan(
    counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = training_cost
) -> Plan:
    """The cheapest plan for so many items of each length, up to max(capacities).

    Items of length 0 take no room but have a bin.
    """
    falling = sorted(((length, n) for length, n in counts.items() if n), reverse=True)
    best = None
    for longest in sorted(capacities, reverse=True):
        # Only items that need a longer bin open one.
        steps, bins = _plan(falling, capacities, lambda c: cost(c) if c <= longest else 1e12 + cost(c))
        sizes = [_shrunk(content, capacities, cost) for _, _, content in bins]
        total = sum(n * cost(size) for (_, n, _), size in zip(bins, sizes))
        if best is None or total < best[0]:
            best = (total, steps, bins, sizes)
    total, steps, bins, sizes = best
    columns = [np.array(c, np.int64) for c in zip(*steps)] or [np.zeros(0, np.int64)] * 5
    ends = np.array([low + n for low, n, _ in bins], np.int64)
    contents = np.array([content for _, _, content in bins], np.int64)
    return Plan(*columns, ends, contents, np.array(sizes, np.int64), total)


def _placed(plan: Plan, largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            full = total // largest
            has_rest = batch.column("rest").to_numpy() >= 0
            # Whole stretches of the largest length are sequences of their own.
            n = full + has_rest
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            is_rest = piece == full[row]
            pack, number, offset = rank[row] + 1, piece.copy(), np.zeros(len(row), np.int64)
            length, capacity = np.full(len(row), largest), np.full(len(row), largest)
            pack[is_rest] = 0
            length[is_rest] = (total - full * largest)[row[is_rest]]
            if is_rest.any():
                number[is_rest], offset[is_rest], capacity[is_rest] = plan.place(rank[row[is_rest]])
            columns = [piece, piece * largest, length, pack, number, offset, capacity]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, columns)],
                ["doc_id", "piece", "start", "length", "pack", "bin", "bin_offset", "capacity"],
            )

    return run


def packed(
    docs: DataFrame,
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = training_cost,
) -> DataFrame:
    """Where every stretch of every row goes: doc_id, piece, start, length, pack, bin, bin_offset, capacity.

    (pack, bin) names a sequence; all that is packed with others has pack 0. `length` is a document's number
    of tokens, by default its UTF-8 bytes and one end mark; null counts as 0. A document longer than the
    largest capacity is cut into stretches of that capacity, each a sequence, and a rest that is packed. An
    empty document has one stretch of length 0. Rows that repeat are packed each; ties go by doc_id. An
    empty table gives no rows, other columns are ignored.

    Lengths are written once, ranked over ranges and counted: the driver sees one number for each length.
    """
    if length is None:
        length = F.octet_length("text") + 1
    largest = max(capacities)
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    rest = F.when((F.col("length") == 0) | (F.col("length") % largest > 0), F.col("length") % largest).otherwise(-1)
    rows = stored(tokens.withColumn("row", F.monotonically_increasing_id()).withColumn("rest", rest), "lengths")
    counts = rows.where("rest >= 0").groupBy("rest").count().collect()
    plan = best_plan({r["rest"]: r["count"] for r in counts}, tuple(sorted(capacities)), cost)
    falling = ranked(rows, [F.desc("rest"), F.asc_nulls_first("doc_id"), F.asc("row")])
    return falling.mapInArrow(
        _placed(plan, largest),
        "doc_id long, piece long, start long, length long, pack long, bin long, bin_offset long, capacity long",
    )


def packed_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`packed` by the ids that `token_files` gives each text, the end included; a null text has none."""
    return packed(token_files.token_counts(docs, vocabulary), F.col("n_tokens"))
