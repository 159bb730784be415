"""Byte strings that occur in more than one place of a corpus, found by suffix order.

1. Every window of `length` bytes has one *anchor*, the least hash of the k-grams inside it. Windows
   with equal bytes have equal anchors, so a window only ever has to be compared with windows of the
   same anchor. Neighbouring windows with the same anchor position form a *segment*: about one for
   each hundred bytes, told by two hashes.
2. Segments are sorted by (anchor, content), dealt by ranges. Equal segments repeat as a whole.
3. For anchors with several contents, one segment of each is fetched. Their suffixes are put in order
   by prefix multiplication (ranks of 8, 24, 72, 216, ... bytes). In suffix order, ties by position,
   the previous smaller and the next larger position with `length` equal bytes are a suffix's
   neighbours: the longest-previous-factor array says whether a window came before, its mirror whether
   it comes again.

Anchors with more than `group` contents are compared window by window, aggregated before the shuffle.

A window can also be a number of words with all bytes between them, so that it fits every passage of
so many words, however short. Its k-grams are runs of words, and its suffixes are put in order word by
word.
Places are ordered by doc_id, then byte. Offsets count bytes of UTF-8; matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from delayfold.llm import arrays
from delayfold.llm.tables import stored, whole_groups

# Bytes worked on at a time; arrays over them take about a hundred times as much.
_HELD_BYTES = 1 << 19

_PLACE = "doc_id long, version long, first long, last long"


def _version(chunk: arrays.Chunk, hashes: arrays.RangeHash) -> np.ndarray:
    """Tells texts apart that share a doc_id."""
    return hashes(chunk.offsets[:-1], chunk.offsets[1:]).view(np.int64)


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its first least one."""
    position = np.arange(len(values), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        position = np.where(right, position[step:], position[:-step])
        values = np.where(right, values[step:], values[:-step])
        span += step
    return position


def _segments(length: int, words: int | None):
    size = words or length
    gram = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches, limit=_HELD_BYTES):
            found = arrays.split_words(chunk.data, chunk.offsets) if words else None
            first_of = found.first if words else chunk.offsets
            counts = np.diff(first_of)
            if counts.max() < size:
                continue
            hashes = arrays.RangeHash(chunk.data)
            if words:
                grams = hashes(found.starts[: len(found.starts) - gram + 1], found.ends[gram - 1 :])
            else:
                grams = hashes.windows(gram)
            position = _least_positions(grams, size - gram + 1)
            starts = np.arange(len(position))
            doc = np.repeat(np.arange(len(chunk)), counts)[: len(starts)]
            starts = starts[starts + size <= first_of[1:][doc]]
            position, doc = position[starts], doc[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (position[1:] != position[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
            if words:
                first, last = found.starts[first], found.ends[last + words - 1]
            doc = doc[begin]
            yield pa.record_batch(
                [
                    pa.array(grams[position[begin]].view(np.int64)),
                    pa.array(hashes(first, last if words else last + length).view(np.int64)),
                    chunk.column("doc_id").take(pa.array(doc)),
                    pa.array(_version(chunk, hashes)[doc]),
                    pa.array(first - chunk.offsets[doc]),
                    pa.array(last - chunk.offsets[doc]),
                ],
                ["anchor", "content", "doc_id", "version", "first", "last"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted segments, those next to one with the same anchor.

    `again`: a neighbour has the same content; `lead`: the first of its content. The first and last
    row of a partition are marked `edge`, as their other neighbour is elsewhere.
    """
    held: pa.RecordBatch | None = None
    opened = False

    def told(rows: pa.Table, edge: np.ndarray, take: slice) -> pa.Table:
        anchor, content = (rows.column(c).to_numpy() for c in ("anchor", "content"))
        same_anchor = np.zeros(len(anchor) + 1, bool)
        same_anchor[1:-1] = anchor[1:] == anchor[:-1]
        same = same_anchor.copy()
        same[1:-1] &= content[1:] == content[:-1]
        keep = np.zeros(len(anchor), bool)
        keep[take] = (same_anchor[1:] | same_anchor[:-1] | edge)[take]
        flags = {"again": same[1:] | same[:-1], "lead": ~same[:-1], "edge": edge}
        for name, values in flags.items():
            rows = rows.append_column(name, pa.array(values))
        return rows.filter(pa.array(keep))

    # One row before and one after are needed to judge a row: the last two rows wait for the next batch.
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        edge = np.zeros(rows.num_rows, bool)
        judged_before = 0 if not opened else 1
        edge[0] = not opened
        if rows.num_rows > 1:
            yield from told(rows, edge, slice(judged_before, rows.num_rows - 1)).to_batches()
            opened = True
            held = rows.slice(rows.num_rows - 2).combine_chunks().to_batches()[0]
        else:
            held = rows.to_batches()[0]
    if held is not None:
        rows = pa.Table.from_batches([held])
        edge = np.zeros(rows.num_rows, bool)
        edge[-1] = True
        yield from told(rows, edge, slice(rows.num_rows - 1, rows.num_rows)).to_batches()


def _cut_out(length: int):
    """The bytes of the segments listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            hashes = arrays.RangeHash(chunk.data)
            version = _version(chunk, hashes)
            listed = chunk.column("wanted")
            row = np.repeat(np.arange(len(chunk)), np.diff(np.asarray(listed.offsets)))
            items = listed.flatten()
            mine = np.asarray(items.field("version")) == version[row]
            items, row = items.filter(pa.array(mine)), row[mine]
            first = np.asarray(items.field("first")) + chunk.offsets[row]
            last = np.asarray(items.field("last")) + chunk.offsets[row]
            raw = chunk.data.tobytes()
            yield pa.record_batch(
                [
                    items.field("anchor"),
                    chunk.column("doc_id").take(pa.array(row)),
                    items.field("version"),
                    items.field("first"),
                    items.field("last"),
                    items.field("again"),
                    pa.array([raw[a : b + length] for a, b in zip(first, last)], pa.binary()),
                ],
                ["anchor", "doc_id", "version", "first", "last", "again", "bytes"],
            )

    return run


def prefix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first `length` bytes; equal ranks mean equal bytes."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    width = min(8, length)
    for i in range(width):
        key = (key << np.uint64(8)) | padded[i : i + len(data)]
    return _widened(np.unique(key, return_inverse=True)[1], width, length)


def word_order(data: np.ndarray, found: arrays.Words, length: int) -> np.ndarray:
    """Rank of the suffix at every word by its first `length` words and the bytes between them.

    Words are told apart by 64-bit hashes. Ranks of suffixes that cross a text's end mean nothing.
    """
    hashes = arrays.RangeHash(data)
    with_gap = hashes(found.starts, np.append(found.starts[1:], len(data)))
    rank = _widened(np.unique(with_gap, return_inverse=True)[1], 1, length - 1)
    bare = np.unique(hashes(found.starts, found.ends), return_inverse=True)[1]
    last = np.zeros(len(bare), np.int64)
    last[: len(bare) - length + 1] = bare[length - 1 :]
    return np.unique((rank << int(bare.max()).bit_length()) | last, return_inverse=True)[1]


def _widened(rank: np.ndarray, width: int, length: int) -> np.ndarray:
    """Ranks by the first `length` places, from ranks by the first `width`."""
    while width < length:
        reach = min(3 * width, length)
        bits = max(1, int(rank.max()).bit_length())
        steps = (0, width, 2 * width) if 3 * bits < 63 and reach > 2 * width else (0, min(width, length - width))
        steps = sorted({min(s, reach - width) for s in steps})
        key = np.zeros(len(rank), np.int64)
        for s in steps:
            moved = np.zeros(len(rank), np.int64)
            moved[: len(rank) - s] = rank[s:]
            key = (key << bits) | moved
        rank = np.unique(key, return_inverse=True)[1]
        width = steps[-1] + width
    return rank


def previous_and_next(rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at `starts` (ascending), the nearest earlier and later one of equal rank, or -1.

    Suffixes are put in order of rank, ties by position: within a rank, the previous smaller position
    is the predecessor and the next larger one the successor.
    """
    order = np.lexsort((starts, rank[starts]))
    same = rank[starts[order][1:]] == rank[starts[order][:-1]]
    before, after = np.full(len(starts), -1), np.full(len(starts), -1)
    before[order[1:][same]] = starts[order[:-1][same]]
    after[order[:-1][same]] = starts[order[1:][same]]
    return before, after


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags with one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1]


def _places(
    data: np.ndarray, offsets: np.ndarray, length: int, words: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of all windows of the texts: text number, first and last as in _PLACE but from byte 0 of `data`;
    for windows of words also their ranks."""
    found = arrays.split_words(data, offsets) if words else None
    first_of = found.first if words else offsets
    windows = np.diff(first_of) - (words or length) + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    start = first_of[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not words:
        return owner, start, start, None
    rank = word_order(data, found, words)[start] if len(start) else start
    return owner, found.starts[start], found.ends[start + words - 1], rank


def _factors(length: int, words: int | None, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["anchor"], _HELD_BYTES):
            rows = rows.combine_chunks()
            texts = rows.column("bytes").cast(pa.large_binary()).combine_chunks()
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            owner, start, last, rank = _places(data, offsets, length, words)
            if words:
                before, after = previous_and_next(rank, np.arange(len(rank)))
            else:
                before, after = previous_and_next(prefix_order(data, length), start)
            found = before >= 0 if keep_first else (before >= 0) | (after >= 0)
            low, high = _runs(found, owner)
            who = pa.array(owner[low])
            moved = rows.column("first").to_numpy()[owner[low]] - offsets[owner[low]]
            yield pa.record_batch(
                [
                    rows.column("doc_id").combine_chunks().take(who),
                    rows.column("version").combine_chunks().take(who),
                    pa.array(moved + start[low]),
                    pa.array(moved + last[high]),
                ],
                ["doc_id", "version", "first", "last"],
            )

    return run


def _single_windows(length: int, words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches, "bytes"):
            owner, start, last, _ = _places(chunk.data, chunk.offsets, length, words)
            moved = np.asarray(chunk.column("first"))[owner] - chunk.offsets[owner]
            who = pa.array(owner)
            yield pa.record_batch(
                [
                    pa.array(arrays.RangeHash(chunk.data)(start, last if words else start + length).view(np.int64)),
                    chunk.column("doc_id").take(who),
                    chunk.column("version").take(who),
                    pa.array(moved + start),
                    pa.array(moved + last),
                ],
                ["window", "doc_id", "version", "first", "last"],
            )

    return run


def repeated_windows(
    docs: DataFrame, length: int = 400, keep_first: bool = True, group: int = 4096, words: int | None = None
) -> DataFrame:
    """doc_id, version, first, last: starts of windows of `length` bytes that occur elsewhere too.

    With `keep_first`, only windows that also occur earlier. `version` is a hash of the text. Ranges
    of one text may touch, never contradict; texts shorter than `length` have none.

    With `words`, windows of so many words (runs of anything but ASCII white space) and the bytes between
    them take the place of `length` bytes; `last` is then the end of the last window, not its start.
    """
    length = 0 if words else length
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["anchor", "content", "doc_id", "version", "first"]
    shared = stored(
        texts.mapInArrow(_segments(length, words), f"anchor long, content long, {_PLACE}")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_shared, f"anchor long, content long, {_PLACE}, again boolean, lead boolean, edge boolean"),
        "segments",
    )
    # Rows at the edges of partitions, two for each: settled among themselves.
    near = Window.partitionBy("anchor", "content")
    edges = (
        shared.where("edge")
        .withColumn("n", F.count("*").over(near))
        .withColumn("place", F.row_number().over(near.orderBy("doc_id", "version", "first")))
        .withColumn("again", F.col("again") | (F.col("n") > 1))
        .withColumn("lead", F.col("lead") & (F.col("place") == 1))
        .select(shared.columns)
    )
    segments = shared.where("not edge").union(edges)
    whole = segments.where("again and not lead" if keep_first else "again")

    leads = segments.where("lead").drop("content", "edge", "lead")
    contents = leads.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    asked = leads.join(contents, "anchor")
    wanted = asked.groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "version", "first", "last", "again")).alias("wanted")
    )
    cut = texts.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")))
    found = stored(
        cut.select("t.doc_id", "text", "wanted").mapInArrow(
            _cut_out(length), f"anchor long, {_PLACE}, again boolean, bytes binary"
        ),
        "contents",
    )
    large = contents.where(F.col("contents") > group).select("anchor")
    small = found.join(large, "anchor", "left_anti")
    dealt = small.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "version", "first")
    ranges = dealt.mapInArrow(_factors(length, words, keep_first), _PLACE)

    single = found.join(large, "anchor", "left_semi").mapInArrow(
        _single_windows(length, words), f"window long, {_PLACE}"
    )
    place = F.struct("doc_id", "version", "first")
    counted = single.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    many = single.join(counted.where("n > 1"), "window")
    if keep_first:
        many = many.where(~place.eqNullSafe(F.col("least")))
    windows = many.select("doc_id", "version", "first", "last")
    return whole.select("doc_id", "version", "first", "last").union(ranges).union(windows)


def with_repeats(
    docs: DataFrame, length: int = 400, keep_first: bool = True, group: int = 4096, words: int | None = None
) -> DataFrame:
    """The rows of `docs` with a column `repeats`: windows found in any text of the same doc_id, or null.

    With `words`, windows of so many words are found besides those of `length` bytes.
    """
    found = repeated_windows(docs, length, keep_first, group).withColumn("passage", F.lit(False))
    if words:
        passages = repeated_windows(docs, length, keep_first, group, words)
        # Ranges end `length` bytes after `last`.
        ends = passages.withColumn("last", F.col("last") - length)
        found = found.union(ends.withColumn("passage", F.lit(True)))
    listed = found.groupBy("doc_id").agg(
        F.collect_list(F.struct("version", "first", "last", "passage")).alias("repeats")
    )
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
    return docs.alias("d").join(listed.alias("r"), same, "left").select(*names, "r.repeats")


def _spans(
    chunk: arrays.Chunk, length: int, passages: bool | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges covered by the windows listed for each text: text number, start, end. Windows of
    words only, of bytes only, or of both (None)."""
    listed = chunk.column("repeats")
    counts = np.diff(np.asarray(listed.offsets))
    counts[np.asarray(listed.is_null())] = 0
    row = np.repeat(np.arange(len(chunk)), counts)
    items = listed.flatten()
    mine = np.asarray(items.field("version")) == _version(chunk, arrays.RangeHash(chunk.data))[row]
    if passages is not None:
        mine &= items.field("passage").to_numpy(zero_copy_only=False).astype(bool) == passages
    row = row[mine]
    start = (np.asarray(items.field("first"))[mine] + chunk.offsets[row]).astype(np.int64)
    end = (np.asarray(items.field("last"))[mine] + chunk.offsets[row] + length).astype(np.int64)
    if not len(row):
        return row, start, end
    order = np.argsort(start, kind="stable")  # texts lie back to back, so this also sorts by text
    row, start, end = row[order], start[order], end[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(row), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], start[begin], reach[np.append(begin[1:], len(row)) - 1]


def _kept(data: bytes, spans: list[tuple[int, int]], low: int, high: int) -> bytes:
    parts, at = [], low
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    parts.append(data[at:high])
    return b"".join(parts)


def _by_text(
    chunk: arrays.Chunk, length: int, passages: bool | None = None
) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    row, start, end = _spans(chunk, length, passages)
    bounds = np.searchsorted(row, np.arange(len(chunk) + 1))
    for i in range(len(chunk)):
        part = slice(bounds[i], bounds[i + 1])
        yield i, list(zip(start[part].tolist(), end[part].tolist()))


_DIGESTS = {
    "doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string",
    "n_passages": "long", "n_passage_bytes": "long",
}


def repeat_digests(found: DataFrame, length: int = 400) -> DataFrame:
    """For rows of `with_repeats`: sizes and the hash of what is left when the repeated strings of `length`
    bytes are out, and, where passages of words were asked for, how many bytes they cover in how many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            raw, bounds = chunk.data.tobytes(), chunk.offsets.tolist()
            removed, n_spans, hashes = [], [], []
            for i, spans in _by_text(chunk, length, False):
                removed.append(sum(end - start for start, end in spans))
                n_spans.append(len(spans))
                kept = _kept(raw, spans, bounds[i], bounds[i + 1])
                hashes.append(hashlib.sha256(kept).hexdigest())
            row, start, end = _spans(chunk, length, True)
            covered = np.bincount(row, end - start, len(chunk)).astype(np.int64)
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    pa.array(chunk.lengths),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(np.bincount(row, minlength=len(chunk)).astype(np.int64)),
                    pa.array(covered),
                ],
                [*_DIGESTS],
            )

    texts = found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "repeats")
    return texts.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in _DIGESTS.items()))


def _whole_characters(chunk: arrays.Chunk, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller where they would cut a character in two."""
    inside = (chunk.data & 0xC0) == 0x80
    trimmed = []
    for start, end in spans:
        while start < end and inside[start]:
            start += 1
        while end > start and end < len(inside) and inside[end]:
            end -= 1
        if end > start:
            trimmed.append((start, end))
    return trimmed


def without_repeats(
    docs: DataFrame, length: int = 400, group: int = 4096, words: int | None = None
) -> DataFrame:
    """`docs` with later copies taken out of the texts; the first copy, and every row, stays.

    A byte goes if it lies in a string of `length` bytes that also starts earlier, by doc_id and place,
    or, with `words`, in a passage of so many words that does.
    At both ends whole characters stay. Null texts stay null; a text that is one later copy becomes
    empty. A column n_chars, if there is one, is brought up to date.
    """
    found = with_repeats(docs, length, True, group, words)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            raw, bounds = chunk.data.tobytes(), chunk.offsets.tolist()
            texts = []
            for i, spans in _by_text(chunk, length):
                spans = _whole_characters(chunk, spans)
                texts.append(_kept(raw, spans, bounds[i], bounds[i + 1]).decode())
            columns = [chunk.column(c) for c in names]
            columns[names.index("text")] = pa.array(texts, pa.string(), mask=chunk.null)
            yield pa.record_batch(columns, names)

    cleaned = found.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return cleaned
    count = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("n_chars").isNotNull(), count)
    return cleaned.withColumn("n_chars", changed)
