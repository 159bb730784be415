"""Settles, before the keyed state, what the commands of one micro-batch decide among themselves.

All commands of an ID in a micro-batch meet in one task, which works on them as columns: they are put in
the order of operators/ordered, and the next command of each update is known, so it fires first or is
closed. Only the first and the last command matter to what was stored before and to what comes later, so
the keyed state sees at most two rows per ID and micro-batch, however many commands came. IDs are dealt to
many small groups, and a task holds one group at a time in memory. Fired rows travel on lanes of their own,
spread evenly and apart from the ID's state. The state has nothing to do with them and takes rows one by
one, so they pass it packed, many in one row, and are unpacked behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from delayfold.model import COMMANDS, ERROR, HEADERS, LANE, MAX_DELAY_MS
from delayfold.operators.decode import effective

STATE_LANE = 0
# Groups of IDs, each worked on at once, and lanes beside that of the state.
GROUPS = 1024
# Bytes of the rows that pass the state as one, before compression; an Arrow batch of such rows stays small.
PACK_BYTES = 32_768
PACKED = "packed"
CLOSER = "closer"
PAYLOAD = ("due_ms", "target_topic", "out_key", "out_value", "out_headers")
_FROM_COMMAND = ("schedule_id", *LANE, "offset", "arrival_ms", "command", *PAYLOAD)

# Input of the keyed state: one command under its ID on the state lane, or a fired one under no ID on
# another lane. Headers are a list, which state can hold.
RESOLVED = T.StructType(
    [T.StructField("state_id", T.StringType())]
    + [
        T.StructField(f.name, HEADERS if f.name == "out_headers" else f.dataType)
        for f in COMMANDS
        if f.name in _FROM_COMMAND
    ]
    + [
        T.StructField("seen_ms", T.LongType()),
        T.StructField("fire_ms", T.LongType()),
        T.StructField("lane", T.IntegerType()),
    ]
)


READ = "read"

# The same for a query that also tells what it read and did. closed_by: on the state lane, the command
# that closes what was stored. told: on other lanes, READ for a command as it was read, or the command that
# closed a schedule within the micro-batch; null for a fired one.
TOLD = T.StructType(
    RESOLVED.fields
    + [
        T.StructField("is_expired", T.BooleanType()),
        T.StructField("error", ERROR),
        T.StructField("closed_by", T.StringType()),
        T.StructField("told", T.StringType()),
        T.StructField("closed_ms", T.LongType()),
    ]
)

# What the keyed state reads: a command on the state lane, or packed rows on another one.
KEYED = T.StructType(
    [*RESOLVED.fields, T.StructField("closed_by", T.StringType()), T.StructField(PACKED, T.BinaryType())]
)


def stateful(schedules: DataFrame) -> DataFrame:
    """Schedules with their headers as a list."""
    return schedules.withColumn("out_headers", F.map_entries("out_headers").cast(HEADERS))


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Equal for rows of a sorted table that agree in `names`, and rising."""
    new = np.zeros(table.num_rows, bool)
    for name in names:
        column = table.column(name)
        same = pc.equal(column.slice(0, max(len(column) - 1, 0)), column.slice(1))
        new[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return np.cumsum(new)


def _running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Largest value so far within each run of equal `group` numbers, which rise."""
    distinct, rank = np.unique(values, return_inverse=True)
    size = len(distinct)
    return distinct[np.maximum.accumulate(group * size + rank) - group * size]


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    received = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(received) if received else None


def _settle(
    batches: Iterator[pa.RecordBatch], lanes: int, held: bool, layout: T.StructType = RESOLVED
) -> Iterator[pa.RecordBatch]:
    """One task's share of a micro-batch; all commands of an ID are in it. If `held`, nothing fires. With
    the layout TOLD, every command and every schedule that is closed is told too."""
    table = _whole(batches)
    if table is None:
        return
    telling = layout is TOLD
    aside = None
    if telling:  # reports and rows without an ID take no part
        report = pc.and_(pc.equal(table.column("command"), "delete"), table.column("is_expired"))
        takes_part = pc.and_(pc.invert(report), pc.is_valid(table.column("schedule_id")))
        takes_part = pc.fill_null(takes_part, False)
        aside, table = table.filter(pc.invert(takes_part)), table.filter(takes_part)
    table = table.sort_by([(n, "ascending") for n in ("schedule_id", *LANE, "offset")]).combine_chunks()
    owner = _numbers(table, ("schedule_id",))
    seen = _running_max(table.column("arrival_ms").to_numpy(), _numbers(table, ("schedule_id", *LANE)))
    order = np.lexsort((seen, owner))  # stable, so equal times keep the order of partition and offset
    table, owner, seen = table.take(pa.array(order)).combine_chunks(), owner[order], seen[order]

    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.append(first[1:], True)[: len(owner)]
    is_update = np.asarray(pc.equal(table.column("command"), "update").to_numpy(zero_copy_only=False), bool)
    due = pc.fill_null(table.column("due_ms"), 0).to_numpy()
    fire = np.maximum(seen, np.minimum(due, seen + MAX_DELAY_MS))
    now = table.column("now_ms").to_numpy()
    next_seen = np.append(seen[1:], 0)[: len(seen)]
    # A producer's clock may be ahead: what is not due by the clock here has not fired.
    fires = is_update & ~last & (fire < next_seen) & (fire <= now) & (not held)
    table = table.append_column("seen_ms", pa.array(seen))
    table = table.append_column("fire_ms", pa.array(fire, mask=~is_update))

    def shaped(rows: pa.Table, command: str | None, lane: np.ndarray, **more: pa.Array) -> pa.Table:
        if command == CLOSER:
            for name in (*PAYLOAD, "fire_ms"):
                at = rows.schema.get_field_index(name)
                rows = rows.set_column(
                    at, rows.schema.field(at), pa.nulls(len(rows), rows.schema.field(at).type)
                )
        commands = rows.column("command")
        if command is not None:
            at = rows.schema.get_field_index("command")
            rows = rows.set_column(at, "command", pa.array([command] * len(rows), pa.string()))
        on_state = command in (None, CLOSER)
        ids = rows.column("schedule_id") if on_state else pa.array([""] * len(rows), pa.string())
        rows = rows.append_column("state_id", ids)
        rows = rows.append_column("lane", pa.array(lane, pa.int32()))
        if telling:
            more = {"closed_by": commands if on_state else None, "told": None, "closed_ms": None} | more
            types = {"closed_by": pa.string(), "told": pa.string(), "closed_ms": pa.int64()}
            for name, values in more.items():
                if values is None:
                    values = pa.nulls(len(rows), types[name])
                if name in rows.column_names:
                    rows = rows.set_column(rows.schema.get_field_index(name), name, values)
                else:
                    rows = rows.append_column(name, values)
        return rows

    def part(mask: np.ndarray, lane: np.ndarray, command: str | None, **more: pa.Array) -> pa.Table:
        return shaped(table.filter(pa.array(mask)), command, lane[mask], **more)

    state = np.full(len(owner), STATE_LANE)
    apart = 1 + np.arange(len(owner)) % lanes
    pieces = [
        part(last, state, None),
        part(first & ~last, state, CLOSER),
        part(fires, apart, "fired"),
    ]
    if telling:
        closed = is_update & ~last & ~fires
        by = table.column("command").take(pa.array(np.flatnonzero(closed) + 1))
        pieces.append(part(closed, apart, "closed", told=by, closed_ms=pa.array(next_seen[closed])))
        for rows in (table, aside):
            if rows is aside:
                nothing = pa.nulls(len(rows), pa.int64())
                rows = rows.append_column("seen_ms", nothing).append_column("fire_ms", nothing)
            kind = rows.column("command")
            told = shaped(rows, READ, 1 + np.arange(len(rows)) % lanes, told=pa.array([READ] * len(rows), pa.string()))
            pieces.append(told.set_column(told.schema.get_field_index("command"), "command", kind))
    for piece in pieces:
        piece = piece.select(layout.fieldNames())
        schema = pa.schema([f.with_nullable(True) for f in piece.schema])
        yield from pa.Table.from_arrays(piece.columns, schema=schema).to_batches()


# Rows that have left the state's way, as the stream hands them on; given the ms of the micro-batch.
Shape = Callable[[pa.RecordBatch, int], pa.Table]


def _plain(table: pa.Table) -> pa.Table:
    schema = pa.schema([f.with_nullable(True) for f in table.schema])
    return pa.Table.from_arrays(table.columns, schema=schema)


def _pack(table: pa.Table) -> Iterator[bytes]:
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    for batch in table.to_batches(max_chunksize=max(1, PACK_BYTES * len(table) // max(1, table.nbytes))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
            writer.write_batch(batch)
        yield sink.getvalue().to_pybytes()


def _keyed_rows(columns: dict[str, pa.Array], like: pa.Schema, rows: int) -> pa.Table:
    """Rows of `KEYED`; other columns than the given ones are null."""
    types = {"closed_by": pa.string(), PACKED: pa.binary()}
    names = KEYED.fieldNames()
    types |= {n: like.field(n).type for n in names if n not in types}
    return _plain(pa.table({n: columns.get(n, pa.nulls(rows, types[n])) for n in names}))


def _settle_group(group: int, table: pa.Table, held: bool, layout: T.StructType, shape: Shape) -> pa.Table:
    """Settles all commands of a group of IDs: `KEYED` rows."""
    now = table.column("now_ms")[0].as_py()
    pieces, packs = [], []
    for batch in _settle(iter(table.to_batches()), GROUPS, held, layout):
        on_state = pc.equal(batch.column("lane"), STATE_LANE)
        state, apart = batch.filter(on_state), batch.filter(pc.invert(on_state))
        if state.num_rows:
            pieces.append(
                _keyed_rows(dict(zip(state.schema.names, state.columns)), batch.schema, len(state))
            )
        if apart.num_rows:
            packs += _pack(shape(apart, now))
            like = batch.schema
    if packs:
        columns = {
            "state_id": pa.array([""] * len(packs), pa.string()),
            "lane": pa.array([1 + (group + i) % GROUPS for i in range(len(packs))], pa.int32()),
            PACKED: pa.array(packs, pa.binary()),
        }
        pieces.append(_keyed_rows(columns, like, len(packs)))
    return pa.concat_tables(pieces)


def _settled(
    commands: DataFrame,
    columns: tuple[str, ...],
    owner: Column,
    held: bool,
    layout: T.StructType,
    shape: Shape,
) -> DataFrame:
    # Fixed for a micro-batch, and the time that the state sees too.
    now = F.unix_millis(F.current_timestamp())
    group = F.pmod(F.xxhash64(owner), F.lit(GROUPS)).cast("int")
    rows = stateful(commands).withColumns({"now_ms": now, "_group": group})

    def settle(key, table):
        return _settle_group(key[0].as_py(), table, held, layout, shape)

    return rows.select(*columns, "now_ms", "_group").groupBy("_group").applyInArrow(settle, KEYED)


def resolve_within_batch(commands: DataFrame, shape: Shape, held: bool = False) -> DataFrame:
    """Micro-batch commands reduced to what the keyed state needs (`KEYED`), and what `shape` makes of the
    fired ones (`RESOLVED`), packed."""
    named = effective(commands).where(F.col("schedule_id").isNotNull())
    return _settled(named, _FROM_COMMAND, F.col("schedule_id"), held, RESOLVED, shape)


def resolve_and_tell(commands: DataFrame, shape: Shape, held: bool = False) -> DataFrame:
    """The same, with every command and every closed schedule among what is packed; see `TOLD`."""
    nameless = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*LANE, "offset"), F.lit(GROUPS)))
    columns = (*_FROM_COMMAND, "is_expired", "error")
    return _settled(commands, columns, F.coalesce("schedule_id", nameless), held, TOLD, shape)


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows behind the state, each by itself again."""
    layout = T.StructType([f for f in rows.schema if f.name != PACKED])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = batch.column(PACKED)
            yield batch.filter(pc.is_null(packs)).select(layout.fieldNames())
            for pack in packs.drop_null():
                yield from pa.ipc.open_stream(pack.as_buffer())

    return rows.mapInArrow(unpack, layout)
