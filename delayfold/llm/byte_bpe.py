"""Byte-level BPE by DuckDB queries inside tasks: merges as joins, decoding as ordered aggregation.

The merge table lists every way to split a vocabulary entry into two entries. A recursive query holds
one row for each (piece, position) and in each step joins neighbours with the merge table and
contracts every piece's leftmost pair of least rank, until no piece has a pair left. Spark spreads the
texts; a task encodes each distinct piece once, ten thousand at a time.

Steps grow with a piece's length and rows with it, so the query takes pieces of up to `_LONG` bytes.
A longer one (unbroken runs of letters, digits, signs or blanks) is contracted in the same order by a
heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from delayfold.llm import arrays, pieces

_LONG = 256
_BATCH = 10_000  # pieces for one query

# k is 1024 * piece + position; positions of a piece stay dense, so neighbours differ by one. Pieces
# without a pair drop out, so the last step of each piece holds its ids.
_CONTRACT = """
WITH RECURSIVE state(step, k, id) AS (
    SELECT 0, piece * 1024 + pos, id FROM bytes_in
    UNION ALL (
        WITH best AS (
            SELECT a.k // 1024 AS piece, min(m.rank * 1024 + a.k % 1024) AS pick
            FROM state a
            JOIN state b ON b.k = a.k + 1
            JOIN merges m ON m.pair = a.id * 16777216 + b.id
            GROUP BY a.k // 1024
        )
        SELECT
            s.step + 1,
            s.k - (s.k % 1024 > b.pick % 1024)::BIGINT,
            CASE WHEN s.k % 1024 = b.pick % 1024 THEN b.pick // 1024 ELSE s.id END
        FROM state s JOIN best b ON b.piece = s.k // 1024
        WHERE s.k % 1024 <> b.pick % 1024 + 1
    )
), last_steps AS (
    SELECT k // 1024 AS piece, max(step) AS step FROM state GROUP BY k // 1024
)
SELECT s.k // 1024 AS piece, list(s.id ORDER BY s.k) AS ids
FROM state s JOIN last_steps l ON l.piece = s.k // 1024 AND l.step = s.step
GROUP BY s.k // 1024 ORDER BY s.k // 1024
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """A vocabulary in an in-memory DuckDB database of this process."""

    def __init__(self, path: str):
        self._ranks = read_ranks(path)
        self._bytes = {rank: token for token, rank in self._ranks.items()}
        self._single = np.array([self._ranks[bytes([b])] for b in range(256)], np.int64)
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        left, right, rank = [], [], []
        for token, merged in self._ranks.items():
            for at in range(1, len(token)):
                a, b = self._ranks.get(token[:at]), self._ranks.get(token[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(merged)
        table = pa.table({"pair": np.array(left) * 16777216 + np.array(right), "rank": np.array(rank)})
        vocabulary = pa.table({"id": list(self._bytes), "token": list(self._bytes.values())})
        self._db.register("merges_in", table)
        self._db.register("vocabulary_in", vocabulary)
        self._db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")

    def _contract_long(self, piece: bytes) -> list[int]:
        """The same contraction by a heap of (rank, place) over linked neighbours."""
        ids = [int(self._single[b]) for b in piece]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))

        def rank(at: int) -> int | None:
            end = after[at]
            if end >= len(ids):
                return None
            return self._ranks.get(self._bytes[ids[at]] + self._bytes[ids[end]])

        heap = [(r, at) for at in range(len(ids)) if (r := rank(at)) is not None]
        heapq.heapify(heap)
        while heap:
            merged, at = heapq.heappop(heap)
            if ids[at] < 0 or rank(at) != merged:
                continue
            gone = after[at]
            ids[at], ids[gone], after[at] = merged, -1, after[gone]
            if after[at] < len(ids):
                before[after[at]] = at
            for place in (at, before[at]):
                if place >= 0 and (r := rank(place)) is not None:
                    heapq.heappush(heap, (r, place))
        return [i for i in ids if i >= 0]

    def encode(self, found: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        result: list[np.ndarray | None] = [
            np.array(self._contract_long(p), np.uint32) if len(p) > _LONG else None for p in found
        ]
        rest = [i for i, r in enumerate(result) if r is None]
        for at in range(0, len(rest), _BATCH):
            chosen = rest[at : at + _BATCH]
            data = np.frombuffer(b"".join(found[i] for i in chosen), np.uint8)
            lengths = np.array([len(found[i]) for i in chosen])
            ends = np.cumsum(lengths)
            rows = pa.table(
                {
                    "piece": np.repeat(np.arange(len(chosen)), lengths),
                    "pos": np.arange(len(data)) - np.repeat(ends - lengths, lengths),
                    "id": self._single[data],
                }
            )
            self._db.register("bytes_in", rows)
            out = self._db.sql(_CONTRACT).to_arrow_table()
            self._db.unregister("bytes_in")
            lists = out.column("ids").combine_chunks()
            bounds, flat = np.asarray(lists.offsets), np.asarray(lists.flatten()).astype(np.uint32)
            for i, low, high in zip(chosen, bounds[:-1].tolist(), bounds[1:].tolist()):
                result[i] = flat[low:high]
        return result

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        lengths = np.array([len(e) for e in encoded], np.int64)
        ends = np.cumsum(lengths)
        rows = pa.table(
            {
                "piece": np.repeat(np.arange(len(encoded)), lengths),
                "pos": np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths),
                "id": np.concatenate([*encoded, np.zeros(0, np.uint32)]).astype(np.int64),
            }
        )
        self._db.register("ids_in", rows)
        found = self._db.execute(
            "SELECT piece, string_agg(hex(token), '' ORDER BY pos) AS hexed "
            "FROM ids_in JOIN vocabulary USING (id) GROUP BY piece"
        ).fetchall()
        self._db.unregister("ids_in")
        result = [b""] * len(encoded)
        for piece, hexed in found:
            result[piece] = bytes.fromhex(hexed)
        return result


class _Tables:
    """Ids of pieces, and bytes of the ids of pieces, both looked up once for each distinct piece."""

    def __init__(self, path: str):
        bpe = Bpe(path)
        self.ids = pieces.PieceTable(bpe.encode, np.uint32)

        def decoded(keys: list[bytes]) -> list[np.ndarray]:
            lists = [np.frombuffer(k, np.uint32) for k in keys]
            return [np.frombuffer(b, np.uint8) for b in bpe.decode(lists)]

        self.bytes = pieces.PieceTable(decoded, np.uint8)


_tables: dict[str, _Tables] = {}


def _loaded(path: str) -> _Tables:
    if path not in _tables:
        _tables[path] = _Tables(path)
    return _tables[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _loaded(path).ids
        for chunk in arrays.text_chunks(batches):
            cut = pieces.piece_bounds(chunk.data, chunk.offsets)
            ids, counts = table.lookup(chunk.data, cut)
            at = pieces.text_counts(chunk.offsets, cut, counts)
            # Bounds of pieces go along, so that decoding can look up what belongs together.
            first = np.searchsorted(cut, chunk.offsets)
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    arrays.list_rows(pa.array(ids.view(np.int32)), at),
                    arrays.list_rows(pa.array(counts.astype(np.int32)), first),
                ],
                ["doc_id", "ids", "piece_sizes"],
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and piece_sizes (ids of each piece of the text) of every row; null texts are empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_encode(path), "doc_id long, ids array<int>, piece_sizes array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64) - column.offsets[0].as_py()


def _decoded(table: pieces.PieceTable, ids: np.ndarray, id_bounds, sizes: np.ndarray, size_bounds):
    """Bytes of all texts back to back, and their bounds."""
    ids = np.ascontiguousarray(ids).view(np.uint32)
    cut = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data, counts = table.lookup(np.frombuffer(ids.tobytes(), np.uint8), cut)
    return data, pieces.text_counts(4 * id_bounds, cut, counts)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of every row of `encode`; without piece_sizes an id counts as a piece."""
    given = "piece_sizes" in encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _loaded(path).bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids, bounds = _flat(rows.column("ids"))
                sizes, size_bounds = _flat(rows.column("piece_sizes")) if given else (np.ones(len(ids)), bounds)
                data, cut = _decoded(table, ids, bounds, sizes, size_bounds)
                yield pa.record_batch([rows.column("doc_id"), arrays.binary_rows(data, cut)], ["doc_id", "bytes"])

    columns = ["doc_id", "ids"] + ["piece_sizes"] * given
    return encoded.select(*columns).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every row and decodes its ids, in one pass; hashes of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _loaded(path)
        for encoded in _encode(path)(batches):
            ids, bounds = _flat(encoded.column("ids"))
            data, cut = _decoded(tables.bytes, ids, bounds, *_flat(encoded.column("piece_sizes")))
            raw_ids, raw = ids.astype("<u4").tobytes(), data.tobytes()
            yield pa.record_batch(
                [
                    encoded.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array([_sha(raw_ids[4 * a : 4 * b]) for a, b in _pairs(bounds)], pa.string()),
                    pa.array([_sha(raw[a:b]) for a, b in _pairs(cut)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _pairs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    values = bounds.tolist()
    return zip(values[:-1], values[1:])
