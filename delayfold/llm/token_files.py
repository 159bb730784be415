"""Token ids of a corpus in wavelet-matrix files, and what can be asked of such a file.

A file ("shard") holds the ids of consecutive documents as a wavelet matrix: one bit plane for each
bit of an id, highest first. After each plane the ids are parted, stably, into those with a 0 and
those with a 1 there. Planes are cut into blocks, compressed one by one, with the number of ones
before each block; so access, rank and select read one block of each plane.

    bytes 0-7    magic and version
    8-11         length of the header, little-endian
    header       JSON: tokens, docs, bits, zeros of each plane, end offsets of blocks, ones before them
    body         compressed ids of documents, their lengths, then the blocks of each plane

Writing: texts are encoded where they are read, rows are dealt by ranges of doc_id, and each task
writes its share as one file after the other. The manifest names the files of successful tasks.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from delayfold.llm import arrays, pieces
from delayfold.llm.tables import stored
from delayfold.session import work_dir

_MAGIC = b"WVLTMX01"
_BLOCK = 1 << 19  # bits
_CHUNK = 2 << 20  # of text; a piece that comes again in it is counted once
_BUCKETS = 4096


# ---------------------------------------------------------------- one file


def write_shard(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> bytes:
    """The bytes of a file for the documents' ids, back to back in `ids`."""
    ids = np.ascontiguousarray(ids, np.uint32)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    current = ids.astype(np.uint16) if bits <= 16 else ids
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(json.dumps(docs).encode()), pack(np.asarray(lengths, "<i8").tobytes())]
    zeros, ones_before = [], []
    for bit in range(bits - 1, -1, -1):
        plane = ((current >> current.dtype.type(bit)) & 1).astype(bool)
        before = 0
        ones_before.append([])
        for at in range(0, len(plane), _BLOCK):
            block = plane[at : at + _BLOCK]
            ones_before[-1].append(before)
            before += int(np.count_nonzero(block))
            parts.append(pack(np.packbits(block).tobytes()))
        zeros.append(len(plane) - before)
        current = np.concatenate([current[~plane], current[plane]])
    ends = np.cumsum([len(p) for p in parts]).tolist()
    header = {
        "tokens": len(ids), "docs": len(docs), "bits": bits, "zeros": zeros,
        "ends": ends, "ones_before": ones_before,
    }
    text = json.dumps(header).encode()
    return b"".join([_MAGIC, len(text).to_bytes(4, "little"), text, *parts])


class Shard:
    """An opened file. Positions count the ids of the whole file from 0."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:12], "little")
        self._head = json.loads(data[12 : 12 + size])
        self._data, self._body = data, 12 + size
        self._blocks: dict[int, np.ndarray] = {}
        self.tokens, self.bits = self._head["tokens"], self._head["bits"]
        self.docs: list[int | None] = json.loads(self._part(0))
        self.lengths = np.frombuffer(self._part(1), "<i8")
        self._per_plane = -(-self.tokens // _BLOCK)

    def _part(self, i: int) -> bytes:
        ends = self._head["ends"]
        low = self._body + (ends[i - 1] if i else 0)
        return zstandard.ZstdDecompressor().decompress(self._data[low : self._body + ends[i]])

    def _block(self, plane: int, block: int) -> np.ndarray:
        number = 2 + plane * self._per_plane + block
        if number not in self._blocks:
            if len(self._blocks) >= 2 * self.bits:
                self._blocks.clear()
            count = min(_BLOCK, self.tokens - block * _BLOCK)
            self._blocks[number] = np.unpackbits(np.frombuffer(self._part(number), np.uint8), count=count)
        return self._blocks[number]

    def _ones(self, plane: int, position: int) -> int:
        """Ones of a plane before a position."""
        block, rest = divmod(position, _BLOCK)
        if block == self._per_plane:
            return self.tokens - self._head["zeros"][plane]
        before = self._head["ones_before"][plane][block]
        return before + int(np.count_nonzero(self._block(plane, block)[:rest]))

    def _go(self, plane: int, position: int, one: int) -> int:
        """Where the ids with this bit, before `position`, end after the plane's parting."""
        ones = self._ones(plane, position)
        return self._head["zeros"][plane] + ones if one else position - ones

    def access(self, position: int) -> int:
        if not 0 <= position < self.tokens:
            raise IndexError(position)
        value = 0
        for plane in range(self.bits):
            one = int(self._block(plane, position // _BLOCK)[position % _BLOCK])
            value = 2 * value + one
            position = self._go(plane, position, one)
        return value

    def _range(self, value: int, until: int) -> tuple[int, int]:
        low, high = 0, until
        for plane in range(self.bits):
            one = value >> (self.bits - 1 - plane) & 1
            low, high = self._go(plane, low, one), self._go(plane, high, one)
        return low, high

    def rank(self, value: int, until: int) -> int:
        """Occurrences of an id before a position."""
        if value >> self.bits:
            return 0
        low, high = self._range(value, until)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.tokens)

    def _select_bit(self, plane: int, nth: int, one: int) -> int:
        """Position of the nth (from 0) bit of a kind in a plane."""
        before = self._head["ones_before"][plane]
        low, high = 0, self._per_plane - 1
        while low < high:
            middle = (low + high + 1) // 2
            found = before[middle] if one else middle * _BLOCK - before[middle]
            low, high = (middle, high) if found <= nth else (low, middle - 1)
        found = before[low] if one else low * _BLOCK - before[low]
        return low * _BLOCK + int(np.flatnonzero(self._block(plane, low) == one)[nth - found])

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence (from 0) of an id."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        position = self._range(value, self.tokens)[0] + nth
        for plane in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - plane) & 1
            nth_bit = position - self._head["zeros"][plane] if one else position
            position = self._select_bit(plane, nth_bit, one)
        return position

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, n) for n in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """All ids, in order: the partings undone from the last plane to the first."""
        current = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            bits = [
                np.frombuffer(self._part(2 + plane * self._per_plane + b), np.uint8)
                for b in range(self._per_plane)
            ]
            ones = np.unpackbits(np.concatenate(bits or [np.zeros(0, np.uint8)]), count=self.tokens).astype(bool)
            zeros = self._head["zeros"][plane]
            previous = np.empty_like(current)
            previous[~ones] = current[:zeros]
            previous[ones] = current[zeros:] | current.dtype.type(1 << (self.bits - 1 - plane))
            current = previous
        return current


# ---------------------------------------------------------------- the jobs


def read_bytes(path: str) -> bytes:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name) as f:
        return f.read()


def _write_bytes(path: str, data: bytes) -> None:
    files, name = fs.FileSystem.from_uri(path)
    files.create_dir(os.path.dirname(name), recursive=True)
    with files.open_output_stream(name) as f:
        f.write(data)


def _kept() -> dict:
    """What a Python worker keeps from task to task. The package's functions travel by value, each time with
    globals of their own; a module by this name stays."""
    return vars(sys.modules.setdefault("_delayfold_kept", types.ModuleType("_delayfold_kept")))


@functools.cache
def _special(vocabulary: str) -> dict[bytes, int]:
    """Strings that have an id of their own wherever they stand in a text."""
    with open(vocabulary, encoding="utf-8") as f:
        return {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}


def _piece_encoder(vocabulary: str) -> Callable[[list[bytes]], list[list[int]]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True  # looking for them in every piece takes time; they are cut out
    special = _special(vocabulary)

    def encode(found: list[bytes]) -> list[list[int]]:
        batch = tokenizer.encode_batch_fast([p.decode() for p in found], add_special_tokens=False)
        ids = [e.ids for e in batch]
        for i, piece in enumerate(found):
            if piece in special:
                ids[i] = [special[piece]]
        return ids

    return encode


def _encoder(vocabulary: str) -> pieces.PieceTable:
    """One for each Python worker: reading a vocabulary takes longer than encoding a text."""
    encoders = _kept().setdefault("encoders", {})
    if vocabulary not in encoders:
        encoders[vocabulary] = pieces.PieceTable(_piece_encoder(vocabulary), np.uint32)
    return encoders[vocabulary]


_counters: dict[str, pieces.PieceTable] = {}


def _counter(vocabulary: str) -> pieces.PieceTable:
    """The same for numbers of ids: one small number for each piece, and only for a task."""
    if vocabulary not in _counters:
        encode = _piece_encoder(vocabulary)
        _counters[vocabulary] = pieces.PieceTable(
            lambda found: [[len(e)] for e in encode(found)], np.uint32, 500_000
        )
    return _counters[vocabulary]


def _encode(vocabulary: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(vocabulary)
        for chunk in arrays.text_chunks(batches, limit=_CHUNK):
            cut = pieces.bounds_around(chunk.data, chunk.offsets, tuple(_special(vocabulary)))
            ids, counts = table.lookup(chunk.data, cut)
            at = pieces.text_counts(chunk.offsets, cut, counts)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            docs = chunk.column("doc_id")
            # Rows without doc_id come first.
            known = docs.fill_null(np.iinfo(np.int64).min).to_numpy()
            small = ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids
            yield pa.record_batch(
                [
                    pa.array(np.searchsorted(bounds, known).astype(np.int32)),
                    docs,
                    pa.array(np.full(len(docs), small.dtype.itemsize, np.int32)),
                    arrays.binary_rows(small, at),
                ],
                ["bucket", "doc_id", "width", "ids"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and n_tokens of every row: the ids of its whole text and one end; null for a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _counter(vocabulary)
        for chunk in arrays.text_chunks(batches, limit=_CHUNK):
            cut = pieces.bounds_around(chunk.data, chunk.offsets, tuple(_special(vocabulary)))
            at = pieces.text_counts(chunk.offsets, cut, table.lookup(chunk.data, cut)[0])
            n = pa.array(np.diff(at) + 1, pa.int64(), mask=chunk.null)
            yield pa.record_batch([chunk.column("doc_id"), n], ["doc_id", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_tokens long")


def _write(folder: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        number, docs, ids = 0, [], []

        def flush() -> pa.RecordBatch:
            data = write_shard(np.concatenate(ids), docs, np.array([len(i) for i in ids]))
            path = f"{name}-{number:06d}.tokens"
            _write_bytes(path, data)
            return pa.record_batch(
                [
                    [path], [number], pa.array([docs[0]], pa.int64()),
                    pa.array([len(docs)], pa.int64()), pa.array([sum(len(i) for i in ids)], pa.int64()),
                    pa.array([len(data)], pa.int64()), pa.array([bucket], pa.int64()),
                ],
                ["path", "number", "first_doc", "docs", "tokens", "bytes", "bucket"],
            )

        bucket, held = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "doc_id", "width", "ids")]
            for b, doc, width, raw in zip(*columns):
                if docs and (b != bucket or held >= shard_tokens):
                    yield flush()
                    number, docs, ids, held = number + 1, [], [], 0
                bucket = b
                docs.append(doc)
                ids.append(np.frombuffer(raw, f"<u{width}").astype(np.uint32))
                held += len(ids[-1])
        if docs:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_tokens: int = 1 << 22
) -> DataFrame:
    """Writes every text's ids, `end_id` after each, in ascending doc_id order. Returns the manifest.

    Manifest: path, number, first_doc, docs, tokens, bytes, bucket, and `start`, the ids in all files
    before. A null text is empty: its only id is the end. Rows without doc_id come first; rows that
    share a doc_id are ordered by their ids. An empty table gives no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Where to cut the range of doc_ids; a few thousand numbers at most, from that column alone.
    tasks = min(_BUCKETS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / tasks for i in range(1, tasks)]
    bounds = texts.agg(F.percentile_approx("doc_id", shares, 20 * tasks)).first()[0] or []
    schema = "bucket int, doc_id long, width int, ids binary"
    encoded = texts.mapInArrow(_encode(vocabulary, end_id, np.unique(np.array(bounds, np.int64))), schema)
    dealt = encoded.repartitionById(tasks, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    written = stored(
        dealt.mapInArrow(
            _write(folder, shard_tokens),
            "path string, number long, first_doc long, docs long, tokens long, bytes long, bucket long",
        ),
        "manifest",
    )
    before = Window.orderBy("bucket", "number").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file, of millions of ids.
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, per_document: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
    """doc_id, start, n_tokens and what `per_document` makes of the ids of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(read_bytes(path))
                ids, ends = shard.ids(), np.cumsum(shard.lengths)
                rows = []
                for doc, end, length in zip(shard.docs, ends.tolist(), shard.lengths.tolist()):
                    row = {"doc_id": doc, "start": start + end - length, "n_tokens": length}
                    rows.append(row | per_document(ids[end - length : end]))
                yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    layout = f"doc_id long, start long, n_tokens long, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(layout))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(run, layout)


def checksum(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
