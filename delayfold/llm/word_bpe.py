"""BPE over words with word ends, by contiguous arrays of part boundaries and neighbouring ranks.

The vocabulary file gives merges of two parts each. A text's white space goes, what is left is lower-cased
and cut into words; a word's bytes are spelled by 256 letters and its last one carries the mark of a
word's end. A word starts as one part a byte. Its boundaries and the rank of every two neighbours lie in
two plain arrays; the arrays are scanned for the least rank (the leftmost of equal ones), the boundary
between these two is deleted and the ranks next to it are read anew, until no two neighbours have one.

A scan is as long as the word, so words of more than `_LONG` bytes (unbroken runs of letters or of signs)
take the same merges in the same order from a heap. Spark spreads the texts, a task encodes a word once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from delayfold.llm import arrays

_LONG = 1024
_SLICE = 1 << 20  # characters of a text that are worked on at a time
_KEPT = 1 << 24  # characters of words that a worker remembers
_NONE = sys.maxsize
_CHUNK = 1 << 20


# Fixed value: the file's pattern of a word.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANK = regex.compile(r"[\t-\r ]")


@functools.cache
def _unassigned() -> np.ndarray:
    """Code points that this Python's tables do not know; newer ones may be letters to others."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def _strange(text: str) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return bool(_unassigned()[codes].any())


def _letters() -> list[str]:
    """The letter of each byte: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printable)
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [spelled[b] for b in range(256)]


class WordBpe:
    """A vocabulary file, and the words that this worker has met lately."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self._end = model["end_of_word_suffix"]
        self._ids: dict[str, int] = dict(model["vocab"])
        self._ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens = {i: t for t, i in [*self._ids.items(), *self.special.items()]}
        longest = sorted(self.special, key=len, reverse=True)
        self._apart = re.compile("|".join(map(re.escape, longest))) if longest else None
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._spelling = {b: letter for b, letter in enumerate(_letters())}
        self._known: dict[str, tuple[int, ...]] = {}
        self._room = _KEPT

    # ------------------------------------------------------------ one word

    def _scan(self, spelled: str, bounds: list[int]) -> list[int]:
        """Boundaries of the word's final parts, by the two arrays. Part i lies between boundaries i and
        i + 1, rank i is that of parts i and i + 1."""
        get = self._ranks.get
        letters = [*spelled[: bounds[-2]], spelled[bounds[-2] :]]
        ranks = [get(pair, _NONE) for pair in zip(letters, letters[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            low, high = bounds[i], bounds[i + 1]
            part = spelled[low:high]
            if i < len(ranks):
                ranks[i] = get((part, spelled[high : bounds[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = get((spelled[bounds[i - 1] : low], part), _NONE)
        return bounds

    def _heap(self, spelled: str, bounds: list[int]) -> list[int]:
        """The same boundaries for a long word: (rank, part) on a heap, parts linked to their neighbours."""
        n = len(bounds) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        gone = bytearray(n)

        def rank(i: int) -> int:
            j = after[i]
            if j >= n:
                return _NONE
            return self._ranks.get((spelled[bounds[i] : bounds[j]], spelled[bounds[j] : bounds[after[j]]]), _NONE)

        heap = [(r, i) for i in range(n) if (r := rank(i)) != _NONE]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if gone[i] or rank(i) != least:
                continue
            j = after[i]
            gone[j], after[i] = 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != _NONE:
                    heapq.heappush(heap, (r, k))
        return [b for i, b in enumerate(bounds[:-1]) if not gone[i]] + bounds[-1:]

    def contract(self, word: str, long: int = _LONG) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        spelled = "".join(map(self._spelling.__getitem__, raw)) + self._end
        bounds = [*range(len(raw)), len(spelled)]
        bounds = self._scan(spelled, bounds) if len(raw) <= long else self._heap(spelled, bounds)
        return [self._ids[spelled[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _of_word(self, word: str) -> tuple[int, ...]:
        ids = self._known.get(word)
        if ids is None:
            ids = tuple(self.contract(word))
            if len(word) <= _LONG:
                self._room -= len(word) + 2 * len(ids) + 16
                if self._room < 0:
                    self._known.clear()
                    self._room = _KEPT
                self._known[word] = ids
        return ids

    # ------------------------------------------------------------ texts

    def _words(self, text: str) -> Iterator[list[str]]:
        """Words of a text, in slices that end before white space."""
        if not text.isascii() and _strange(text):
            # Only the library knows what its tables hold there.
            normal = self._normalizer.normalize_str(text)
            yield [normal[a:b] for _, (a, b) in self._cutter.pre_tokenize_str(normal)]
            return
        # Each letter by itself: a final sigma is no different from others.
        normal = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        normal = normal.lower()
        start = 0
        while start < len(normal):
            blank = _BLANK.search(normal, start + _SLICE)
            end = blank.start() if blank else len(normal)
            yield _WORD.findall(normal, start, end)
            start = end

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text without special strings."""
        for words in self._words(text):
            yield np.array([*chain.from_iterable(map(self._of_word, words))], np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the file's special strings in it have ids of their own."""
        parts, start = [np.zeros(0, np.uint32)], 0
        for special in self._apart.finditer(text) if self._apart else ():
            parts += self._plain(text[start : special.start()])
            parts.append(np.array([self.special[special.group()]], np.uint32))
            start = special.end()
        parts += self._plain(text[start:])
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks, as there is no decoder in the file; special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.cache
def _loaded(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in arrays.text_chunks(batches, limit=_CHUNK):
        yield chunk.rows


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row. A null text is empty and has no ids; repeated rows and rows without
    doc_id count like others, other columns are ignored, an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for rows in _slices(batches):
            ids = [bpe.encode(t or "").view(np.int32) for t in rows.column("text").to_pylist()]
            bounds = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            yield pa.record_batch([rows.column("doc_id"), arrays.list_rows(flat, bounds)], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of `encode`; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = [bpe.decode(np.array(i or [], np.int64)) for i in rows.column("ids").to_pylist()]
                yield pa.record_batch([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every row and decodes its ids in one pass; hashes of both. Rows count as in `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for rows in _slices(batches):
            n, ids_hash, text_hash = [], [], []
            for text in rows.column("text").to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
