"""Language of documents by bit-sliced Bloom filters of letter trigrams.

A slot of the filter holds one bit for each language, in words of up to 64; a trigram's slots, combined
by AND, give the mask of all languages that contain it. A text's bits are summed by language, what false hits would
give is taken off, and the largest sum decides.

Trigrams are centred on a letter; every other character is the same blank. A language contains a
trigram that makes up at least `SHARE` of its own, so a language has at most 1 / SHARE of them, and
whose share is at least `PART` of what it is in the language where it is most frequent.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from delayfold.llm import arrays

SHARE = 2e-5
PART = 0.1
_SLOTS = 1 << 20
_HASHES = 3

_lower: np.ndarray | None = None


def _lower_letters() -> np.ndarray:
    """Lower case of every letter, 0 for all other code points."""
    global _lower
    if _lower is None:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            if unicodedata.category(chr(code))[0] == "L":
                low = chr(code).lower()
                table[code] = ord(low) if len(low) == 1 else code
        _lower = table
    return _lower


def _trigrams(chunk: arrays.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Trigram of every letter (21 bits a character), and bounds of each text's."""
    if not len(chunk.data):
        return np.zeros(0, np.uint64), np.zeros(len(chunk) + 1, np.int64)
    code = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_of = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    first = np.searchsorted(byte_of, chunk.offsets)
    letters = _lower_letters()[code].astype(np.uint64)
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = 0
    after[starts[1:] - 1] = 0
    centre = letters != 0
    grams = (before << np.uint64(42)) | (letters << np.uint64(21)) | after
    return grams[centre], np.concatenate([[0], np.cumsum(arrays.sums_of(centre, first))])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): added up within the task before anything is shuffled."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            names = pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int64)))
            yield pa.record_batch([names, pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for chunk in arrays.text_chunks(batches):
        grams, bounds = _trigrams(chunk)
        langs = chunk.column("lang").dictionary_encode()
        owner = np.repeat(np.asarray(langs.indices), np.diff(bounds))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            keys, n = np.unique(grams[owner == i], return_counts=True)
            held[lang] = _merged([held[lang], (keys, n)]) if lang in held else (keys, n)
        if sum(len(k) for k, _ in held.values()) > 1_000_000:
            yield from told()
            held.clear()
    yield from told()


_WORD = 64


@dataclass
class Filters:
    """Bit i % 64 of a slot in slots[i // 64] belongs to languages[i]."""

    languages: list[str]
    slots: list[np.ndarray]
    false_hits: np.ndarray
    fallback: str

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages that contain each trigram, of those in one word of the mask."""
        found = None
        for seed in range(_HASHES):
            bits = self.slots[word][_slot(grams, seed)]
            found = bits if found is None else found & bits
        return found

    def _hits(self, grams: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        for word in range(len(self.slots)):
            masks = self.masks(grams, word)
            for bit in range(len(self.languages[_WORD * word : _WORD * (word + 1)])):
                yield arrays.sums_of(_bit(masks, bit), bounds)

    def decide(self, grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: no known trigram) and score of each text."""
        total = np.diff(bounds).astype(np.float64)
        hits = np.column_stack(list(self._hits(grams, bounds)))
        true = np.maximum(0, (hits - total[:, None] * self.false_hits) / (1 - self.false_hits))
        best = true.argmax(axis=1)
        all_true = true.sum(axis=1)
        score = np.divide(true.max(axis=1), all_true, out=np.zeros(len(total)), where=all_true > 0)
        return np.where(all_true > 0, best, -1), score


def _bit(masks: np.ndarray, bit: int) -> np.ndarray:
    return (masks >> masks.dtype.type(bit)) & masks.dtype.type(1)


def _slot(grams: np.ndarray, seed: int) -> np.ndarray:
    return arrays.mix(grams + np.uint64((seed + 1) << 58)) & np.uint64(_SLOTS - 1)


def train(docs: DataFrame, share: float = SHARE, part: float = PART) -> Filters | None:
    """Filters from all rows of `docs` with text and lang. At most 1 / share rows a language reach the
    driver. None if there are no languages."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = (
        known.mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = (
        counts.join(F.broadcast(totals), "lang")
        .where(F.col("n") >= share * F.col("total"))
        .select("lang", "gram", (F.col("n") / F.col("total")).alias("share"), "total")
        .toPandas()
    )
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    rows = rows[rows["share"] >= part * rows.groupby("gram")["share"].transform("max")]
    grams_of = {lang: r["gram"].to_numpy().astype(np.uint64) for lang, r in rows.groupby("lang")}
    slots, fill = [], []
    for first in range(0, len(languages), _WORD):
        inside = languages[first : first + _WORD]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(inside) <= 8 * t().itemsize)
        word = np.zeros(_SLOTS, kind)
        for bit, lang in enumerate(inside):
            for seed in range(_HASHES):
                word[_slot(grams_of.get(lang, np.zeros(0, np.uint64)), seed)] |= kind(1 << bit)
        slots.append(word)
        fill += [np.mean(_bit(word, bit)) for bit in range(len(inside))]
    fallback = min(rows.groupby("lang")["total"].first().items(), key=lambda x: (-x[1], x[0]))[0]
    return Filters(languages, slots, np.array(fill) ** _HASHES, fallback)


def predicted(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the text alone.

    `und` and 0 for a text that is null or has no letter, or if nothing was learned. Letters without any
    known trigram give the language with the most text, and 0. Ties go to the first name. The filter, a
    megabyte or a few, goes to each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            grams, bounds = _trigrams(chunk)
            names = np.full(len(chunk), "und", object)
            score = np.zeros(len(chunk))
            if filters is not None:
                best, score = filters.decide(grams, bounds)
                lettered = np.diff(bounds) > 0
                labels = np.array([*filters.languages, filters.fallback], object)
                names[lettered] = labels[best[lettered]]
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
