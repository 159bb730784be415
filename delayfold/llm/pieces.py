"""Texts cut into the pieces that a byte-level tokenizer encodes one by one.

Both vocabularies split alike, by this pattern (fixed; `\\s` is the Unicode property White_Space):

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A piece's ids do not depend on the text around it, so a task encodes each distinct piece once and
looks up the rest. The lookup holds a bounded number of pieces; which ones changes nothing but time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from delayfold.llm import arrays

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
_WHITE_SPACE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_kinds: np.ndarray | None = None  # of the code points seen so far; made where it is used, as globals travel


def _kind(code: int) -> int:
    if code in _WHITE_SPACE:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)


def _kind_table() -> np.ndarray:
    global _kinds
    if _kinds is None:
        _kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        _kinds[:0x80] = [_kind(c) for c in range(0x80)]
    return _kinds


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    table = _kind_table()
    unknown = table[codes] == _UNKNOWN
    if unknown.any():
        for code in np.unique(codes[unknown]).tolist():
            table[code] = _kind(code)
    return table[codes]


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start, and the end of the data.

    Works on bytes: those of a character share its kind, and only beyond ASCII are characters decoded.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kind = _kind_table()[data]
    beyond = np.flatnonzero(data & 0x80)
    if len(beyond):
        raw = data[beyond]
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = (raw & 0xC0) != 0x80
        kind[beyond] = _kinds_of(codes)[np.cumsum(leads) - 1]
    first = np.zeros(n + 4, bool)  # of a text; beyond the end counts as a text of its own
    first[offsets] = True
    first[n:] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (data[:-1] == 0x20) & ~first[1:n]
    last_of_space = space.copy()
    last_of_space[:-1] &= ~space[1:]
    last_of_space &= ~first[1 : n + 1]
    if len(beyond):  # from the last byte of a character to its first one
        moved = beyond[last_of_space[beyond]]
        last_of_space[moved] = False
        lead = beyond[leads]
        last_of_space[lead[np.searchsorted(lead, moved, side="right") - 1]] = True
    start = np.zeros(n + 3, bool)
    start[:n] = (run & (space | ~after_blank)) | last_of_space
    # Contractions: an apostrophe that starts a piece, and one or two given letters.
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    mark = np.flatnonzero((data == ord("'")) & start[:n])
    one, two = padded[mark + 1], padded[mark + 2]
    inside, inside_two = ~first[mark + 1], ~first[mark + 1] & ~first[mark + 2]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside_two & (
        ((one == ord("r")) & (two == ord("e")))
        | ((one == ord("v")) & (two == ord("e")))
        | ((one == ord("l")) & (two == ord("l")))
    )
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    return np.append(np.flatnonzero(start[:n]), n)


def special_spans(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Where one of the strings lies within a text; of those at one place the longest counts."""
    raw = data.tobytes()
    if not any(s in raw for s in special):
        return []
    pattern = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    spans = [m.span() for m in pattern.finditer(raw)]
    text = np.searchsorted(offsets, [s for s, _ in spans], side="right")
    return [(a, b) for (a, b), t in zip(spans, text) if b <= offsets[t]]


def bounds_around(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...]) -> np.ndarray:
    """`piece_bounds`, with each of the special strings as one piece that ends the text before it."""
    spans = special_spans(data, offsets, special)
    if not spans:
        return piece_bounds(data, offsets)
    edges = np.array(spans)
    cut = piece_bounds(data, np.unique(np.concatenate([offsets, edges.ravel()])))
    at = np.searchsorted(edges[:, 0], cut, side="left") - 1  # the last string that starts before
    inside = (at >= 0) & (cut < edges[at, 1])
    return cut[~inside]


_WORD = 8  # bytes
_WORD_BYTES = np.array([(1 << 8 * i) - 1 for i in range(_WORD + 1)], np.uint64)
_BY_WORDS = 256  # bytes of a piece that are hashed word by word


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none of them 0; equal bytes give equal hashes everywhere. Most pieces
    are a word or two, so a hash takes what a piece has, not sums over all of the data."""
    padded = np.concatenate([data, np.zeros(_WORD, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    hashes = words[starts] & _WORD_BYTES[np.minimum(length, _WORD)]
    hashes = arrays.mix(hashes ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    more, done = np.flatnonzero(length > _WORD), _WORD
    while len(more) and done < _BY_WORDS:
        word = words[starts[more] + done] & _WORD_BYTES[np.minimum(length[more] - done, _WORD)]
        hashes[more] = arrays.mix(hashes[more] ^ word)
        done += _WORD
        more = more[length[more] > done]
    if len(more):
        hashes[more] = arrays.RangeHash(data)(starts[more], ends[more])
    return np.maximum(hashes, np.uint64(1))


_SLOT_BITS = 20


class PieceTable:
    """Distinct pieces seen so far: hash to a range of `values`. Sorted runs, merged when alike in size.

    The first piece that comes to a slot, given by its hash, is found there without a search; frequent
    pieces come early. Only the rest are sorted and searched for.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]], dtype, limit: int = 1_500_000):
        self._encode, self._dtype, self._limit = encode, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self._runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._values = np.zeros(1 << 16, self._dtype)
        self._used = 0
        self._slot_key = np.zeros(1 << _SLOT_BITS, np.uint64)  # 0: free
        self._slot_start = np.zeros(1 << _SLOT_BITS, np.int64)
        self._slot_count = np.zeros(1 << _SLOT_BITS, np.int64)

    def _find(self, keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        missing = np.ones(len(keys), bool)
        for known, where, count in self._runs:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            start[hit], length[hit] = where[at[hit]], count[at[hit]]
            missing &= ~hit
        return np.flatnonzero(missing)

    def _add(self, keys: np.ndarray, encoded: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, encoded), np.int64, len(encoded))
        where = self._used + np.cumsum(count) - count
        need = self._used + int(count.sum())
        if need > len(self._values):
            grown = np.zeros(max(need, 2 * len(self._values)), self._dtype)
            grown[: self._used] = self._values[: self._used]
            self._values = grown
        if isinstance(encoded[0], np.ndarray):
            self._values[self._used : need] = np.concatenate(encoded)
        else:
            self._values[self._used : need] = np.fromiter(chain.from_iterable(encoded), self._dtype, int(count.sum()))
        self._used = need
        self._runs.append((keys, where, count))
        while len(self._runs) > 1 and 2 * len(self._runs[-1][0]) > len(self._runs[-2][0]):
            both = [np.concatenate(pair) for pair in zip(self._runs.pop(), self._runs.pop())]
            order = np.argsort(both[0])
            self._runs.append(tuple(x[order] for x in both))
        return where, count

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _search(
        self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, rest: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Range and count of the pieces numbered `rest`; new ones are encoded."""
        keys, place, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        place = rest[place]
        start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        missing = self._find(keys, start, length)
        if len(missing):
            raw, low, high = data.tobytes(), bounds[place[missing]], bounds[place[missing] + 1]
            encoded = self._encode([raw[a:b] for a, b in zip(low.tolist(), high.tolist())])
            start[missing], length[missing] = self._add(keys[missing], encoded)
        # Of the keys for one free slot, the first.
        slot, first = np.unique(self._slot(keys), return_index=True)
        free = self._slot_key[slot] == 0
        slot, first = slot[free], first[free]
        self._slot_key[slot], self._slot_start[slot], self._slot_count[slot] = keys[first], start[first], length[first]
        return start[which], length[which]

    def lookup(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all pieces in text order, and how many each piece has."""
        if len(bounds) < 2:
            return np.zeros(0, self._dtype), np.zeros(0, np.int64)
        if sum(len(r[0]) for r in self._runs) > self._limit:
            self._clear()
        hashes = piece_hashes(data, bounds[:-1], bounds[1:])
        slot = self._slot(hashes)
        start, counts = self._slot_start[slot], self._slot_count[slot]
        rest = np.flatnonzero(self._slot_key[slot] != hashes)
        if len(rest):
            start[rest], counts[rest] = self._search(data, bounds, hashes, rest)
        total = np.cumsum(counts)
        at = np.repeat(start - (total - counts), counts)
        at += np.arange(len(at))
        return self._values[at], counts


def text_counts(offsets: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bounds of each text's values, given each piece's count."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[np.searchsorted(bounds, offsets)]
