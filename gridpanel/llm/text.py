"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a Python object per word.

Texts are taken as the UTF-8 bytes of an Arrow string column. A byte table maps separators to
0 and every other byte to what is hashed, so lower-casing A-Z and cutting words is one lookup.
Work goes in pieces of about 128 KB, cut between words, so a batch or a very long text
needs memory for its words and not for several copies of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(is_word) -> np.ndarray:
    lower = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    # 0xFF never occurs in UTF-8 and stands for the character U+0000.
    return np.array([(c or 0xFF) if is_word(c) else 0 for c in lower], dtype=np.uint8)


#: Words are runs of anything but U+0020 and U+0009 to U+000D.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of digits, letters a-z and everything beyond U+007F.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of several texts: byte ranges, hashes, and each text's range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, text: int) -> slice:
        return slice(self.first[text], self.first[text + 1])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end before a separator."""
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):
            gaps = np.flatnonzero(table[data[to : to + PIECE]] == 0)
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(to + PIECE, len(data))
        yield at, to
        at = to


def unspaced(data: np.ndarray) -> np.ndarray | None:
    """Length in bytes of each character of a script without blanks, at its first byte, 0 elsewhere; None without any.

    Han, kana and their punctuation, full- and half-width forms, Thai, Lao, Tibetan, Burmese and Khmer.
    """
    if not len(data) or data.max() < 0xE0:
        return None
    second = np.append(data[1:], np.uint8(0))
    among = lambda lo, hi: (second >= lo) & (second <= hi)
    three = (data >= 0xE3) & (data <= 0xE9)
    three |= (data == 0xE0) & (second >= 0xB8)
    three |= (data == 0xE1) & (among(0x80, 0x82) | among(0x9E, 0x9F))
    three |= (data == 0xEF) & (among(0xA4, 0xAB) | among(0xBC, 0xBE))
    four = (data == 0xF0) & among(0xA0, 0xB3)
    size = 3 * three.astype(np.uint8) + 4 * four.astype(np.uint8)
    return size if size.any() else None


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, alone: np.ndarray | None = None) -> Words:
    """All words of texts that lie one after another in `data`.

    Where `alone` is the length of a character, that character is a word.
    """
    starts, ends, hashes = [], [], []
    inverse = pow(_BASE, -1, 1 << 64)
    for at, to in _pieces(data, table):
        codes = table[data[at:to]]
        inside = codes != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, (at, to))
        cuts = offsets[lo:hi] - at
        begin[cuts] = inside[cuts]  # a text begins a word even right behind another text
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = inside[cuts]
        if alone is not None:
            own = np.flatnonzero(alone[at:to])
            begin[own] = True
            behind = own + alone[at:to][own]
            last[behind - 1] = True
            behind = behind[behind < len(codes)]
            begin[behind] = inside[behind]
            before = own[own > 0] - 1
            last[before] = inside[before]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        n = len(codes)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes.astype(np.uint64) * powers(max(n, PIECE), _BASE)[:n], out=sums[1:])
        raw = (sums[e] - sums[s]) * powers(max(n, PIECE), inverse)[s]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix(raw + (e - s).astype(np.uint64)))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, found, np.searchsorted(start, offsets))


@lru_cache(maxsize=64)
def factor(k: int) -> np.uint64:
    """An odd number for place k; those of different places have no simple relation."""
    return mix(np.array([(k + 1) * _BASE & _MASK], dtype=np.uint64))[0] | np.uint64(1)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, at the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out += hashes[k : n + k] * factor(k)
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(hashes, min(size, len(hashes))))


def groups_of_texts(offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of a single longer text."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(to, at + 1)
        yield at, to
        at = to


def lots(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts hold at most `most` bytes, or a single longer text."""
    for at, to in groups_of_texts(column_bytes(batch.column(column))[1], most):
        yield batch.slice(at, to - at)


def nested(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
