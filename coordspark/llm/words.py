"""Words of whole Arrow columns in numpy: bounds and hashes for all texts of a batch at once.

Hashes are polynomials over prefix sums in whole numbers modulo 2^64: with an odd base B, the sum of x[j] * B^(s - j) over
a range from s on is the difference of two prefix sums times B^s, so every range of bytes or words is hashed by two look-ups.
They are mixed afterwards, and serve as keys: callers verify what they find against the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd bases: one for keys, the other for an independent check of them.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: True for the bytes of words between white space.
NOT_SPACE = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = tuple(np.full(size, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for x in known:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if size <= SLICE_BYTES:
            _powers[base] = known
    return known[0][:n], known[1][:n]


def prefix_sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * powers(len(x), base)[1], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums), base)[0][start]


def gram_hashes(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of k words."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return mixed(range_hashes(prefix_sums(hashes, base), at, at + k, base) + np.uint64(k))


@dataclass
class Texts:
    """Texts one after another: their bytes, and where each begins (with the end of the last)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def raw_texts(column: pa.Array) -> Texts:
    """The UTF-8 bytes of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return Texts(held[at[0] : at[-1]], at - at[0])


def text_slices(batches: Iterator[pa.RecordBatch], at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (column ``at``) have about ``size`` bytes; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = raw_texts(batch.column(at)).offsets[1:]
        first = 0
        while first < batch.num_rows:
            begun = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begun + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of texts: the text's number, and the bytes from ``start`` up to ``end`` of all the data."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.row)


def words_in(texts: Texts, is_word: np.ndarray = NOT_SPACE) -> Words:
    """The maximal runs of word bytes of each text."""
    inside = is_word[texts.data]
    borders = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]
    before, after = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[borders] = False
    after[borders - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(np.searchsorted(texts.offsets, start, side="right") - 1, start, end)


def word_hashes(texts: Texts, words: Words, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each word's bytes; works through the bytes in stretches, so that prefix sums stay small."""
    out, done = np.empty(len(words), dtype=np.uint64), 0
    while done < len(words):
        origin = int(words.start[done])
        last = max(done + 1, int(np.searchsorted(words.end, origin + SLICE_BYTES // 4, side="right")))
        a, b = words.start[done:last] - origin, words.end[done:last] - origin
        sums = prefix_sums(texts.data[origin : origin + int(b[-1])].astype(np.uint64) + np.uint64(1), base)
        out[done:last] = mixed(range_hashes(sums, a, b, base) + (b - a).astype(np.uint64))
        done = last
    return out
