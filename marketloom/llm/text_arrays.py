"""Whole columns of texts as arrays of word hashes.

The functions take Arrow string columns and work on their byte buffers, so no
Python string is made per word.  Words are the maximal runs of bytes other
than space and U+0009-U+000D, with A-Z lower-cased; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: every ASCII byte that is no letter or digit
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes() -> np.ndarray:
    """A random-looking 64-bit code per byte value."""
    return mix((np.arange(256, dtype=U64) + U64(1)) * GOLD)


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
LONG = 64
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)  # masks of the first k of eight bytes


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, SEGMENT + 1), dtype=U64)
        have[1:] = U64(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of the ``width`` bytes from every place on, for choosing places only.

    Equal strings have equal hashes.  The converse does not hold for certain
    long strings, so nothing is taken for equal by this hash.
    """
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(byte_codes()[data] * powers(_BASE, len(data)), out=sums[1:])
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE, n) + U64(width))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of ``data``, equal for equal contents.

    Eight bytes at a time go through ``mix``, which is one to one, so ranges of
    up to eight bytes have the same hash only if they are equal or differ in
    length; those over LONG bytes are hashed one by one.
    """
    size = end - start
    eight = _eights(data)
    out = mix(size.astype(U64) * GOLD)
    out = mix(out ^ (eight[start] & _FIRST[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] * U64(3) ^ (eight[start[live] + at] & _FIRST[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        spans = zip(start[long].tolist(), end[long].tolist(), strict=True)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans), dtype=U64, count=len(long))
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, dtype=np.uint8))), strides=(1,))


def same_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range [start, end) of ``data`` are those of the range [low, high) of ``other``."""
    size = end - start
    out = size == high - low
    x = _eights(data)
    y = x if other is data else _eights(other)
    live, at = np.flatnonzero(out & (size <= LONG) & ((start != low) | (other is not data))), 0
    while len(live):
        left = size[live] - at
        differ = (x[start[live] + at] ^ y[low[live] + at]) & _FIRST[np.clip(left, 0, 8)]
        out[live[differ != 0]] = False
        live, at = live[(differ == 0) & (left > 8)], at + 8
    for i in np.flatnonzero(out & (size > LONG)):
        out[i] = np.array_equal(data[start[i] : end[i]], other[low[i] : high[i]])
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; the texts lie side by side, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None:
        return np.empty(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _segments(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at text starts or gaps between words, about SEGMENT bytes apart; words stay whole."""
    low, n = 0, len(data)
    while low < n:
        high = min(low + SEGMENT, n)
        while high < n:
            starts = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "right")]
            if len(starts) and starts[-1] > low:
                high = int(starts[-1])
                break
            gaps = np.flatnonzero(gap[data[low + 1 : high]])
            if len(gaps):
                high = low + 1 + int(gaps[-1])
                break
            high = min(high + SEGMENT, n)
        yield low, high
        low = high


@dataclass(frozen=True)
class Words:
    """All words of a column: hashes, byte ranges in ``data``, and words before each text."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def word_table(
    column: pa.Array | pa.ChunkedArray,
    gap: np.ndarray = SPACE,
    fold_case: bool = True,
    split: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Words:
    """Words of every text of the column.

    ``gap`` tells which byte values separate words; ``split`` may mark further
    bytes (of the array it gets) before which a word ends and another starts.
    """
    data, offsets = utf8(column)
    hashes, starts, ends = [np.empty(0, dtype=U64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    with np.errstate(over="ignore"):
        for low, high in _segments(data, offsets, gap):
            part = data[low:high]
            inside = ~gap[part]
            cut = np.ones(len(part) + 1, dtype=bool)  # a word cannot run over this place
            cut[1:-1] = ~inside[:-1]
            cut[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
            if split is not None:
                cut[:-1] |= split(part)
            last = inside.copy()
            last[:-1] &= ~inside[1:] | cut[1:-1]
            start, end = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(last) + 1
            hashes.append(range_hashes(folded(part) if fold_case else part, start, end))
            starts.append(start + low)
            ends.append(end + low)
    start = np.concatenate(starts)
    return Words(data, np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def word_hashes(column: pa.Array | pa.ChunkedArray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, for each text the number of words before it, and the total)."""
    words = word_table(column, gap)
    return words.hashes, words.at


def text_slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows in order, in slices of about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's ``size``-word shingles in order; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=U64)
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * U64(3) + hashes[i : n - width + 1 + i] + GOLD)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
