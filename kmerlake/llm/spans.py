"""Word spans and 64-bit word hashes over whole Arrow text columns, in numpy.

A column is seen as one byte array with row offsets. Rows are taken in runs of a
few MB, so memory does not grow with a batch; a row longer than a run is a run of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: digits, lower-case letters, all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of a word that only white space ends.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_RADIX = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers(radix: int, n: int) -> np.ndarray:
    """radix ** 0 .. radix ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(radix)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), radix, dtype=np.uint64)
        have[0] = 1
        have = _powers[radix] = np.multiply.accumulate(have)
    return have[:n]


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's first word (one entry more than rows).

    member says which bytes belong to words. A word never crosses a row.
    """
    inside = member[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    begin[offsets[:-1][some]] = inside[offsets[:-1][some]]
    last = offsets[1:][some] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, inverse = 0, pow(_RADIX, -1, 2**64)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        low = starts[i]
        part = data[low : ends[j - 1]]
        summed = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * powers(_RADIX, len(part)), out=summed[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        found = (summed[b] - summed[a]) * powers(inverse, len(part) + 1)[a]
        out[i:j] = mix(found + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive word hashes, by the first one's place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total *= np.uint64(0x9FB21C651E98DF25)
        total += hashes[k : k + n]
    return mix(total)
