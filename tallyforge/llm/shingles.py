"""Word shingles of Arrow string columns as 64-bit hashes, computed with numpy over whole batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_UNSTEP = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# One random-looking value a byte; A-Z share the values of a-z.
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)
_BYTE[65:91] = _BYTE[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for i, step in enumerate((_STEP, _UNSTEP)):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) in runs of whole rows of about a megabyte."""
    column = column.cast(pa.large_string()) if pa.types.is_large_string(column.type) else column.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _CHUNK_BYTES, "right")) - 1)
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_hashes(raw: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word) of words separated by the bytes in gaps, white space here; A-Z count as a-z."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = gaps[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    row_starts = ends[:-1][ends[:-1] < len(raw)]
    begins[row_starts] = ~space[row_starts]
    stops = ~space
    stops[:-1] &= space[1:]
    row_stops = ends[1:][ends[1:] > 0] - 1
    stops[row_stops] = ~space[row_stops]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, unpower = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    value = (total[stop] - total[start]) * unpower[start]
    rows = np.searchsorted(ends, start, "right") - 1
    return rows, mix(value + (stop - start).astype(np.uint64) * _MULT)


def shingles(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, ordered by row and hash. A row of fewer words has its whole sequence as one."""
    rows, words = word_hashes(raw, ends)
    m = len(words)
    out_rows, out = [], []
    if m >= k:
        acc = words[: m - k + 1].copy()
        for i in range(1, k):
            acc = acc * _STEP + words[i : m - k + 1 + i]
        whole = rows[: m - k + 1] == rows[k - 1 :]
        out_rows.append(rows[: m - k + 1][whole])
        out.append(mix(acc[whole] + np.uint64(k)))
    if m:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        count = np.diff(np.r_[first, m])
        for at, n in zip(first[count < k], count[count < k], strict=True):
            acc = words[at]
            for w in words[at + 1 : at + n]:
                acc = acc * _STEP + w
            out_rows.append(rows[at : at + 1])
            out.append(mix(np.array([acc], np.uint64) + np.uint64(n)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[keep], h[keep]


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) for every row, empty and null ones included."""
    with np.errstate(over="ignore"):
        for first, raw, ends in _chunks(column):
            rows, hashes = shingles(raw, ends, k)
            bounds = np.searchsorted(rows, np.arange(len(ends)))
            for i in range(len(ends) - 1):
                yield first + i, hashes[bounds[i] : bounds[i + 1]]


def set_names(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit names of a shingle set: equal sets have equal names."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big") >> 1, int.from_bytes(digest[8:], "big") >> 1


def set_class(hashes: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """The name of a shingle set: the first, or the second where different sets clash in the first."""
    first, second = set_names(hashes)
    return second if first in clashes else first
