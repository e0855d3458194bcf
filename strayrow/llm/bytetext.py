"""Whole texts as byte buffers inside a task: slices of bounded size, words, hashes, distinct words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Fixed so that every task of every run hashes alike.
_SEED = np.random.default_rng(20_240_501)
_BYTE_VALUES = _SEED.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
_POWER_STEP = 1 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _trim = None


def release() -> None:
    """Give memory that nothing uses back to the system: Python workers live on from stage to stage."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, n+1 offsets); a null text has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes and at most ``rows`` rows.

    Memory follows the longest text, not the batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffer(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), start + (rows or batch.num_rows), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2^64."""
    base = _BASE_INVERSE if inverse else _BASE
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(-(-n // _POWER_STEP) * _POWER_STEP, _POWER_STEP)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """n+1 prefix sums from which the hash of any range follows."""
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buffer] * powers(len(buffer)), out=sums[1:])
    return sums


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes have equal hashes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buffer: np.ndarray, offsets: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that are no separators; no run crosses a text's end."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(buffer))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, a position of each, number of the distinct value of each position)."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    codes = np.empty(len(ranked), np.int64)
    codes[order] = np.cumsum(new) - 1
    return ranked[new], order[new], codes


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of all ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
