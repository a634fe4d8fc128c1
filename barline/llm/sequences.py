"""Vectorised token sequences for Arrow batches of texts.

Spark partitions the documents; inside a task these helpers turn a batch of texts
into flat numpy arrays (one entry per byte or per word), hash fixed-length windows
with a two-lane polynomial hash, and pick locally consistent anchor windows.
A word is a maximal run of bytes outside space and \\t\\n\\v\\f\\r. Null text: no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 250_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
NO_HASH = np.uint64(0)
_rng = np.random.default_rng(20240131)
_TABLES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64 (or of its inverse)."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = np.full(size, _P_INV if inverse else _P, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size <= 16 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads polynomial hashes over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, equal spans hash equal anywhere."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power(n + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    return span_hash(values, starts, starts + k)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows with about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    lengths = np.where(valid, np.diff(offsets), 0)
    if not valid.all() and np.diff(offsets)[~valid].any():
        data = np.concatenate([data[a:b] for a, b, v in zip(offsets[:-1], offsets[1:], valid) if v] or [data[:0]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a chunk: byte spans, two hash lanes, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, lanes: int = 2, latin: bool = False):
        if lower:
            data = _LOWER[data]
        if latin:  # À-Þ of two UTF-8 bytes
            second = np.flatnonzero(data[:-1] == 0xC3) + 1
            second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
            data = data.copy()
            data[second] += 0x20
        self.data = data
        n = len(data)
        inside = ~IS_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        is_start = inside & (~before | first[:n])
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        first[n] = True
        is_end = inside & (~after | first[1 : n + 1])
        self.starts = np.flatnonzero(is_start)
        self.ends = np.flatnonzero(is_end) + 1
        self.row_offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.row_offsets)
        self.lanes = [span_hash(_TABLES[i][data], self.starts, self.ends) for i in range(lanes)]


def byte_lanes(data: np.ndarray) -> list[np.ndarray]:
    return [table[data] for table in _TABLES]


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every window of w values (min or max), by doubling."""
    if len(x) < w:
        return x[:0]
    out, span = x, 1
    while span * 2 <= w:
        out = op(out[: len(out) - span], out[span:])
        span *= 2
    if span < w:
        rest = w - span
        out = op(out[: len(out) - rest], out[rest:])
    return out


def anchors(lane: np.ndarray, row_offsets: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Locally consistent anchors of all windows of `length` tokens.

    Every window of `length` tokens inside one row chooses its k-token sub-window
    of smallest hash (by 32 bits, the leftmost of equal ones), so equal windows
    choose equal anchors at equal offsets. Returns the chosen positions, their
    hashes and the first and last window start that chooses each.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(lane)
    if n < length:
        return none, np.zeros(0, np.uint64), none, none
    h = window_hash(lane, k)
    low = np.uint64(0xFFFFFFFF)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = (sliding(packed, length - k + 1, np.minimum) & low).astype(np.int64)
    m = len(best)
    row_end = np.repeat(row_offsets[1:], np.diff(row_offsets))[:m]
    windows = np.flatnonzero(np.arange(length, m + length) <= row_end)
    if not len(windows):
        return none, np.zeros(0, np.uint64), none, none
    chosen = best[windows]
    change = np.ones(len(windows), dtype=bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(windows)) - 1
    at = chosen[first]
    return at, h[at], windows[first], windows[last]


def token_rows(row_offsets: np.ndarray) -> np.ndarray:
    """Row index of every token."""
    return np.repeat(np.arange(len(row_offsets) - 1), np.diff(row_offsets))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
