"""Texts of Arrow batches as numpy arrays: bytes, words and shingles, hashed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WRAP = dict(over="ignore")
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be divided out again
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(**_WRAP):
            _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(**_WRAP):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial sum of data[i:j] at its place."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(**_WRAP):
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on the place."""
    inverse = powers(_INVERSE, len(sums))
    with np.errstate(**_WRAP):
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def poly_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a byte matrix."""
    with np.errstate(**_WRAP):
        return mix((_BYTE[rows] * powers(_BASE, rows.shape[1])).sum(1))


def slices(column, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most `most` bytes, or one longer row; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all data[start:start+size] one after another, their offsets)."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    at = 0
    while at < len(size):  # an index takes eight times the room of what it fetches
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        index = np.repeat(start[at:to] - offsets[at:to], size[at:to])
        index += np.arange(offsets[at], offsets[to])
        np.take(data, index, out=out[offsets[at] : offsets[to]])
        at = to
    return out, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data] if lower else data
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a row begins
    edge[offsets[:-1][offsets[:-1] < n]] = True
    edge = edge[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    next_edge = np.empty(n, bool)
    next_edge[-1] = True
    next_edge[:-1] = edge[1:]
    end = np.flatnonzero(inside & (~after | next_edge)) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return span_hashes(prefix_sums(data), start, end), row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; fewer words than width are one shingle."""
    words, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    place = powers(0xD1342543DE82EF95, width + 1)
    with np.errstate(**_WRAP):
        m = len(words) - width + 1
        if m > 0:
            s = words[:m] * place[0]
            for k in range(1, width):
                s += words[k : m + k] * place[k]
            s = mix(s)
        out = []
        for r in range(rows):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * place[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
