"""Vectorised polynomial hashes over bytes, shared by the operators that fingerprint text.

Two polynomials at different points, modulo the prime 2**31 - 1, make one hash of 62 bits.  A prefix
hash ``P[i] = sum(c[j] * B**j for j < i)`` gives the hash of any slice as ``(P[e] - P[s]) * B**-s``.
The sums themselves are not reduced: their terms are below 2**32, and a text has fewer than 2**31
bytes.  (Modulo 2**64 every base would do without a reduction, but there all bases take the
Thue-Morse words for their complements.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = (1 << 31) - 1
BASES, OTHERS = (1_390_208_809, 794_501_293), (1_043_618_065, 211_540_867)
#: Multiplies what is mixed; odd.
MULTIPLIER = 0x9E3779B97F4A7C15
#: Powers that a worker keeps; longer texts make their own and forget them.
KEPT = 1 << 20

_values = np.random.Generator(np.random.PCG64(31)).integers(1, PRIME, 256, dtype=np.uint64)
_kept: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x < 2**63, by its bits."""
    m = np.uint64(PRIME)
    x = (x & m) + (x >> np.uint64(31))
    x = (x & m) + (x >> np.uint64(31))
    x[x == m] = 0
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo PRIME for i in 0..n-1."""
    have = _kept.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), PRIME))
        have = np.concatenate([have, reduced(have * step)])
    if len(have) <= KEPT:
        _kept[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, PRIME)


def prefix(data: np.ndarray, bases: tuple[int, int] = BASES) -> np.ndarray:
    """Prefix sums of a byte array for both bases, one more than its length."""
    out = np.zeros((len(bases), len(data) + 1), dtype=np.uint64)
    m = np.uint64(PRIME)
    values = _values[data]
    for k, base in enumerate(bases):
        x = values * powers(base, len(data))
        np.cumsum((x & m) + (x >> np.uint64(31)), out=out[k, 1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits depend on the whole value."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray, bases: tuple[int, int] = BASES) -> np.ndarray:
    """Mixed hashes of the slices start..end-1, which also depend on their lengths."""
    h = np.zeros(len(start), dtype=np.uint64)
    for k, base in enumerate(bases):
        down = powers(inverse(base), p.shape[1])
        h = (h << np.uint64(31)) | reduced(reduced(p[k][end] - p[k][start]) * down[start])
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(p: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of every window of ``width`` bytes."""
    n = p.shape[1] - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k, base in enumerate(BASES):
        h = (h << np.uint64(31)) | reduced(reduced(p[k, width:] - p[k, :n]) * powers(inverse(base), n))
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by doubling."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Neighbouring values of a binary column, about ``size`` bytes at a time and without copies.

    Yields the number of the first value, their bytes one after the other, and len + 1 borders.
    """
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
