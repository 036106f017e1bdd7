"""Word hashing over Arrow string buffers, in numpy: no Python object for a word.

A hash is a polynomial in 64-bit arithmetic over random byte values, taken from prefix
sums, so that any span of bytes costs two look-ups; ``mix`` then spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_SPACES = [0x20, *range(0x09, 0x0E)]
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _table(lower: bool) -> np.ndarray:
    v = _VALUES.copy()
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


LOWER = _table(True)
SPACE = np.zeros(256, bool)
SPACE[_SPACES] = True
#: Everything but letters, digits and bytes of other alphabets parts words.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_pow = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_B, _INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _pow[i] = np.cumprod(p, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Chunk:
    """Some whole documents: their bytes, and ``bounds[i]:bounds[i+1]`` for each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1

    def prefix(self, values: np.ndarray = LOWER) -> np.ndarray:
        p, _ = _powers(len(self.data) + 1)
        s = np.zeros(len(self.data) + 1, U)
        np.cumsum(values[self.data] * p[:-1], out=s[1:])
        return s

    def spans(self, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' starts and ends in bytes, and ``at``: document i has words at[i]:at[i+1]."""
        word = np.zeros(len(self.data) + 2, bool)
        word[1:-1] = ~gap[self.data]
        here, before = word[1:], word[:-1]
        starts, ends = here & ~before, ~here & before
        inner = self.bounds[1:-1]
        cut = inner[(inner > 0) & (inner < len(self.data))]
        cut = cut[word[cut] & word[cut + 1]]  # two documents meet without a space
        starts[cut] = True
        ends[cut] = True
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        return s, e, np.searchsorted(s, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
        s = self.prefix(values)
        _, inv = _powers(len(self.data) + 1)
        return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(U))


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Chunk]:
    """Whole documents of an Arrow string column, about a MB at a time; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, len(column))
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by the place of its first word."""
    if len(words) < n:
        return np.zeros(0, U)
    out = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        out = out * U(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k]
    return mix(out)


def document_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The shingles of one document in order: a shorter one is a single shingle."""
    return shingle_hashes(words, min(n, len(words))) if len(words) else np.zeros(0, U)
