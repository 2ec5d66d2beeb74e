"""Hashes of many substrings of a byte buffer at once, in numpy.

A prefix sum of table[byte] * r**i (mod 2**64) gives the hash of any substring from two entries, scaled back by r**-start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RADIX = 0xD1342543DE82EF95
_TABLE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = {"n": 0, "up": np.empty(0, U64), "down": np.empty(0, U64)}
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**0 .. r**(n-1) and their inverses mod 2**64; kept for the next call."""
    if _POWERS["n"] < n:
        n2 = max(n, 1 << 16)
        for name, r in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            a = np.full(n2, r, U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["n"] = n2
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hashes:
    """Hashes of the parts of one buffer of bytes, or of a sequence of 64-bit values (hashes of words)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of a width, by start."""
        m = len(self.sums) - width
        return (self.sums[width:] - self.sums[:m]) * self.down[:m]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and for each text the numbers of its first word and the one after its last."""
    data = LOWER[data]
    solid = ~SPACE[data]
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    some = ends > starts
    before[starts[some]] = False
    after[ends[some] - 1] = False
    a, b = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    words = mix(Hashes(data).of(a, b) + (b - a).astype(U64))
    return words, np.searchsorted(a, starts), np.searchsorted(a, ends)


def words_of(data: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of one text of any length, read in parts that end between words."""
    out, at = [], 0
    while at < len(data):
        end = min(at + part, len(data))
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[end : end + part]])
            end += int(gap[0]) if len(gap) else min(part, len(data) - end)
            if len(gap):
                break
        out.append(word_hashes(data[at:end], np.zeros(1, np.int64), np.array([end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, U64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, by start."""
    out, span = x, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of strings; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of rows whose texts together hold about `size` bytes at most, one row at least."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
