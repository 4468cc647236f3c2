"""Vectorised hashing of byte and word sequences: polynomial (Rabin-Karp) hashes by prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            step = np.full(size, b, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[0] == at[-1]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run without white space inside a row), and each row's first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    inner = offsets[:-1]
    inner = inner[inner < n]
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[i] * BASE**i, from which any slice's polynomial hash follows."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = prefix(BYTE_VALUE[data])
    inverse = powers(len(data))[1]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each run of k values, from :func:`prefix`."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mixed((sums[k:] - sums[:-k]) * powers(n)[1][:n])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(sums: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each window of ``window`` values: the k-gram in it with the least hash.

    ``ends`` gives for each position the end of its row. Equal windows have their anchor
    at the same place, so a window can only repeat where its anchor does. Returns the
    windows' starts (those that fit in a row), their anchors' positions, and all k-gram
    hashes.
    """
    hashes = grams(sums, k)
    n = len(sums) - 1 - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, hashes
    low = np.uint64(32)
    ranked = ((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64)
    best = lowest(ranked, window - k + 1)[:n]
    starts = np.flatnonzero(np.arange(window, n + window) <= ends[:n])
    return starts, (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes
