"""Whole-batch byte scans with numpy: split UTF-8 text into segments and hash each segment without a Python loop per word.

A batch is worked off in slices of about SLICE bytes, always whole documents, so memory stays bounded by the slice and by the
longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_MULTIPLIER = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the splitmix64 one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * _ODD + U64(seed)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**0..n-1 and the inverses modulo 2**64, kept and grown by doubling."""
    size = 1 << max(16, (n - 1).bit_length())
    have = _powers.get(0)
    if have is None or len(have[0]) < size:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        out = []
        for base in (_MULTIPLIER, inverse):
            p = np.empty(size, dtype=U64)
            p[0] = 1
            done = 1
            while done < size:
                step = U64(pow(base, done, 1 << 64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            out.append(p)
        _powers[0] = have = (out[0], out[1])
    return have


def hash_segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-aware hash of each segment of 64-bit values; segments run from a start to the next one. Zeros don't count."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    up, down = powers(len(values))
    sums = np.add.reduceat(values * up[: len(values)], starts)
    return mix(sums * down[starts])


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into the bytes) for runs of rows of about SLICE bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTES = random_table(256, 11)
_WORD_BYTES[_SPACES] = 0
_WORD_BYTES_LOWER = _WORD_BYTES[_LOWER]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice in order, and how many words each row has."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.empty(0, dtype=U64), np.zeros(rows, dtype=np.int64)
    ink = ~_SPACES[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(raw)]
    begins[heads] = ink[heads]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    table = _WORD_BYTES_LOWER if lower else _WORD_BYTES
    return hash_segments(table[raw], starts), counts
