"""Numpy helpers on the UTF-8 bytes of Arrow string columns.

Words, lines and their hashes are found for many documents at once. A batch is
worked through in pieces of about ``PIECE`` bytes cut between words, so the
temporary arrays stay small however long a document is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes handled at once

U64 = np.uint64


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 4
_TABLES = {seed: _table(seed) for seed in (1, 2)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[0] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of values[start:end] (bytes, or uint64 items); spans may overlap."""
    items = _TABLES[seed][values] if values.dtype == np.uint8 else values
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(items * power[: len(values)], out=sums[1:])
    # the length keeps spans apart that differ by items of hash zero
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return values, offsets[:-1], offsets[1:]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true within the given ranges (ends included)."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # of lower-cased bytes


def pieces(values: np.ndarray, lo: int, hi: int, word: np.ndarray, size: int = PIECE):
    """Cut [lo, hi) after about ``size`` bytes each, never inside a word."""
    while lo < hi:
        cut = min(hi, lo + size)
        while cut < hi:
            ahead = np.flatnonzero(~word[values[cut - 1 : min(hi, cut + 4095)]])
            if len(ahead):
                cut = cut - 1 + int(ahead[0])
                cut = max(cut, lo + 1)
                break
            cut = min(hi, cut + 4096)
        yield lo, cut
        lo = cut


def words_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray = NOT_SPACE, lower: bool = False, seeds: tuple[int, ...] = (1,)):
    """Words of consecutive texts: (word start, word end, hashes by seed, first word of each text and the total).

    ``starts``/``ends`` are the texts' byte ranges, one after the other. A word
    is a maximal run of bytes that ``word`` marks; it never spans two texts.
    """
    if not len(starts) or starts[0] == ends[-1]:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in seeds], np.zeros(len(starts) + 1, np.int64))
    lo, hi = int(starts[0]), int(ends[-1])
    all_s, all_e, all_h = [], [], [[] for _ in seeds]
    for a, b in pieces(values, lo, hi, word):
        v = LOWER[values[a:b]] if lower else values[a:b]
        is_word = word[v]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        i, j = np.searchsorted(starts, [a, b])
        inner = starts[i:j] - a
        begins[inner] = is_word[inner]  # a text begins a new word
        s = np.flatnonzero(begins)
        closes = np.empty(len(v), dtype=bool)
        closes[:-1] = is_word[:-1] & (~is_word[1:] | begins[1:])
        closes[-1] = is_word[-1]
        e = np.flatnonzero(closes) + 1
        for k, seed in enumerate(seeds):
            all_h[k].append(span_hashes(v, s, e, seed))
        all_s.append(s + a)
        all_e.append(e + a)
    s, e = np.concatenate(all_s), np.concatenate(all_e)
    first = np.searchsorted(s, np.append(starts, hi))
    return s, e, [np.concatenate(h) for h in all_h], first


def groups_of(starts: np.ndarray, ends: np.ndarray, size: int = 2 * PIECE):
    """Ranges of rows whose texts together have about ``size`` bytes (one row at least)."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, side="right")))
        yield i, j
        i = j
