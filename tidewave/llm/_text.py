"""Vectorised byte work on Arrow string columns: words, word hashes, shingles.

Everything here runs inside one task on one Arrow batch, in slices of a bounded number of
bytes (a single longer text makes a slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 8 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def byte_table(fold_ascii: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold_ascii:
        values[65:91] = values[97:123]
    return values


BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[32, *range(9, 14)]] = False

#: Letters, digits and every byte of a non-ASCII character.
LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_TABLE = byte_table()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is a text of no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [i, j) of at most `limit` bytes each, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in `data`, and each text's first word (one more at the end).

    offsets: where the texts start within `data`, from 0, and the end. A-Z count as a-z.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | border[:n]))
    ends = np.flatnonzero(word & (~after | border[1:]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sums = np.cumsum(_TABLE[data] * _power("up", n))
    hashes = sums[ends]
    hashes[starts > 0] -= sums[starts[starts > 0] - 1]
    hashes *= _power("down", n)[starts]
    hashes = mix(hashes + (ends - starts + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words; fewer words make one shingle of them all; none, none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        total = np.asarray([n], dtype=np.uint64)
        for i in range(n):
            total = mix(total * _BASE + words[i : i + 1])
        return total
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        total = total * _BASE + words[i : n - k + 1 + i]
    return np.unique(mix(total))


def short_shingles(rows: np.ndarray) -> np.ndarray:
    """The hash that shingles() gives each row of words, if a row has fewer than k of them."""
    total = np.full(len(rows), rows.shape[1], dtype=np.uint64)
    for i in range(rows.shape[1]):
        total = mix(total * _BASE + rows[:, i])
    return total


def sequence_key(words: np.ndarray) -> bytes:
    """128 bits that name a sequence of words."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    a = (mix(words + place * _BASE)).sum(dtype=np.uint64)
    b = (mix(words * np.uint64(0xE7037ED1A0B428DB) ^ mix(place))).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()


def texts_in(column: pa.Array, inside: np.ndarray = BLANK_SEPARATED):
    """(row, word hashes) for each text of a column, in order."""
    offsets, data = buffers(column)
    for i, j in slices(offsets):
        lo, hi = offsets[i], offsets[j]
        hashes, first = word_hashes(data[lo:hi], offsets[i : j + 1] - lo, inside)
        for row in range(i, j):
            yield row, hashes[first[row - i] : first[row - i + 1]]
