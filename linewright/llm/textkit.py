"""Array helpers shared by the Arrow-side operators.

Every function here works on the raw UTF-8 bytes of an Arrow string column, so a
batch of documents costs a handful of array operations instead of a loop over words.
A null text counts as an empty one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None

#: True for every byte but the ASCII white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    tables = []
    for factor in (_BASE, _INVERSE):
        table = np.full(n + 1, factor, U64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    made = (tables[0], tables[1])
    if n <= 4 << 20:
        _powers = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and, for each row, the number of the first word.

    ``offsets`` begin at 0. Words never run over the end of a row.
    """
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over all bytes."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(hashes: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash for the k words from each word on; the last k - 1 words have none. Other odd steps give other hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= step
        total += hashes[j : j + n]
    return mix(total)


def window_rows(first: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """True where the k words from a word on lie in one row."""
    whole = np.zeros(n_windows, bool)
    counts = np.diff(first)
    fits = counts >= k
    steps = np.zeros(n_windows + 1, np.int32)
    np.add.at(steps, first[:-1][fits], 1)
    np.add.at(steps, first[:-1][fits] + counts[fits] - k + 1, -1)
    whole[:] = np.cumsum(steps[:n_windows]) > 0
    return whole


def runs_to_mask(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for each of n places that [s, s + length) covers for some s."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:n]) > 0
