"""Word and shingle hashes of whole Arrow text columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
SHINGLE = 5
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


def _byte_values(fold: bool) -> np.ndarray:
    values = constants(256, 11)
    if fold:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


FOLDED, PLAIN = _byte_values(True), _byte_values(False)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about ``most`` bytes: first row, bytes, and offsets of the rows in them.

    Null texts count as empty. A text longer than ``most`` is a slice of its own, whole.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        own = offsets[row:last + 1]
        yield row, data[own[0]:own[-1]], own - own[0]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of ``letters`` in the bytes, and the words' bounds by row: row i has words bounds[i]:bounds[i + 1]."""
    inside = letters[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        edge[1:-1] = inside[1:] & ~inside[:-1]
        edge[0] = inside[0]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        edge[heads] = inside[heads]
    starts = np.flatnonzero(edge[:-1])
    stop = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        stop[1:-1] = inside[:-1] & ~inside[1:]
        stop[-1] = inside[-1]
        tails = offsets[1:][offsets[1:] > 0]
        stop[tails] = inside[tails - 1]
    ends = np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, letters: np.ndarray = IS_WORD) -> np.ndarray:
    """A 64-bit hash of every word; with ``fold``, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    own = data[letters[data]]
    heads = np.cumsum(lengths) - lengths
    places = np.arange(len(own)) - np.repeat(heads, lengths)
    by_place = constants(int(lengths.max()), 23)
    sums = np.add.reduceat((FOLDED if fold else PLAIN)[own] * by_place[places], heads)
    return mix(sums + lengths.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of every run of ``size`` words; a shorter sequence is one run; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    factors = constants(size, 37)
    if n < size:
        return mix((hashes * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total += hashes[i:n - size + 1 + i] * factors[i]
    return mix(total + np.uint64(size))
