"""Vectorised word and shingle hashes over Arrow text columns.

A batch's texts are read straight from the Arrow buffers in blocks of bounded size. A word's
hash is a 64-bit polynomial over a fixed random table of its bytes, taken from one prefix sum
over the block, then mixed; equal words have equal hashes in every task. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: Word bytes of the contracts: all but space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) <= 4 * BLOCK_BYTES:
            _powers[int(base)] = held
    return held[:n]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes); a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a block: start and end byte, row within the block, and hash; first is each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED, lower: bool = False):
        rows, n = len(offsets) - 1, len(data)
        inside = word_bytes[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        stop[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[LOWER[data] if lower else data] * powers(BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether all k are of one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            out *= STEP
            out += self.hash[j : n - k + 1 + j]
        return mix(out), self.row[: n - k + 1] == self.row[k - 1 :]
