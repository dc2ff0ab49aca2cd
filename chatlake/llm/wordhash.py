"""Words of whole texts and their 64-bit hashes, one vectorised pass over a slice of rows.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return, so offsets and hashes come straight from the
UTF-8 bytes Arrow delivers; no string object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Text bytes handled at once; a single longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MULTIPLIERS[0]
    x ^= x >> np.uint64(27)
    x *= _MULTIPLIERS[1]
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` text bytes at most, or one row."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the row offsets in them; NULL is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the texts of a column: byte spans, row bounds and hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.rows = text_bytes(column)
        size = len(self.data)
        space = _SPACE[self.data]
        edges = self.rows[:-1][self.rows[:-1] < size]
        before = np.ones(size, bool)
        before[1:] = space[:-1]
        before[edges] = True
        after = np.ones(size, bool)
        after[:-1] = space[1:]
        after[edges[edges > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        # Word bounds of row i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, self.rows)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word, of its ASCII-lower-cased bytes if asked.

        Any ``seed`` but 0 takes a hash of another kind, word by word: slower, for words that collide in the first.
        """
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = _LOWER[self.data] if lower else self.data
        if seed:
            return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(self.starts, self.ends)),
                               np.uint64, len(self.starts))
        lengths = self.ends - self.starts
        table = powers(_STEP, int(lengths.max()) + 1)
        out = np.empty(len(self.starts), np.uint64)
        cut = 0
        while cut < len(self.starts):
            # Bounded pieces, as the eight-byte values of a very long text would not be.
            stop = max(cut + 1, int(np.searchsorted(self.ends, self.starts[cut] + SLICE_BYTES, "right")))
            begin, end = int(self.starts[cut]), int(self.ends[stop - 1])
            starts = self.starts[cut:stop] - begin
            within = np.arange(end - begin) - np.repeat(starts, np.diff(np.append(starts, end - begin)))
            # White space between words has the value 0, so its place does not matter.
            np.minimum(within, len(table) - 1, out=within)
            out[cut:stop] = np.add.reduceat(_BYTE_VALUE[data[begin:end]] * table[within], starts)
            cut = stop
        return mixed(out + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one sequence of word hashes."""
    count = max(0, len(words) - size + 1)
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mixed(out * _STEP + words[i: i + count])
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As ``shingle_hashes`` for long windows, at a cost that does not grow with ``size``."""
    count = max(0, len(words) - size + 1)
    if not count:
        return np.zeros(0, np.uint64)
    # Highest power first, so that a window's sum is a difference of prefixes times a power.
    inverse = np.uint64(pow(int(_STEP), -1, 2**64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_STEP, len(words)))])
    return mixed((prefix[size:] - prefix[:-size]) * powers(inverse, count))
