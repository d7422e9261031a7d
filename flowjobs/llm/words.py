"""Words, word hashes and rolling window hashes over Arrow string columns.

Everything works on whole blocks of texts with numpy: a block is the joined
UTF-8 bytes of some rows, so the cost per word is a few array operations and
not a Python call. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words split at ASCII white space
SPACED = ~_SPACE
#: bytes of words of letters and digits; every byte of a non-ASCII character counts
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_UNDO = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x ^ (x >> U64(32))
    x = x * _UNDO
    x = x ^ (x >> U64(32))
    x = x * _UNDO
    return x ^ (x >> U64(32))


@dataclass
class Block:
    """Rows ``first_row`` up to ``last_row`` of a batch, as bytes."""

    first_row: int
    last_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.last_row - self.first_row

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


@dataclass
class Words:
    """Word i is data[start[i]:end[i]]; row r has words first[r] up to first[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split a string column into blocks of about ``limit`` bytes; a longer text is its own block. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        last = min(last, n)
        yield Block(row, last, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row])
        row = last


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in ``inside``; a run never crosses a row."""
    here = inside[data]
    if not len(here):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    before = np.empty_like(here)
    before[0] = False
    before[1:] = here[:-1]
    after = np.empty_like(here)
    after[-1] = False
    after[:-1] = here[1:]
    inner = offsets[(offsets > 0) & (offsets < len(here))]
    before[inner] = False
    after[inner - 1] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


#: a longer range is hashed by blake2b, one by one
_LONG = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


class Hasher:
    """Hashes of byte ranges of a block, eight bytes at a time.

    Each step is a bijection of what was read before and of the next eight bytes,
    so ranges of one length up to eight bytes never meet, and longer ones meet by
    chance alone: no arrangement of letters cancels out, as it can in a polynomial.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix(size.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(0x9E3779B97F4A7C15))
        at, left, open_ = start, size, None
        long = size > _LONG
        if long.any():
            for i in np.flatnonzero(long):
                h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
            open_ = np.flatnonzero(~long)
            at, left = at[open_], left[open_]
        while len(at):
            now = mix((h if open_ is None else h[open_]) ^ (self.eight[at] & _TAIL[np.minimum(left, 8)]))
            if open_ is None:
                h = now
                open_ = np.arange(len(h))
            else:
                h[open_] = now
            more = left > 8
            open_, at, left = open_[more], at[more] + 8, left[more] - 8
        return h


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return Hasher(data).ranges(words.start, words.end)


class Sequences:
    """Hashes of any runs of words.

    Runs of 1, 2, 4, ... words are hashed by pairs; any other run is the two such
    runs that cover it from its start and from its end, with its length.
    """

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(_pair(below[:-half], below[half:]) if len(below) > half else below[:0])
        return self.levels[k]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.zeros(len(start), U64)
        if not len(start):
            return out
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for k in np.unique(level):
            mine = slice(None) if (level == level[0]).all() else np.flatnonzero(level == k)
            at, n, h = start[mine], size[mine], self._level(int(k))
            some = np.minimum(n, 1)
            out[mine] = mix(_pair(h[at * some], h[(at + n - (1 << int(k))) * some]) + n.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return (a ^ (a >> U64(32))) + (b ^ (b >> U64(31))) * U64(0x94D049BB133111EB)


def window_starts(words: Words, size: int) -> np.ndarray:
    """First words of all runs of ``size`` words that lie within one row."""
    n = len(words.start)
    if n < size:
        return np.zeros(0, np.int64)
    row = words.row
    return np.flatnonzero(row[: n - size + 1] == row[size - 1 :])


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words within one row."""
    at = window_starts(words, size)
    return at, Sequences(hashes).ranges(at, at + size)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
