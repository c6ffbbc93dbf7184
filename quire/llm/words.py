"""Words and word hashes of Arrow string columns, computed for whole batches at once.

A word is a maximal run of bytes outside space and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``.
All functions see whole texts; a batch is worked through in blocks of rows so that memory
follows the block size, or the longest single text where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
#: Blocks of steps that hold many numbers a byte or a word at once and gain nothing by larger ones.
SMALL_BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they were needed."""

    def __init__(self, base: np.uint64):
        self.base = int(base)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._series(b, n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        a = np.full(n, np.uint64(base), np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of each hash."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and the byte offsets of each row."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words of a block: byte range of each, and where each row's words begin (one more entry than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole rows of about ``most`` bytes. Null rows are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for a in chunks:
        n = len(a)
        if a.null_count:
            a = a.fill_null("")
        if n:
            kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
            _, off, data = a.buffers()
            offsets = np.frombuffer(off, kind)[a.offset : a.offset + n + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
                yield Block(base + lo, base + hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lo = hi
        base += n


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def split(block: Block, is_word: np.ndarray | None = None, cuts: np.ndarray | None = None) -> Words:
    """The words of each row. ``is_word`` marks word bytes where the default class does not serve; at ``cuts`` a new word begins."""
    d, n = block.data, len(block.data)
    if is_word is None:
        is_word = ~((d == 32) | ((d >= 9) & (d <= 13)))
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    edge = block.offsets[:-1]
    begins = is_word & ~before[:-1]
    cut = edge[edge < n]
    begins[cut] = is_word[cut]
    if cuts is not None:
        cuts = cuts[cuts < n]
        begins[cuts] = is_word[cuts]
    ends = np.zeros(n + 1, bool)
    ends[1:] = is_word
    ends[:-1] &= ~is_word | begins
    starts = np.flatnonzero(begins)
    ends_at = np.flatnonzero(ends)
    return Words(starts, ends_at, np.searchsorted(starts, block.offsets))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(h + (words.ends - words.starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` consecutive hashes, whatever rows they lie in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` runs of ``size`` words lie within one row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:n] == row[size - 1 : size - 1 + n]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
