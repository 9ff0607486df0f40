"""Word and window hashing over Arrow text columns, vectorised with NumPy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are walked in blocks of a few
MB, so memory does not follow the batch or the length of a text's words; nulls count as empty.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK_BYTES, SCAN_BYTES, POWER_STEP = 2 << 20, 512 << 10, 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if pa.types.is_null(column.type):
        column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    wide = np.int64 if kind == pa.large_binary() else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), ends


def byte_runs(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of consecutive documents: document i has words first[i]:first[i + 1]."""

    rows: slice
    data: np.ndarray
    doc_bytes: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of `size` words that lies within one document."""
        return self.window_hashes(size)[at := self.window_starts(size)], at

    def window_starts(self, size: int) -> np.ndarray:
        return np.flatnonzero(np.arange(len(self.hashes)) + size <= np.repeat(self.first[1:], self.counts))

    def window_hashes(self, size: int) -> np.ndarray:
        """At each word, the hash of the run of `size` words from it; runs that leave the document mean nothing."""
        total = np.zeros(len(self.hashes), np.uint64)
        factor = 1
        for j in range(min(size, len(self.hashes))):
            total[: len(total) - j] += self.hashes[j:] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        return mix(total)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value a word, by document."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.first])


def _hash_block(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """breaks: positions at which a new document begins."""
    word = ~SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]])
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends


def _hash_all(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            back = np.flatnonzero(SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word longer than a block
                ahead = 0
                while end < len(data) and not ahead:
                    found = np.flatnonzero(SPACE[data[end : end + BLOCK_BYTES]])
                    ahead, end = len(found), end + (int(found[0]) if len(found) else min(BLOCK_BYTES, len(data) - end))
        lo, hi = np.searchsorted(breaks, [at, end])
        h, s, e = _hash_block(data[at:end], breaks[lo:hi] - at, lower)
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(column: pa.Array, lower: bool = False, size: int = 2 * BLOCK_BYTES) -> Iterator[Words]:
    """Walk a text column in runs of whole documents of about `size` bytes (a longer document alone).

    Memory goes with `size`, and a worker keeps much of what it once took: SCAN_BYTES do where documents are independent.
    """
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        breaks = np.unique(own[:-1])
        hashes, starts, ends = _hash_all(part, breaks[breaks < len(part)], lower)
        yield Words(slice(row, end), part, own, hashes, starts, ends, np.searchsorted(starts, own))
        row = end


def word_hash(word: str) -> np.uint64:
    """The hash that `blocks` gives to this word."""
    return next(blocks(pa.array([word]))).hashes[0]
