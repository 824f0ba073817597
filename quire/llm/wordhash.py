"""Word and word-window hashes of a batch of texts, vectorised over its words.

A word's bytes go through a 64-bit finaliser eight at a time (words of more than
LONG_BYTES bytes through BLAKE2b); a window of words is the finaliser over two
windows of a smaller length that cover it. No step is a sum of powers, so words
and windows that differ in an orderly way are as unlike as any others. Two
different ones get the same hash with a chance of about 2**-64; with a second
hash from other constants, where a decision needs it, of 2**-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of words written as [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Texts are handled in runs of about so many bytes, to bound memory.
RUN_BYTES = 1 << 19
LONG_BYTES = 64
#: Constants of the two independent hashes.
_STEP = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(a: np.ndarray, b: np.ndarray, length: int, step: np.uint64 = _STEP[0]) -> np.ndarray:
    """Hashes of windows of ``length`` words, each covered by the two windows a and b."""
    return mix(mix(a + _U(int(step) * length % 2**64)) * step + b)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each on
    step = _STEP[which]
    out = mix(size.astype(np.uint64) * step + _U(which + 1))
    if len(out):
        out = mix((out ^ (eight[start] & _MASK[np.minimum(size, 8)])) * step)
    for done in range(8, LONG_BYTES, 8):
        more = np.flatnonzero(size > done)
        if not len(more):
            break
        out[more] = mix((out[more] ^ (eight[start[more] + done] & _MASK[np.minimum(size[more] - done, 8)])) * step)
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


@dataclass
class Words:
    """Words of a run of texts. ``first[i]:first[i + 1]`` are those of text i."""

    row: int  # of the run's first text in its batch
    count: int  # texts
    data: np.ndarray  # bytes of all texts, in lower case where asked for
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the text are meaningless. which: 0, or 1 for the second hash."""
        own = self.hash if which == 0 else _word_hashes(self.data, self.start, self.end, which)
        if len(own) < k:
            return np.empty(0, np.uint64)
        n = 1
        while 2 * n <= k:
            own = joined(own[:-n], own[n:], 2 * n, _STEP[which])
            n *= 2
        return own if n == k else joined(own[: n - k], own[k - n :], k, _STEP[which])


def last_starts(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each word on lie in one text."""
    ends = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(len(words.hash)) + k <= ends


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, lower: bool = False, separator: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of every text of a string column, some texts at a time."""
    data, offsets = texts_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        own = _LOWER[own] if lower else own
        bounds = offsets[i : j + 1] - offsets[i]
        word = np.zeros(len(own) + 2, bool)
        word[1:-1] = ~separator[own]
        inner = word[1:-1]
        starts, ends = inner & ~word[:-2], inner & ~word[2:]
        edge = bounds[:-1][bounds[:-1] < bounds[1:]]  # non-empty texts begin here
        starts[edge] |= inner[edge]
        last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        ends[last] |= inner[last]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes = _word_hashes(own, start, end, 0)
        yield Words(i, j - i, own, start, end, hashes, np.searchsorted(start, bounds))
        i = j
