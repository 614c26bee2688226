"""Words of whole texts, found and hashed for many texts at once.

A word is a run of bytes other than the six ASCII white-space characters.  Text
arrives as the UTF-8 buffer of an Arrow column; hashes are polynomials over table
values of the bytes modulo 2^64, taken from running sums, and then mixed.  Nothing
here loops over words in Python, and memory is bounded by ``BLOCK`` bytes of text
(or by one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together.
BLOCK = 1 << 21
#: Bytes whose running sums are in memory together.
PIECE = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT)) | np.uint64(1)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _piece_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse modulo 2^64."""
    return _powers(_ROOT, PIECE + 1), _powers(pow(_ROOT, -1, 2**64), PIECE + 1)


class Block:
    """Some whole texts: ``data`` bytes, text ``i`` at ``offsets[i]:offsets[i + 1]``.

    ``begin`` and ``end`` are the places of all words; the words of text ``i`` are
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_WHITE[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
        values, out = _byte_values(lower), np.empty(len(self.begin), np.uint64)
        i = 0
        while i < len(self.begin):
            at = self.begin[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + PIECE, "right")))
            stop = self.end[j - 1]
            up, down = _piece_powers() if stop - at <= PIECE else (_powers(_ROOT, stop - at + 1), _powers(pow(_ROOT, -1, 2**64), stop - at + 1))
            sums = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(values[self.data[at:stop]] * up[: stop - at], out=sums[1:])
            b, e = self.begin[i:j] - at, self.end[i:j] - at
            out[i:j] = (sums[e] - sums[b]) * down[b]
            i = j
        return mix(out)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and the place of each text's first one.

        A text with fewer words, but some, has its whole sequence as the only run.
        """
        words, first = self.hashes(), self.first
        n = np.diff(first)
        counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.uint64)
        factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_ROOT)) | np.uint64(1)
        if len(words) >= size:
            runs = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                runs += words[k : len(words) - size + 1 + k] * factors[k]
            full = np.flatnonzero(n >= size)
            take = np.repeat(first[full] - at[full], counts[full])
            where = take + _ranges(at[full], counts[full])
            out[_ranges(at[full], counts[full])] = runs[where]
        for i in np.flatnonzero((n > 0) & (n < size)):
            run = (words[first[i] : first[i + 1]] * factors[: n[i]]).sum(dtype=np.uint64)
            out[at[i]] = run + np.uint64(size - n[i])
        return mix(out), at


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i] .. begin[i] + counts[i] - 1`` for all ``i``, in turn."""
    ends = np.cumsum(counts)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - counts), counts)


ranges = _ranges


def blocks(texts: pa.Array, most: int = BLOCK, kind: type = Block) -> Iterator[tuple[int, Block]]:
    """The texts of an Arrow column as blocks of a ``kind``, each with the row of its first text; null is empty."""
    texts = texts.cast(pa.large_binary())
    lengths = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    raw = lengths.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(offsets) > 1 and offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        own = offsets[i : j + 1]
        yield i, kind(data[own[0] : own[-1]], own - own[0])
        i = j
