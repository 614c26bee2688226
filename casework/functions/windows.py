"""Where in texts one of many short strings may be.

Every window of bytes of a text is hashed (a polynomial modulo 2^64 from running sums) and looked up in a
table of bits of bounded size.  The table lets a window through that is no wanted string
now and then, so an exact step has to follow; it never holds one back.  Only windows let through become
rows, once a text.  UTF-8 windows that begin and end between characters are the substrings of a text.

The bits are set in Spark; only the finished table comes to the driver and goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

#: Bounds of the table (64 MB at most).  Beyond, more windows are let through, and the result stays the same.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Bits for each string: two for itself and two for each of its beginnings.
BITS = 32
#: Bits of one bitmap of ``bitmap_construct_agg``.
SLAB = 32_768
#: Beginnings of these lengths rule out most places for all longer strings at once.
HEADS = (4, 8, 16, 32, 64, 128)

_ROOT = 0x9E3779B97F4A7C15
_OF_LENGTH, _OF_HEAD = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


@dataclass
class Wanted:
    """The table of bits, and the lengths in bytes of the strings in it."""

    bits: Broadcast
    lengths: list[int]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), root & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT)) | np.uint64(1)


class _Sums:
    """Running sums over some bytes, from which any window of them is hashed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, data: np.ndarray) -> _Sums:
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(_ROOT, len(data) + 1), _powers(pow(_ROOT, -1, 2**64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])
        return self

    def window(self, begin: np.ndarray, length) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.down[begin]


def _key(window: np.ndarray, length) -> np.ndarray:
    return _mix(window + np.asarray(length).astype(np.uint64) * _OF_LENGTH)


def _head(window: np.ndarray, length: int) -> np.ndarray:
    return _mix(window + np.array(length, np.uint64) * _OF_HEAD)


def _bits(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word of a key, and its two bits there."""
    return (key >> np.uint64(12)) & np.uint64(words - 1), key & np.uint64(63), (key >> np.uint64(6)) & np.uint64(63)


def _let_through(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    word, one, two = _bits(key, len(table))
    found = table[word.astype(np.int64)]
    return ((found >> one) & (found >> two) & np.uint64(1)).astype(bool)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def with_key(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``key``, the hash of a short text that is not null."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            data, at = _bytes(batch.column(text))
            size = np.diff(at)
            key = _key(sums.of(data[at[0] : at[-1]]).window(at[:-1] - at[0], size), size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=[*batch.schema.names, "key"])

    return rows.mapInArrow(keyed, StructType([*rows.schema.fields, *StructType().add("key", LongType()).fields]))


def wanted(strings: DataFrame, text: str, n: int, lengths: list[int]) -> Wanted:
    """The table of ``n`` short strings with the given lengths in bytes."""
    bits = LEAST_BITS
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            data, at = _bytes(batch.column(text))
            begin, size = at[:-1] - at[0], np.diff(at)
            sums.of(data[at[0] : at[-1]])
            keys = [_key(sums.window(begin, size), size)]
            keys += [_head(sums.window(begin[size >= head], head), head) for head in HEADS]
            word, *two = _bits(np.concatenate(keys), bits // 64)
            place = np.unique(np.concatenate([word * np.uint64(64) + bit for bit in two]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((place // SLAB).astype(np.int32)), pa.array((place % SLAB).astype(np.int32))], names=["slab", "bit"])

    slabs = strings.select(text).mapInArrow(places, "slab INT, bit INT").groupBy("slab").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for row in slabs.toLocalIterator():
        table[row.slab * SLAB // 8 : (row.slab + 1) * SLAB // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return Wanted(strings.sparkSession.sparkContext.broadcast(table.view("<u8")), sorted(lengths))


def candidates(texts: DataFrame, text: str, some: Wanted, chunk: int) -> DataFrame:
    """Other columns of ``texts``, ``key`` and ``around``: the windows that may be wanted strings, those of a text once.

    Two different windows of one text share a key with probability below 10⁻⁹.  ``chunk`` bytes are worked on
    together, and no text is null.
    """
    rest = [f for f in texts.schema.fields if f.name != text]
    bits, lengths = some.bits, np.array(some.lengths, np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, reach = _Sums(), int(lengths.max(initial=0))
        for batch in batches:
            data, at = _bytes(batch.column(text))
            for low in range(int(at[0]), int(at[-1]) if len(lengths) else int(at[0]), chunk):
                seen = data[low : min(low + chunk + reach, int(at[-1]))]
                ends = at[1:] - low
                row, begin, size, key = _windows(seen, min(chunk, len(seen)), ends, lengths, sums.of(seen), bits.value)
                # Copies of a window in its text: one stays.
                order = np.lexsort((row, key))
                row, begin, size, key = row[order], begin[order], size[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                row, begin, size, key = row[new], begin[new], size[new], key[new]
                if not len(row):
                    continue
                offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                taken = seen[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
                around = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(taken)]).cast(pa.string())
                others = [batch.column(f.name).take(pa.array(row)) for f in rest]
                yield pa.RecordBatch.from_arrays([*others, pa.array(key.view(np.int64)), around], names=[*[f.name for f in rest], "key", "around"])

    return texts.mapInArrow(found, StructType([*rest, *StructType().add("key", LongType()).add("around", "string").fields]))


def _windows(data: np.ndarray, n: int, ends: np.ndarray, lengths: np.ndarray, sums: _Sums, table: np.ndarray):
    """Text, place, length and key of the windows let through that begin in the first ``n`` bytes of ``data``."""
    # A character begins here; after the last one something always does.
    first = np.append((data & 0xC0) != 0x80, True)
    begin = np.flatnonzero(first[:n])
    row = np.searchsorted(ends, begin, "right")
    # A text ends where the next begins, or goes on beyond what is at hand.
    end = np.minimum(ends[row], len(data))
    out = []
    for head, size in [(0, range(1, HEADS[0]))] + [(h, range(h, 2 * h)) for h in HEADS]:
        if head:
            if lengths[-1] < head:
                break
            some = begin + head <= end
            begin, row, end = begin[some], row[some], end[some]
            some = _let_through(table, _head(sums.window(begin, head), head))
            begin, row, end = begin[some], row[some], end[some]
        for length in lengths[(lengths >= size.start) & (lengths < size.stop)]:
            fits = np.flatnonzero(begin + length <= end)
            key = _key(sums.window(begin[fits], length), length)
            some = np.flatnonzero(_let_through(table, key) & first[begin[fits] + length])
            fits = fits[some]
            out.append((row[fits], begin[fits], np.full(len(fits), length, np.int64), key[some]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))
