"""Phrases whose words belong together (collocation mining).

1. Every n-gram of one to four words, with its language, is a 64-bit hash.  The hashes
   are dealt to partitions; for each partition a task writes Misra-Gries summaries of
   what it read, and the summaries of a partition are merged.  A merged summary has more
   counters than the mass of its partition divided by the threshold, so what it takes off
   a counter is less than the threshold: every frequent n-gram survives.  Hashes of a
   partition are cut to 32 bits; n-grams that share one only make it survive more easily.
2. The survivors become a bit table of bounded size, and a second pass over the texts
   counts, as strings and exactly, the n-grams of which they and all their parts may have
   survived.  Rare ones that got through are dropped by their count.
3. Scores, cuts and the phrases within longer ones are joins of the counts with themselves.

What the summaries and the table let through decides the cost only.  A task holds at most
``HELD`` counters (or those of one document); a partition's summary grows with its mass, and
there is a partition for every ``PER_PART`` bytes of text.

Words within a block of texts are told apart by 64-bit hashes; two different n-grams of a
block share one with probability below 10^-6.

Defined results: a null text has no words; a null language is ``und``; equal rows count each;
a phrase never crosses a mark of ``BREAKS`` or the end of a text; an empty table gives an
empty table; columns other than the text and the language are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casework.llm import bit_table, words
from casework.llm.work import stored

LONGEST = 4
LEAST = 30
TOP = 2000
#: Percent of a phrase's occurrences that lie in one longer phrase when it is dropped.
COVERED = 80
SCALE = 2_000_000
NO_LANG = "und"
#: Marks at which a text is cut into pieces.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"

#: Counters of a task before it writes its summaries, and most of them in a row.
HELD = 1 << 20
IN_ROW = 1 << 16
#: Bytes of text that are worked on together.
BLOCK = 1 << 20
#: Bytes of text for each partition of the summaries, and the least number of these.
PER_PART, LEAST_PARTS = 1 << 28, 32
#: Parts into which a language's phrases are dealt before its first ones are chosen.
SALTS = 64

_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[ord("A") : ord("Z") + 1] += 32
_SIGNS[list(BREAKS)] = 10
_FACTORS = words.mix(np.arange(11, 11 + LONGEST, dtype=np.uint64)) | np.uint64(1)


class Pieces(words.Block):
    """Texts in lower case whose breaks are line ends, and the piece of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(_SIGNS[data], offsets)
        ends = np.cumsum(self.data == 10, dtype=np.int32)
        self.text_of = np.repeat(np.arange(len(self)), np.diff(self.first))
        self.piece = (ends[self.begin] if len(self.begin) else np.zeros(0, np.int32)) + self.text_of

    def together(self, size: int) -> np.ndarray:
        """For each word whether it and the next ones, ``size`` in all, are of one piece."""
        whole = np.zeros(len(self.begin), bool)
        n = len(self.begin) - size + 1
        if n > 0:
            whole[:n] = self.piece[:n] == self.piece[size - 1 :]
        return whole

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The words from each place on, joined by a space."""
        lengths = self.end - self.begin
        places = np.concatenate([[0], np.cumsum(lengths + 1)])
        plain = np.full(places[-1], 32, np.uint8)
        plain[words.ranges(places[:-1], lengths)] = self.data[words.ranges(self.begin, lengths)]
        length = places[at + size] - 1 - places[at]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        chars = plain[words.ranges(places[at], length)] if len(at) else plain[:0]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.tobytes())).cast(pa.string())


def _codes(hashes: np.ndarray, langs: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of each n-gram with its language."""
    total = langs[at] + np.uint64(size)
    for k in range(size):
        total = total + hashes[at + k] * _FACTORS[k]
    return words.mix(total)


def _dealt(codes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a hash in the upper 32 bits, its key there in the lower ones."""
    part = (codes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return part << np.uint64(32) | codes & np.uint64(0xFFFFFFFF)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, np.ndarray, np.ndarray, list[str]]]:
    """Blocks with the hash of each word, the hash of its language, and the language of each text."""
    known: dict[str, int] = {}
    for batch in batches:
        names = batch.column(1).to_pylist()
        for name in set(names) - known.keys():
            known[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        marks = np.array([known[n] for n in names], np.uint64)
        for i, block in words.blocks(batch.column(0), BLOCK, Pieces):
            yield block, block.hashes(lower=False), marks[i : i + len(block)][block.text_of], names[i : i + len(block)]


# -- first pass: summaries ----------------------------------------------------------------


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counters of several summaries added up, sorted by key."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(held) == 1:
        return held[0]
    keys, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def trimmed(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` counters, and what was taken off each of them (Misra-Gries).

    Each unit taken off is taken off more than ``capacity`` counters, so it costs more than
    ``capacity`` of the mass.
    """
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > off
    return keys[keep], counts[keep] - off, off


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte: small ones leave runs of zeros."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: pa.Buffer, n: int) -> np.ndarray:
    plain = pa.decompress(raw, 4 * n, "zstd")
    return np.frombuffer(plain, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


SUMMARY = "part INT, body INT, mass BIGINT, keys BINARY, counts BINARY"


def _summaries(parts: int, held_most: int):
    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        out = []
        for i, j in zip(cuts, cuts[1:]):
            low = (keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out.append((int(part[i]), 0, int(counts[i:j].sum()), b"", b""))
            # The number of counters is the body; a count beyond 32 bits is more than a task can read.
            for x in range(0, j - i, IN_ROW):
                some = low[x : x + IN_ROW]
                out.append((int(part[i]), len(some), 0, _packed(np.diff(some, prepend=0)), _packed(counts[i:j][x : x + IN_ROW])))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "body", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block, hashes, langs, _ in _read(batches):
            codes = [_dealt(_codes(hashes, langs, np.flatnonzero(block.together(n)), n), parts) for n in range(1, LONGEST + 1)]
            held.append(np.unique(np.concatenate(codes), return_counts=True))
            size += len(held[-1][0])
            if size > held_most:
                held = [summed(held)]
                size = len(held[0][0])
                if size > held_most // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        keys, counts = summed(held)
        if len(keys):
            yield rows(keys, counts)

    return run


def _survivors(least: int):
    """Merge the summaries of each partition; its mass comes before them and sets the capacity."""

    def finish(part: int, held: list, lost: int) -> pa.RecordBatch:
        keys, counts = summed(held)
        keys = keys[counts + lost >= least] | np.uint64(part) << np.uint64(32)
        return pa.RecordBatch.from_arrays([pa.array(words.mix(keys).view(np.int64))], names=["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, held, size, lost = None, 0, [], 0, 0
        for batch in batches:
            for i, (p, body, m) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if p != part:
                    if part is not None:
                        yield finish(part, held, lost)
                    part, mass, held, size, lost = p, 0, [], 0, 0
                mass += m
                if not body:
                    continue
                keys = np.cumsum(_unpacked(batch.column(3)[i].as_buffer(), body), dtype=np.uint64)
                held.append((keys, _unpacked(batch.column(4)[i].as_buffer(), body).astype(np.int64)))
                size += len(keys)
                capacity = mass // least + 1
                if size > 2 * capacity + 65_536:
                    keys, counts, off = trimmed(*summed(held), capacity)
                    held, size, lost = [(keys, counts)], len(keys), lost + off
        if part is not None:
            yield finish(part, held, lost)

    return run


# -- second pass: exact counts ------------------------------------------------------------

COUNT = "lang STRING, size INT, phrase STRING, f BIGINT"


def _exact(table: bytes, parts: int):
    def out(langs: list, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(langs, pa.string()), pa.array(np.full(len(counts), size, np.int32)), phrases, pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, totals = bit_table.opened(table), {}
        for block, hashes, marks, langs in _read(batches):
            for name, n in zip(langs, np.diff(block.first).tolist()):
                totals[name] = totals.get(name, 0) + n
            names, parts_on = np.array(langs, object), np.ones(len(hashes) + 1, bool)
            for size in range(1, LONGEST + 1):
                whole = block.together(size) & parts_on[:-1] & (parts_on[1:] if size > 1 else True)
                at = np.flatnonzero(whole)
                codes = _codes(hashes, marks, at, size)
                on = bit_table.maybe(wanted, words.mix(_dealt(codes, parts)))
                at, codes = at[on], codes[on]
                parts_on = np.zeros(len(hashes) + 1, bool)
                parts_on[at] = True
                _, first, counts = np.unique(codes, return_index=True, return_counts=True)
                if len(first):
                    yield out(names[block.text_of[at[first]]].tolist(), size, block.phrases(at[first], size), counts)
        if totals:
            yield out(list(totals), 0, pa.array([""] * len(totals)), np.array(list(totals.values()), np.int64))

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, held: int = HELD, per_part: int = PER_PART) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of 1 to 4 words with ``f >= least``; size 0 has the number of words."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / per_part))
    dealt = rows.mapInArrow(_summaries(parts, held), SUMMARY).repartition(parts, "part").sortWithinPartitions("part", "body")
    table = bit_table.build(stored(dealt.mapInArrow(_survivors(least), "key BIGINT"), "survivors"))
    counts = rows.mapInArrow(_exact(table, parts), COUNT).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return stored(counts.filter((F.col("size") == 0) | (F.col("f") >= least)), "phrases")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, held: int = HELD, per_part: int = PER_PART
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language."""
    counts = frequent_phrases(docs, text, lang, least, held, per_part)
    own = counts.filter("size > 0").select("lang", "phrase", "f")
    found = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))

    def part(first, size):
        return F.array_join(F.slice("ws", first, size), " ")

    k, size = F.col("k"), F.col("size")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, size - k).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(own.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    whole = "CAST({} AS DECIMAL(19,0))"
    score = F.expr(f"CAST({whole.format(SCALE)} * {whole.format('a')} div {whole.format('l + r')} AS BIGINT)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # Contiguous parts of two words or more of each longer phrase.
    inner = found.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inside = inner.groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {COVERED} * a")
    kept = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))

    # No task sorts a whole language: parts of it first, then their first rows.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
