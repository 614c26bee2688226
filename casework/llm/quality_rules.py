"""Quality rules for texts, with a rule on repeated passages from a suffix array.

The suffix array of a text's words is built by prefix doubling, for many texts at
once; suffixes of different texts never meet, as ranks begin with the text.  The
ranks of every step also give the longest common prefix of neighbours.  Each
interval of neighbours with a common prefix of five words or more is a maximal
repeated passage; the union of its places is what the text repeats.  A text fails
if that union holds too much of its characters, or if one passage is too long.

Defined results: null is a text without words, which fails the base rule; words,
lines and passages are compared byte by byte; rows are judged one by one, repeated or
not; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casework.llm import words

#: Words of the shortest passage that counts as a repetition.
WINDOW = 5
LEAST_WORDS = 10
#: Most words in repeated windows, in percent of all words (base rule).
REPEATED_PERCENT = 20
#: Most characters in repeated passages, in percent of the characters of words.
COVERED_PERCENT = 25
#: Most words of one repeated passage.
LONGEST = 64

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
#: Bytes that begin a character.
_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def repeats(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place the length of its longest passage that occurs elsewhere in the same text.

    ``values`` are words as numbers, ``text`` the number of each word's text, ascending.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    _, word = np.unique(values, return_inverse=True)
    ranks = [_ranked(text.astype(np.int64) * (int(word.max()) + 1) + word)]
    open_, step = _not_alone(ranks[0], np.arange(n)), 1
    while len(open_):
        old = ranks[-1]
        after = open_ + step
        inside = after < n
        same = np.zeros(len(open_), bool)
        same[inside] = text[after[inside]] == text[open_[inside]]
        second = np.where(same, old[np.minimum(after, n - 1)] + 1, 0)
        new = old.copy()
        # Within a group of equal ranks the next words decide; a rank is the number of suffixes before it.
        key = old[open_] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key, group = key[order], old[open_][order]
        first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(order))
        new[open_[order]] = group + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(starts, place, 0))
        ranks.append(new)
        step *= 2
        open_ = _not_alone(new, open_)
    array = np.argsort(ranks[-1], kind="stable")
    a, b, common = array[:-1], array[1:], np.zeros(n - 1, np.int64)
    pair = np.flatnonzero(text[a] == text[b])
    a, b = a[pair], b[pair]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        ok = np.maximum(x, y) < n
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        length[ok] += 1 << k
    common[pair] = length
    out = np.zeros(n, np.int64)
    out[array[:-1]] = common
    out[array[1:]] = np.maximum(out[array[1:]], common)
    return out


def _ranked(key: np.ndarray) -> np.ndarray:
    """The number of smaller keys."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[inverse]


def _not_alone(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    own = rank[among]
    return among[np.bincount(own, minlength=len(rank))[own] > 1]


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Places in the union of passages of ``least`` words or more."""
    long = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + length[long], -1)
    return np.cumsum(edge[:-1]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _judged(block: words.Block, window: int) -> dict[str, np.ndarray]:
    first, n_words = block.first, np.diff(block.first)
    text = np.repeat(np.arange(len(block)), n_words)
    length = repeats(block.hashes(lower=False), text)
    union = covered(length, window)
    letters = np.concatenate([[0], np.cumsum(_CHARACTER[block.data])])
    size = letters[block.end] - letters[block.begin]
    longest = np.zeros(len(block), np.int64)
    np.maximum.at(longest, text, length)
    return {
        "n_words": n_words,
        "word_chars": _sums(size, first),
        "n_symbols": _sums(_SYMBOL[block.data], block.offsets),
        "n_dup_lines": np.array([_duplicate_lines(block.text(i)) for i in range(len(block))], np.int64),
        "n_repeat_words": _sums(union, first),
        "repeat_chars": _sums(size * union, first),
        "longest_repeat": longest,
    }


def quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    least_words: int = LEAST_WORDS,
    repeated_percent: int = REPEATED_PERCENT,
    covered_percent: int = COVERED_PERCENT,
    longest: int = LONGEST,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept, repeat_chars, longest_repeat`` of every row of ``docs``."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in words.blocks(batch.column(1)):
                found = _judged(block, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(block)), *[pa.array(found[c], pa.int64()) for c in counts]], names=["doc_id", *counts]
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string"))
    rows = rows.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{c} BIGINT" for c in counts))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))
    repeats_much = (100 * F.col("repeat_chars") > covered_percent * F.col("word_chars")) | (F.col("longest_repeat") > longest)
    return rows.select("doc_id", *counts[:5], failed.alias("base_failed"), (~failed & ~repeats_much).alias("kept"), *counts[5:])
