"""Token counts of whole texts, by a trie over distinct pre-tokens.

Every distinct pre-token of some texts goes into a trie.  A node stands for a prefix and keeps
the state of its best segmentation: score, last piece and number of pieces.  The state follows
from those of the nodes above it, so it is worked out once, however many pre-tokens share the
prefix; the count at a pre-token's last node is its token count.  A text counts the sum over its
pre-tokens.

Pre-tokens are entered in order, so those that share a prefix follow each other and only the nodes above the
last one need to be held.  Counts of pre-tokens are remembered for the texts that follow.

Works on partitions of texts without a shuffle; a worker remembers ``KNOWN`` pre-tokens, and when
these are more, the half that it met most often.

Defined results: a null or empty text has no tokens; rows are counted one by one,
repeated or not; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casework.llm.pieces import PAIRS, Pieces, pieces_of

#: Pre-tokens that a worker remembers, and occurrences that are counted together.
KNOWN, TOGETHER = 1 << 19, 1 << 21


class Trie:
    """Prefixes of pre-tokens with the state of their best segmentation."""

    def __init__(self, pieces: Pieces, most: int = KNOWN):
        self.pieces, self.most = pieces, most
        # Beginnings of pieces, with the piece that is one itself.
        self.heads = {text[:k]: -1 for text in pieces.ids for k in range(1, len(text))} | pieces.ids
        # Pairs of a last piece and a next one, as one number, that merging leaves as they are; the empty
        # beginning, and any character of no piece, has a number beyond those of the pieces.
        self.begin = len(pieces.texts)
        self.side_by_side: dict[int, bool] = {}
        none = np.zeros(0, np.int64)
        self._remember([], none, none)

    def _remember(self, words: list[str], counts: np.ndarray, met: np.ndarray) -> None:
        """Start with these pre-tokens; by their place, their token counts and how often they were met."""
        self.places: defaultdict[str, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words))))
        self.counts, self.met = counts, met

    def tokens(self, pretoken: str) -> int:
        """Token count of one pre-token."""
        return int(self.sums([[pretoken]])[1][0])

    def sums(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pre-tokens and of tokens of texts given by their pre-tokens."""
        sizes, tokens, places, done = [], [], array("q"), 0
        for pretokens in texts:
            places.extend(map(self.places.__getitem__, pretokens))
            sizes.append(len(pretokens))
            if len(places) >= TOGETHER or len(self.places) >= self.most:
                tokens.append(self._summed(places, sizes[done:]))
                places, done = array("q"), len(sizes)
        tokens.append(self._summed(places, sizes[done:]))
        return np.array(sizes, np.int64), np.concatenate(tokens)

    def _summed(self, places: array, sizes: list[int]) -> np.ndarray:
        """Numbers of tokens of texts whose pre-tokens lie at ``places``."""
        # New pre-tokens are the last of all.
        fresh = list(islice(reversed(self.places), len(self.places) - len(self.counts)))[::-1]
        order = sorted(range(len(fresh)), key=fresh.__getitem__)
        new = np.zeros(len(fresh), np.int64)
        new[np.array(order, np.int64)] = self._entered([fresh[i] for i in order])
        self.counts, self.met = np.append(self.counts, new), np.append(self.met, np.zeros(len(fresh), np.int64))
        found = np.array(places, np.int64)
        sums = np.append(0, np.cumsum(self.counts[found]))
        ends = np.cumsum(sizes, dtype=np.int64)
        self.met += np.bincount(found, minlength=len(self.met))
        if len(self.places) >= self.most:
            words, often = list(self.places), np.argsort(-self.met, kind="stable")[: self.most // 2]
            # What was met long ago counts less.
            self._remember([words[i] for i in often], self.counts[often], self.met[often] // 2)
        return sums[ends] - sums[ends - np.array(sizes, np.int64)]

    def _entered(self, pretokens: list[str]) -> list[int]:
        """Token counts of pre-tokens in order."""
        # By node on the way to the last pre-token, of which the first is the empty prefix: score, last piece, number
        # of pieces, and from where on the prefix ends with the beginning of a piece.
        score, last, number, deep = [0.0], [self.begin], [0], [0]
        above, out = "", []
        for word in pretokens:
            shared, most = 0, min(len(word), len(above))
            while shared < most and word[shared] == above[shared]:
                shared += 1
            for path in (score, last, number, deep):
                del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self._reach(word, end, score, last, number, deep)
            out.append(number[-1])
            above = word
        return out

    def _reach(self, word: str, end: int, score: list, last: list, number: list, deep: list) -> None:
        """State of the prefix of a word up to ``end``, from the nodes above it."""
        bpe, scores, base, fits, heads = self.pieces.bpe, self.pieces.scores, self.begin, self.side_by_side, self.heads
        best, begun = None, end
        for start in range(deep[-1], end):
            i = heads.get(word[start:end])
            if i is None:
                continue
            if begun == end:
                begun = start
            if i < 0:
                continue
            if bpe:
                pair = last[start] * base + i
                good = fits.get(pair)
                if good is None:
                    good = self._pair(pair, last[start], i)
                if good:
                    best = (0.0, i, number[start] + 1)
                    break
                continue
            new = score[start] + scores[i]
            if best is None or new > best[0]:
                best = (new, i, number[start] + 1)
        c = word[end - 1]
        if c not in self.pieces.ids:
            # A character of no piece: an unknown piece, which bytes stand for.
            new = score[end - 1] + self.pieces.least
            if best is None or not bpe and new > best[0]:
                best = (new, base + 1 + ord(c), number[end - 1] + len(self.pieces.fallback(c)))
        score.append(best[0])
        last.append(best[1])
        number.append(best[2])
        deep.append(begun)

    def _pair(self, pair: int, left: int, right: int) -> bool:
        if len(self.side_by_side) >= PAIRS:
            self.side_by_side.clear()
        texts = self.pieces.texts
        before = texts[left] if left < self.begin else "" if left == self.begin else chr(left - self.begin - 1)
        good = self.side_by_side[pair] = self.pieces.leaves(before, texts[right])
        return good


@lru_cache(maxsize=2)
def trie_of(model: bytes) -> Trie:
    """One trie for all tasks of a Python worker."""
    return Trie(pieces_of(model))


def token_counts(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row of ``docs``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(model)
        for batch in batches:
            every, tokens = trie.sums(trie.pieces.pretokens(t.as_py() or "") for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(count_all, f"doc_id {kind}, n_pretokens BIGINT, n_tokens BIGINT")
