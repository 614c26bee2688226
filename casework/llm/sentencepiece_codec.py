"""SentencePiece encoding and decoding of whole texts.

An Aho-Corasick automaton over all pieces reads the text once.  At each place it
yields, by its output links from the longest to the shortest, the pieces that end
there; each relaxes the best segmentation up to that place from the one before the
piece.  Pre-tokens that no piece reaches over are encoded one by one and remembered.

For BPE models a candidate counts only where merging leaves the two pieces as they
are, which makes the result that of the model's own merges (see ``pieces``).

Defined results: null gives null ids and a null text; an empty text has no ids;
decoding gives the text back, with U+2581 as a space (the model's own mark for it);
rows are worked on one by one; an empty table gives an empty table; columns named
like the results are replaced.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casework.llm.pieces import PAIRS, SPACE, Pieces, pieces_of

#: Pre-tokens, and pieces in all of them, that a worker remembers.
REMEMBERED = 1 << 17
#: Longest pre-token that is remembered.
SHORT = 64
#: Texts whose ids and decoded text are in memory together.
ROWS = 200


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for text, i in pieces.ids.items():
            self.automaton.add_word(text, (len(text), i))
        if pieces.ids:
            self.automaton.make_automaton()
        self.letters = frozenset(x for x in pieces.ids if len(x) == 1)
        self.sizes = list(map(len, pieces.texts))
        # Pairs of pieces, as one number, that merging leaves as they are; the empty beginning counts as a piece.
        self.begin = len(pieces.texts)
        self.side_by_side: dict[int, bool] = {}
        # Ids as bytes: they take less memory than arrays, and are joined at once.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segment(self, text: str) -> array:
        """Ids of the best segmentation, in one pass over the matches."""
        if not self.letters.issuperset(text):
            return self._with_unknown(text)
        if self.pieces.bpe:
            last = self._last_merged(text)
        else:
            last = self._last_scored(text)
        out, at = array("i"), len(text)
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        out.reverse()
        return out

    def _last_merged(self, text: str) -> list[int]:
        """Last piece of each prefix, where every character is a piece: the candidate that stays beside the one before."""
        last, fits, base = [self.begin] + [-1] * len(text), self.side_by_side, self.begin + 1
        for end, (size, i) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                pair = before * base + i
                good = fits.get(pair)
                if good is None:
                    good = self._pair(pair, before, i)
                if good:
                    last[end] = i
        return last

    def _pair(self, pair: int, before: int, i: int) -> bool:
        if len(self.side_by_side) >= PAIRS:
            self.side_by_side.clear()
        texts = self.pieces.texts
        good = self.side_by_side[pair] = self.pieces.leaves("" if before == self.begin else texts[before], texts[i])
        return good

    def _last_scored(self, text: str) -> list[int]:
        """Last piece of each prefix, where every character is a piece: the one of the best sum."""
        last, best, scores = [-1] * (len(text) + 1), [0.0] + [-math.inf] * len(text), self.pieces.scores
        for end, (size, i) in self.automaton.iter(text):
            end += 1
            new = best[end - size] + scores[i]
            if new > best[end]:
                best[end], last[end] = new, i
        return last

    def _with_unknown(self, text: str) -> array:
        """The same for texts with characters that are no piece."""
        pieces, n = self.pieces, len(text)
        score = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        last = [""] * (n + 1)
        done = 0
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            done = self._unknown(text, score, back, last, done, end - 1)
            start = end - length
            if pieces.bpe:
                if score[end] is None and pieces.fits(last[start], pieces.texts[i]):
                    score[end], back[end], last[end] = 0.0, (start, i), pieces.texts[i]
            elif score[end] is None or score[start] + pieces.scores[i] > score[end]:
                score[end], back[end] = score[start] + pieces.scores[i], (start, i)
        self._unknown(text, score, back, last, done, n)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append(pieces.fallback(text[start:at]) if i < 0 else [i])
            at = start
        return array("i", [i for part in reversed(out) for i in part])

    def _unknown(self, text: str, score: list, back: list, last: list, done: int, to: int) -> int:
        """Reach places up to ``to`` by characters that are in no piece."""
        for k in range(done, to):
            if text[k] not in self.pieces.ids:
                new = score[k] + self.pieces.least
                if score[k + 1] is None or not self.pieces.bpe and new > score[k + 1]:
                    score[k + 1], back[k + 1], last[k + 1] = new, (k, -1), text[k]
        return max(done, to)

    def encode(self, text: str) -> array:
        parts: list[bytes] = []
        known, add = self.known, parts.append
        for w in self.pieces.pretokens(text):
            ids = known.get(w)
            if ids is None:
                # What was used of late is found in the older half, and stays.
                ids = self.older.get(w)
                if ids is None:
                    ids = self.segment(w).tobytes()
                if len(w) <= SHORT:
                    if len(known) >= REMEMBERED // 2:
                        self.older, known = known, {}
                        self.known = known
                    known[w] = ids
            add(ids)
        return array("i", b"".join(parts))


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a Python worker."""
    return Encoder(pieces_of(model))


def decode_ids(pieces: Pieces, ids) -> str:
    """Text of the ids; runs of byte pieces are read as UTF-8."""
    if pieces.high.isdisjoint(ids):
        text = "".join(map(pieces.plain.__getitem__, ids))
        return text[1:] if pieces.prefix and text.startswith(" ") else text
    out, raw = [], bytearray()
    for i in ids:
        b = pieces.is_byte.get(i)
        if b is not None:
            raw.append(b)
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(pieces.texts[i])
    if raw:
        out.append(raw.decode(errors="replace"))
    text = "".join(out)
    if pieces.prefix and text.startswith(SPACE):
        text = text[1:]
    return text.replace(SPACE, " ")


def _lists(rows: list) -> pa.Array:
    """Integer lists, null where a row is None."""
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    flat = array("i")
    for r in rows:
        if r is not None:
            flat.extend(r)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)), mask=mask)


def _added(docs: DataFrame, name: str, kind: str, of: str, work) -> DataFrame:
    """``docs`` with a column ``name`` that ``work`` makes of column ``of``, batch by batch."""
    rest = [c for c in docs.columns if c != name]
    docs = docs.select(*rest)
    schema = docs.withColumn(name, F.lit(None).cast(kind)).schema
    at = rest.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            # Some rows at a time, so that long texts do not pile up.
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, work(part.column(at), state)], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``."""

    def work(texts: pa.Array, state: dict) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = encoder_of(model)
        return _lists([None if t is None else state["encoder"].encode(t) for t in texts.to_pylist()])

    return _added(docs, "ids", "array<int>", text, work)


def decode(rows: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``."""

    def work(lists: pa.Array, state: dict) -> pa.Array:
        pieces = pieces_of(model)
        return pa.array([None if x is None else decode_ids(pieces, x) for x in lists.to_pylist()], pa.string())

    return _added(rows, "decoded", "string", ids, work)


def round_trip(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``ids, decoded, n_pieces`` and whether the text came back; ids are decoded where they are made."""

    def work(texts: pa.Array, state: dict) -> pa.Array:
        encoder = encoder_of(model)
        ids = [None if t is None else encoder.encode(t) for t in texts.to_pylist()]
        decoded = [None if x is None else decode_ids(encoder.pieces, x) for x in ids]
        return pa.StructArray.from_arrays([_lists(ids), pa.array(decoded, pa.string())], names=["ids", "decoded"])

    rest = [c for c in docs.columns if c not in ("ids", "decoded", "n_pieces", "round_trip")]
    rows = _added(docs.select(*rest), "__codec", "struct<ids:array<int>,decoded:string>", text, work).select(*rest, "__codec.*")
    same = F.col("decoded").eqNullSafe(F.replace(F.col(text), F.lit(SPACE), F.lit(" ")))
    return rows.withColumn("n_pieces", F.size("ids").cast("bigint")).withColumn("round_trip", same)
