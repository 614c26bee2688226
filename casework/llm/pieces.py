"""Pieces of a SentencePiece model file: their texts, scores and what may stand side by side.

Two kinds of model are read.  In a unigram model the score of a segmentation is the
sum of its pieces' scores and the best one counts.  In a BPE model the scores order
the merges, and a segmentation is the model's own exactly if merging would leave each
two neighbouring pieces as they are; ``fits`` tells that for a pair.  Either way the
best segmentation of a prefix follows from those of shorter prefixes.
"""

from __future__ import annotations

import re
from functools import lru_cache

from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Piece types of the file format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: What an unknown character costs below the least score.
PENALTY = 10.0
#: Pairs of pieces that a worker remembers.
PAIRS = 1 << 19


class Pieces:
    """A model for encoding: built once in each Python worker from the bytes of its file."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models that leave the text as it is")
        self.bpe = proto.trainer_spec.model_type == BPE
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.texts = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.is_byte = {i: b for b, i in self.bytes.items()}
        # What a piece stands for; a byte below 128 is a character by itself, others are read together.
        self.plain = [chr(self.is_byte[i]) if self.is_byte.get(i, 128) < 128 else t.replace(SPACE, " ") for i, t in enumerate(self.texts)]
        self.high = frozenset(i for i, b in self.is_byte.items() if b > 127)
        self.least = min(self.scores[i] for i in self.ids.values()) - PENALTY
        self.longest = max(map(len, self.ids))
        letters = set("".join(self.ids))
        # No piece reaches over a word's end, nor over a line break, if none holds these: then texts fall into pre-tokens.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in letters)
        self.pretoken = re.compile(r"[\s\S]+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self._fits: dict[tuple[str, str], bool] = {}

    def escaped(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def pretokens(self, text: str) -> list[str]:
        return self.pretoken.findall(self.escaped(text))

    def merged(self, text: str) -> list[str]:
        """Merges carried out one by one, highest score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Would merging leave the two pieces side by side?  ``left`` is empty at the beginning."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.leaves(left, right)
        return known

    def leaves(self, left: str, right: str) -> bool:
        """The same, worked out anew."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def fallback(self, character: str) -> list[int]:
        """Ids of a character that is in no piece: its bytes, else the unknown piece."""
        return [self.bytes[b] for b in character.encode()] if len(self.bytes) == 256 else [self.unknown]


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """The bytes of a model file on the driver's machine; they travel with the tasks."""
    with open(path, "rb") as file:
        return file.read()
