"""Language of whole texts: known words first, character n-grams for the others.

Training counts words and the character n-grams of words by language, on a bounded
sample of the labelled rows; how frequent a language is, is counted on all of them.  A known word scores its log frequency in each
language.  A word that is not known backs off to its character n-grams of the
longest length of which any is known, at a penalty for each step.  A text has the
language with the largest sum; equal sums go to the more frequent, then to the
first language in code point order.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
so is every text if nothing was learned; rows are kept as they are, repeated or not;
an empty table gives an empty table; columns other than the text are passed by.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casework.llm.work import small, stored

UNKNOWN = "und"
#: Most labelled rows to learn from, in each language.
SAMPLE = 4000
#: Words and n-grams that each language chooses, its most frequent ones; a chosen item is learned with its counts in every language.
WORDS = 20_000
GRAMS = 20_000
LONGEST = 4
#: Log penalty for a word's n-grams and for each length given up.
BACKOFF = math.log(0.4)
#: Words that a worker remembers.
REMEMBERED = 1 << 17
#: Longer words are looked at whole, but by pieces, and known by a digest; workers do not remember them.
LONG = 64

#: Evidence below which the pipeline rejects a text: a score of 0.3 among four languages, of which three are equal.
LEAST_EVIDENCE = math.log(9 / 7)

_SPACE = r"[\x20\x09-\x0D]+"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, text, lang`` of the rows that may be learned from."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, counts: DataFrame | None = None) -> DataFrame:
    """``lang, text`` of about ``sample`` labelled rows per language at most, chosen by a hash.

    All rows are counted (or ``counts`` says how many there are); the share that is taken follows from the counts.
    """
    rows = labelled(docs, doc_id, text, lang)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")) if counts is None else counts
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)
    return rows.join(counts, "lang").filter(pick).select("lang", "text")


def _words(text: Column) -> Column:
    """Letters of the words in lower case, without what stands around them."""
    return F.transform(F.split(F.lower(text), _SPACE), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))


@dataclass(frozen=True)
class Model:
    """Scores by language: ``words`` and ``grams`` map to rows of the score tables."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def word(self, w: str) -> np.ndarray:
        """Scores of a word: its own, or those of its longest known n-grams."""
        at = self.words.get(key(w))
        if at is not None:
            return self.word_scores[at]
        padded = f"<{w}>"
        for step, n in enumerate(range(LONGEST, 0, -1)):
            total, found, places = np.zeros(len(self.langs)), 0, len(padded) - n + 1
            # A long word is added up in parts.
            for i in range(0, places, REMEMBERED):
                known = [g for k in range(i, min(i + REMEMBERED, places)) if (g := self.grams.get(padded[k : k + n])) is not None]
                total, found = total + self.gram_scores[known].sum(axis=0), found + len(known)
            if found:
                return total / found + BACKOFF * (step + 1)
        return np.zeros(len(self.langs))


class Scorer:
    """Predicts texts with a model and remembers the scores of raw words."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.remembered = model, remembered
        self.rows: dict[str, int] = {}
        # The last column counts a word; what holds no letter has a row of zeros.
        self.table = np.zeros((remembered, len(model.langs) + 1))

    def _row(self, raw: str) -> int:
        at = self.rows[raw] = len(self.rows)
        w = strip(raw)
        self.table[at, :-1] = self.model.word(w) if w else 0
        self.table[at, -1] = 1 if w else 0
        return at

    def sums(self, text: str) -> np.ndarray:
        counts = Counter(text.lower().split())
        items, total = [w for w in counts if len(w) <= LONG], np.zeros(len(self.model.langs) + 1)
        for raw in counts if len(items) < len(counts) else ():
            if len(raw) > LONG and (w := strip(raw)):
                total += counts[raw] * np.append(self.model.word(w), 1)
        # A text with more words than are remembered is added up in parts.
        for i in range(0, len(items), self.remembered):
            part = items[i : i + self.remembered]
            if len(self.rows) + len(part) > self.remembered:
                self.rows.clear()
            at = [k if (k := self.rows.get(w)) is not None else self._row(w) for w in part]
            total += np.fromiter((counts[w] for w in part), float, len(part)) @ self.table[at]
        return total

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and evidence: by how much the words alone speak for one language against the mean of the others.

        Evidence is scaled like the score, but neither the shares nor the number of the languages enter it.
        """
        model = self.model
        if not text or not model.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        *words, n = self.sums(text)
        # Rounded, so that the order in which words are added up decides nothing.
        total = np.round(np.array(words) + model.prior, 6)
        best, scale = int(np.argmax(total)), math.sqrt(max(1.0, n))
        spread = np.exp((total - total[best]) / scale)
        others = len(words) - 1
        lead = (max(words) - (sum(words) - max(words)) / others) / scale if others else math.inf
        return model.langs[best], float(np.round(1 / spread.sum(), 9)), float(np.round(lead, 9))


def key(word: str) -> str:
    """A word, or the digest of a long one after a space, which no word holds."""
    return word if len(word) <= LONG else " " + hashlib.sha256(word.encode()).hexdigest()


def strip(word: str) -> str:
    """The word from its first to its last letter."""
    if word.isalpha():
        return word
    letters = [k for k, c in enumerate(word) if c.isalpha()]
    return word[letters[0] : letters[-1] + 1] if letters else ""


def train(rows: DataFrame, words: int = WORDS, grams: int = GRAMS, counts: DataFrame | None = None) -> Model:
    """Learn from ``lang, text`` rows; each language chooses at most ``words + grams`` items (more where its first ones are equally frequent), and the counts of these leave the executors.

    ``counts`` has the rows ``n`` of each ``lang`` in the table that ``rows`` are a sample of.
    """
    every = rows.select("lang", F.explode(_words(F.col("text"))).alias("item")).filter("item <> ''")
    every = stored(every.groupBy("lang", "item").agg(F.count("*").alias("n")), "words")
    padded = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    cut = every.select("lang", padded.alias("w"), "n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k"))
    # A long word in pieces that overlap by one character less than an n-gram, so each n-gram is in one piece.
    pattern = F.concat(F.lit("(?s)(?=(.{1,"), (F.col("k") + LONG - 1).cast("string"), F.lit("})).{1,%d}" % LONG))
    piece = F.when(F.length("w") <= LONG, F.array("w")).otherwise(F.regexp_extract_all("w", pattern, F.lit(1)))
    cut = cut.select("lang", "n", "k", F.explode(piece).alias("w")).filter(F.length("w") >= F.col("k"))
    cut = cut.select("lang", "n", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring(F.col("w"), i, F.col("k")))).alias("item"))
    cut = cut.groupBy("lang", "k", "item").agg(F.sum("n").alias("n"))

    def most(counted: DataFrame, limit: int, group: list[str]) -> list:
        total = counted.groupBy(*group).agg(F.sum("n").alias("total"))
        counted = stored(counted, "items")
        # How often an item must occur in a language to be chosen by it: told by how many items occur how often.
        least: dict[str, int] = {}
        room = {}
        for r in counted.groupBy("lang", "n").agg(F.count("*").alias("items")).orderBy("lang", F.desc("n")).toLocalIterator():
            room[r["lang"]] = room.get(r["lang"], limit) - r["items"]
            if room[r["lang"]] >= 0 or r["lang"] not in least:
                least[r["lang"]] = r["n"]
        bounds = small(counted.sparkSession, lang=pa.array(least.keys(), pa.string()), least=pa.array(least.values(), pa.int64()))
        chosen = counted.join(F.broadcast(bounds), "lang").filter("n >= least").select("item").distinct()
        # An item that one language has chosen keeps its counts in all of them.
        return counted.join(chosen, "item", "left_semi").join(F.broadcast(total), group).collect()

    digest = F.concat(F.lit(" "), F.sha2(F.col("item").cast("binary"), 256))
    every = every.withColumn("item", F.when(F.length("item") > LONG, digest).otherwise(F.col("item")))
    known, parts = most(every, words, ["lang"]), most(cut, grams, ["lang", "k"])
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")) if counts is None else counts
    shares = {r["lang"]: r["n"] for r in counts.collect()}
    langs = sorted(shares, key=lambda x: (-shares[x], x))
    prior = np.array([math.log(shares[x] / sum(shares.values())) for x in langs])
    return Model(langs, prior, *_scores(known, langs, 0), *_scores(parts, langs, 1))


def _scores(rows: list, langs: list[str], by_length: int) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies, half a count where a language lacks an item; differences from the mean, so no item favours all."""
    places = {x: i for i, x in enumerate(langs)}
    index: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r["item"]):
        index.setdefault(r["item"], len(index))
    totals = {(r["lang"], r["k"] if by_length else 0): r["total"] for r in rows}
    out = np.empty((len(index), len(langs)))
    lengths = {len(x) for x in index} if by_length else {0}
    base = {k: np.array([math.log(0.5 / (totals.get((x, k), 0) + 1)) for x in langs]) for k in lengths}
    for item, i in index.items():
        out[i] = base[len(item) if by_length else 0]
    for r in rows:
        out[index[r["item"]], places[r["lang"]]] = math.log((r["n"] + 0.5) / (r["total"] + 1))
    return index, out - out.mean(axis=1, keepdims=True) if len(out) else out


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and the score, and the evidence if there is a third name; columns of such names are replaced."""
    rest = [c for c in docs.columns if c not in names]
    docs = docs.select(*rest)
    schema = docs.withColumns({name: F.lit(0.0) if k else F.lit("") for k, name in enumerate(names)}).schema
    at = rest.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.judge(t.as_py()) for t in batch.column(at)]
            made = [pa.array([f[k] for f in found], pa.float64() if k else pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(label, schema)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Words from a sample of the labelled rows; shares of the languages from all of them."""
    counts = stored(labelled(docs, doc_id, text, lang).groupBy("lang").agg(F.count("*").alias("n")), "languages")
    return train(stored(training_rows(docs, doc_id, text, lang, sample, counts), "sample"), counts=counts)


def learn_and_predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    model = learn(docs, doc_id, text, lang, sample)
    return model, predict(docs, model, text)


def identified(docs: DataFrame, least: float = LEAST_EVIDENCE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and with evidence of ``least`` or more."""
    lang, score, evidence = "__lang_pred", "__score", "__evidence"
    found = predict(docs, learn(docs, sample=sample), names=(lang, score, evidence))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(evidence) >= least)).select(*docs.columns)
