"""Removing every byte that lies in a string of ``SIZE`` bytes which also starts elsewhere (suffix-array dedup).

1. Each window of ``SIZE`` bytes is anchored at the least hash among its runs of ``ANCHOR`` bytes.
   Equal windows have equal anchors, so consecutive windows with one anchor form a *piece*: what is
   counted is one row for some 60 windows, not one for each.
2. An anchor that occurs once has no repeated window.  Where all pieces of an anchor are equal, all
   their windows are repeated.  Equal pieces are one row from there on, whatever their number.
3. The different pieces of an anchor go to one task.  A suffix array over them (``suffix_groups``)
   brings equal windows together; neighbours are compared byte by byte.
4. An anchor with more than ``GROUP`` different pieces is not left to one task: its pieces are cut to
   ranges of windows, at the same distance from the anchor, and each range with equal inner bytes is
   an anchor of its own.  Ranges become shorter until, at one window, equal pieces are all there is.
5. The spans go back to the texts they came from; only texts with a span are shuffled.

Anchors and pieces are compared as 64-bit hashes, a pair of them for each piece.

Defined results: a null text is empty; a text of less than ``SIZE`` bytes keeps all its bytes; of equal
rows each is elsewhere to the other, so rows of one id and one text share their spans; a string may
overlap its other occurrence; what is left is bytes, as a cut may fall within a character; an empty
table gives an empty table; columns other than the id and the text are not read.  A text is worked on
in segments of ``SEGMENT`` bytes, so its length bounds the size of its row alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casework.llm import bit_table, words
from casework.llm.suffix_groups import suffix_array
from casework.llm.work import stored

SIZE = 200
#: Bytes whose hash anchors a window.
ANCHOR = 64
#: Bytes of text that are worked on together.
SEGMENT = words.PIECE - (1 << 12)
#: Different pieces of an anchor that one task compares.
GROUP = 2000
#: Bytes of pieces in one suffix array, where an anchor has no more.
ARRAY = 1 << 13
#: Windows of a piece after each cut of a large anchor.
CUTS = (11, 1)
#: Rows of a piece from which on it is frequent, one in so many of all, and parts over which its rows are dealt.
FREQUENT = 1000
SALTS = 64

_ROOT = words._ROOT


class Pieces:
    """The pieces of some bytes: ``lo`` where each begins, ``n`` windows, the anchor ``q`` bytes behind ``lo``, hashes ``a`` and ``g``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, anchor: int):
        n, width = len(data), size - anchor + 1
        self.data = data
        up, down = words._piece_powers() if n <= words.PIECE else (words._powers(_ROOT, n + 1), words._powers(pow(_ROOT, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words._byte_values(False)[data] * up[:n], out=sums[1:])
        hashes = words.mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
        least = _least(hashes, width)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
        at, behind = least[first], np.append(first[1:], len(least))
        # The windows of an anchor lie in its own text.
        text = np.searchsorted(offsets, at, "right") - 1
        lo, hi = np.maximum(first, offsets[text]), np.minimum(behind, offsets[text + 1] - size + 1)
        inside = lo < hi
        self.lo, self.text, at, self.n = lo[inside], text[inside], at[inside], (hi - lo)[inside]
        self.q = at - self.lo
        self.a = hashes[at]
        self.g = words.mix((sums[self.lo + self.n + size - 1] - sums[self.lo]) * down[self.lo] + self.n.astype(np.uint64))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash among each ``width`` of them, the first of equals (by their upper 40 bits)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    marked = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    marked[:n] = hashes & ~low | np.arange(n, dtype=np.uint64)
    rows = marked.reshape(-1, width)
    until = np.minimum.accumulate(rows, 1).ravel()
    beyond = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(beyond[: n - width + 1], until[width - 1 : n]) & low).astype(np.int64)


def _segments(texts: pa.Array, size: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, Pieces]]:
    """Row and place within the text of each piece of an Arrow column, segment by segment."""
    for i, (data, offsets) in words.blocks(texts, SEGMENT, lambda data, offsets: (data, offsets)):
        # A single long text is cut; windows that begin in a segment are read to their end.
        for at in range(0, max(1, len(data)), SEGMENT):
            own = data[at : at + SEGMENT + size - 1]
            if len(own) < size:
                continue
            pieces = Pieces(own, np.minimum(offsets, len(own)) if len(offsets) > 2 else np.array([0, len(own)]), size, anchor)
            if len(pieces.lo):
                row = i + pieces.text
                yield row, pieces.lo + at - offsets[pieces.text], pieces


PIECE = "k1 BIGINT, k2 BIGINT, lo BIGINT, n INT, a BIGINT, g BIGINT"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``k1, k2`` name a row by its id and text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _all_pieces(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (1, 2))
            for row, lo, p in _segments(batch.column(0), size, anchor):
                columns = [pa.array(k1[row]), pa.array(k2[row]), pa.array(lo), pa.array(p.n.astype(np.int32)), _column(p.a), _column(p.g)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "lo", "n", "a", "g"])

    return run


def _texts_of(table: bytes, size: int, anchor: int):
    """The bytes of the pieces at the places that the table knows, and perhaps of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bit_table.opened(table)
        for batch in batches:
            k1 = batch.column(1).to_numpy()
            for row, lo, p in _segments(batch.column(0), size, anchor):
                on = np.flatnonzero(bit_table.maybe(wanted, k1[row] ^ lo))
                raw = [p.data[b : b + n + size - 1].tobytes() for b, n in zip(p.lo[on].tolist(), p.n[on].tolist())]
                columns = [_column(p.a[on]), _column(p.g[on]), pa.array(p.q[on].astype(np.int32)), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "g", "q", "bytes"])

    return run


def _known(table: bytes, names: list[str]):
    """Rows whose key, the numbers in ``names`` combined bit by bit, the table may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bit_table.opened(table)
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for c in names:
                keys = keys ^ batch.column(batch.schema.get_field_index(c)).to_numpy()
            yield batch.filter(pa.array(bit_table.maybe(wanted, keys)))

    return run


# -- pieces of one anchor -----------------------------------------------------------------


def repeated_windows(pieces: list[bytes], size: int) -> list[tuple[int, int] | None]:
    """First and last window of each piece that also starts elsewhere in them, by a suffix array over all."""
    # Symbol 0 stands between pieces; no window reaches it.
    joined = np.concatenate([np.concatenate([np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]) for p in pieces])
    lengths = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    windows = words.ranges(begin, lengths - size + 1)
    is_window = np.zeros(len(joined), bool)
    is_window[windows] = True
    order = suffix_array(joined)
    order = order[is_window[order]]
    x, y = order[:-1], order[1:]
    # Eight bytes as one number.
    raw = (joined - 1).astype(np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(np.uint64).ravel()
    for step in [*range(0, size - 8, 8), size - 8]:
        same = eight[x + step] == eight[y + step]
        x, y = x[same], y[same]
    again = np.zeros(len(joined), bool)
    again[x] = again[y] = True
    out: list[tuple[int, int] | None] = []
    for b, n in zip(begin, lengths - size + 1):
        at = np.flatnonzero(again[b : b + n])
        out.append((int(at[0]), int(at[-1])) if len(at) else None)
    return out


def _grouped(size: int, most: int):
    """Suffix arrays over the pieces of one key or of several small ones; input sorted by ``key, sub``."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated_windows([r[2] for r in rows], size)
        out = [(k, s, *span) for (k, s, _), span in zip(rows, spans) if span]
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "sub", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for key, sub, raw in zip(*(batch.column(k) for k in range(3))):
                row = (key.as_py(), sub.as_py(), raw.as_py())
                if total >= most and row[0] != held[-1][0]:
                    yield found(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[2])
        if held:
            yield found(held)

    return run


ROW = "a BIGINT, g BIGINT, base INT, n INT, q INT, key BIGINT, sub BIGINT, bytes BINARY"


def _cut(size: int, width: int):
    """The pieces of large anchors, cut to ranges of ``width`` windows at the same distance from the anchor."""

    def digest(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(b"|".join(str(p).encode() if isinstance(p, int) else p for p in parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, g, base, n, q, key, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
                # Window i begins q - i bytes before the anchor.
                for r in range(max(0, q - n + 1) // width, q // width + 1):
                    i, j = max(0, q - (r + 1) * width + 1), min(n, q - r * width + 1)
                    if i < j:
                        inner = raw[q - r * width : q - (r + 1) * width + 1 + size]
                        own = raw[i : j + size - 1]
                        out.append((a, g, base + i, j - i, q - i, digest(key, r, inner), digest(j - i, own), own))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["a", "g", "base", "n", "q", "key", "sub", "bytes"])

    return run


def _by_arrays(rows: DataFrame, size: int, most: int) -> DataFrame:
    """``key, sub, first, last`` of the different pieces of each key."""
    sorted_rows = rows.select("key", "sub", "bytes").repartition("key").sortWithinPartitions("key", "sub")
    return sorted_rows.mapInArrow(_grouped(size, most), "key BIGINT, sub BIGINT, first INT, last INT")


def _large_anchors(rows: DataFrame, size: int, group: int, most: int, cuts: tuple[int, ...]) -> list[DataFrame]:
    """``a, g, first, last`` for pieces whose anchor has more than ``group`` different ones."""
    out = []
    for width in cuts:
        pieces = stored(rows.mapInArrow(_cut(size, width), ROW), "cut")
        one = pieces.groupBy("key", "sub").agg(F.count("*").alias("c"), F.max(F.struct("a", "g", "base", "n", "q", "bytes")).alias("one"))
        one = stored(one, "cut-pieces")
        kinds = one.groupBy("key").agg(F.count("*").alias("kinds"))
        again = one.filter("c > 1").select("key", "sub")
        out.append(pieces.select("a", "g", "base", "n", "key", "sub").join(again, ["key", "sub"], "left_semi").selectExpr("a", "g", "base AS first", "base + n - 1 AS last"))
        mixed = one.join(kinds.filter("kinds > 1"), "key").select("key", "sub", "kinds", "one.*")
        few = mixed.filter(F.col("kinds") <= group)
        spans = _by_arrays(few, size, most).join(few.drop("bytes"), ["key", "sub"])
        out.append(spans.selectExpr("a", "g", "base + first AS first", "base + last AS last"))
        rows = stored(mixed.filter(F.col("kinds") > group).select("a", "g", "base", "n", "q", "key", "sub", "bytes"), "large")
        if rows.isEmpty():
            break
    return out


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, anchor: int = ANCHOR, group: int = GROUP, most: int = ARRAY, cuts: tuple[int, ...] = CUTS
) -> DataFrame:
    """``k1, k2, spans`` of the rows with repeated strings; a span is the first byte and the one behind the last."""
    texts = _keyed(docs, doc_id, text).filter(F.octet_length("text") >= size).select("text", "k1", "k2")
    every = stored(texts.mapInArrow(_all_pieces(size, anchor), PIECE), "pieces")
    anchors = bit_table.build(stored(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("key")), "anchors"))
    some = every.mapInArrow(_known(anchors, ["a"]), PIECE)
    # One place of each piece, as a number that few other places share.
    pieces = some.groupBy("a", "g").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.col("k1").bitwiseXOR(F.col("lo"))).alias("at"))
    pieces = stored(pieces, "different-pieces")
    kinds = pieces.groupBy("a").agg(F.count("*").alias("kinds"))
    again = pieces.filter("c > 1").selectExpr("a", "g", "0 AS first", "n - 1 AS last")
    mixed = stored(pieces.join(kinds.filter("kinds > 1"), "a").select("a", "g", "c", "n", "kinds", "at"), "mixed")

    # The bytes of the different pieces, each from that place.
    places = bit_table.build(mixed.select(F.col("at").alias("key")))
    found = texts.mapInArrow(_texts_of(places, size, anchor), "a BIGINT, g BIGINT, q INT, bytes BINARY")
    found = found.groupBy("a", "g").agg(F.max(F.struct("q", "bytes")).alias("t"))
    mixed = stored(mixed.join(found, ["a", "g"]).select("a", "g", "c", "n", "kinds", "t.q", "t.bytes"), "mixed-bytes")
    few = mixed.filter(F.col("kinds") <= group).select("c", F.col("a").alias("key"), F.col("g").alias("sub"), "bytes")
    spans = _by_arrays(few, size, most).join(few.filter("c = 1").select("key", "sub"), ["key", "sub"])
    parts = [again, spans.selectExpr("key AS a", "sub AS g", "first", "last")]
    large = mixed.filter(F.col("kinds") > group).selectExpr("a", "g", "0 AS base", "n", "q", "a AS key", "g AS sub", "bytes")
    if not large.isEmpty():
        parts += _large_anchors(large, size, group, most, cuts)
    ends = parts[0]
    for p in parts[1:]:
        ends = ends.unionByName(p)
    # Windows of a piece are so near each other that its first and its last span all between them.
    ends = stored(ends.groupBy("a", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")), "ends")

    # Rows of frequent pieces, of which there are at most FREQUENT, are dealt over several tasks.
    least = max(32, every.count() // FREQUENT)
    frequent = stored(pieces.filter(F.col("c") > least).select("a", "g", F.lit(SALTS).alias("salts")), "frequent")
    wanted = bit_table.build(ends.select(F.col("a").bitwiseXOR(F.col("g")).alias("key")))

    def salted(rows: DataFrame, salt) -> DataFrame:
        return rows.join(F.broadcast(frequent), ["a", "g"], "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt)

    rows = salted(every.mapInArrow(_known(wanted, ["a", "g"]), PIECE), F.pmod("k1", F.col("salts")).cast("int"))
    own = rows.join(salted(ends, F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), ["a", "g", "salt"])
    span = F.struct((F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + size).alias("end"))
    return stored(own.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans")), "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, kept, spans, n_bytes`` of every row: the bytes that are left, and the maximal runs that are not."""
    spans = repeated_spans(docs, doc_id, text, **options)
    rows = _keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    touched = bit_table.build(spans.select(F.col("k1").alias("key")))
    schema = f"doc_id {kind}, kept BINARY, spans ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>, n_bytes BIGINT"

    def some(on: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = bit_table.opened(touched)
            for batch in batches:
                yield batch.filter(pa.array(bit_table.maybe(table, batch.column(2).to_numpy()) == on))

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for t, own in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, runs, at, left = t.as_buffer().to_pybytes(), merged([(s["begin"], s["end"]) for s in own or []]), 0, []
                for begin, end in runs:
                    left.append(raw[at:begin])
                    at = end
                kept.append(b"".join([*left, raw[at:]]))
                removed.append([{"begin": b, "end": e} for b, e in runs])
                sizes.append(len(raw))
            kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, kinds), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_bytes"])

    whole = rows.mapInArrow(some(False), rows.schema).select("doc_id", F.col("text").cast("binary").alias("kept"))
    whole = whole.select("doc_id", "kept", F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.octet_length("kept").cast("bigint").alias("n_bytes"))
    maybe = rows.mapInArrow(some(True), rows.schema).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return whole.unionByName(maybe.mapInArrow(cut, schema))
