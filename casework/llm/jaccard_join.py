"""Links between texts whose word shingles overlap (n-gram Jaccard join).

Exact: two documents link when ``100 * |A n B| >= percent * |A u B|``.

1. Each text becomes a sorted array of 64-bit shingle hashes, its size, a parity
   bitmap of 4 to 8 bits per shingle, and a prefix: its rarest shingles, so many
   that two linked sets must share one of them.  Rarity comes from a table of
   counters of fixed size; any order gives the same links, a good one fewer pairs.
2. Equal sets become one representative.
3. A tile holds the sets that share a prefix shingle and lie in neighbouring size
   bands.  In a tile the bits in which two bitmaps differ bound the overlap from
   above; only pairs within the bound go on to the intersection of their arrays.
4. Only components are asked for.  So each set is first linked to one other set that
   shares its least shingles by a hash (two rounds); a tile whose sets then belong to one component needs no
   more work, which is what becomes of large groups of near copies.  In all other
   tiles every pair of different components is compared; a tile of many sets is
   cut into blocks, and pairs of blocks are tasks of their own.

No pair that could link two components is left out, and none is compared twice for
nothing: the cost of a group of near copies is in proportion to its size.

Defined results: a text without words has an empty set and no links; a null id has
no links and a null component; rows that share an id are one node with several
texts; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from casework.llm import words
from casework.llm.components import components
from casework.llm.work import stored

SHINGLE = 5
#: Bytes of text that are cut into shingles together.
TEXTS = 1 << 19
PERCENT = 80
#: Counters that order shingles by rarity: 8 MB of levels, whatever the input.
COUNTER_BITS = 23
SLABS = 16
#: Shingles, the least by a hash, by which a set looks for its first links, and how often it looks.
PROBES = 6
ROUNDS = 2
#: Sets of a tile that are compared in one go.
TILE = 512
#: Sets of a tile whose pairs are named first and bounded later, each once: they share many tiles.
FEW = 32
#: Band of a tile that is not cut by size.
ANY_BAND = -1000
#: Bits of the tables that tell which sets or keys are needed (2 MB): they may let others through.
SPOTS = 1 << 24
SLOTS = 32_768


def size_band(n, percent: int = PERCENT):
    """Band of a set size: linked sets are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent) * 1.01)).cast("int")


# -- shingles, bitmaps and prefixes of texts ---------------------------------------------


def shingle_levels(docs: DataFrame, text: str, shingle: int = SHINGLE, counter_bits: int = COUNTER_BITS) -> bytes:
    """How common the shingles of each of ``2^counter_bits`` classes are in the whole table, on a log scale, one byte each.

    A task counts a class up to 255 times; sums go on from there.
    """
    n = 1 << counter_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.uint32)
        for batch in batches:
            for _, block in words.blocks(batch.column(0), TEXTS):
                hashes, _ = block.shingles(shingle)
                np.add.at(total, (hashes >> np.uint64(64 - counter_bits)).astype(np.int64), np.uint32(1))
        slabs = [zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 1) for x in total.reshape(SLABS, -1)]
        yield pa.RecordBatch.from_pydict({"slab": pa.array(range(SLABS), pa.int32()), "counts": pa.array(slabs, pa.binary())})

    def add(kind_in: type, kind_out: type):
        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for t in tables:
                for slab, packed in zip(t["slab"].to_pylist(), t["counts"].to_pylist()):
                    counts = np.frombuffer(zlib.decompress(packed), kind_in)
                    total[slab] = total.get(slab, np.zeros(n // SLABS, np.uint64)) + counts
            levels = total.values()
            if kind_out is np.uint8:
                levels = [np.minimum(2 * np.log2(1.0 + x), 255) for x in levels]
            packed = [zlib.compress(x.astype(kind_out).tobytes(), 1) for x in levels]
            yield pa.RecordBatch.from_pydict({"slab": pa.array(list(total), pa.int32()), "counts": pa.array(packed, pa.binary())})

        return run

    schema = "slab INT, counts BINARY"
    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, schema)
    # First each slab in parts, then whole: no task adds up more than a share of the tasks.
    parts = parts.repartition(SLABS, "slab", F.spark_partition_id() % 8).mapInArrow(add(np.uint8, np.uint32), schema)
    parts = parts.repartition(SLABS, "slab").mapInArrow(add(np.uint32, np.uint8), schema)
    found = {r.slab: zlib.decompress(bytes(r.counts)) for r in parts.collect()}
    return b"".join(found.get(s, bytes(n // SLABS)) for s in range(SLABS))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap: a bit for each class of shingles, on where the set has an odd number of them."""
    width = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    places = (hashes & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8), bitorder="little")


def _fold(bits: np.ndarray, n: int) -> np.ndarray:
    while len(bits) > n:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def within_bound(n: int, bits: bytes, m: int, other: bytes) -> bool:
    """False if the bitmaps show that the sets of ``n`` and ``m`` shingles overlap by less than 80 %.

    Sets differ in at least as many shingles as their bitmaps in bits.
    """
    x, y = np.frombuffer(bits, np.uint64), np.frombuffer(other, np.uint64)
    least = min(len(x), len(y))
    return _may_link(n + m, int(np.bitwise_count(_fold(x, least) ^ _fold(y, least)).sum()))


def _may_link(total, differ, percent: int = PERCENT):
    # |A n B| <= (total - differ) / 2 and links need (100 + percent) * |A n B| >= percent * total.
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _ids(batch: pa.RecordBatch, i: int, block: words.Block) -> pa.Array:
    return batch.column(0).slice(i, len(block))


def profiles(docs: DataFrame, levels: bytes, doc_id: str, text: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, digest, bits, probes, keys, typical`` of every row; nulls where the set is empty.

    ``typical`` is high for a set of common shingles: of a group of copies, for one with few changes.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        shift = np.uint64(64 - int(math.log2(len(level))))
        for batch in batches:
            for i, block in words.blocks(batch.column(1), TEXTS):
                hashes, at = block.shingles(shingle)
                sizes, digests, bits, probes, keys, typical = [], [], [], [], [], []
                for k in range(len(block)):
                    own = np.unique(hashes[at[k] : at[k + 1]])
                    n = len(own)
                    sizes.append(n)
                    if not n:
                        for column in (digests, bits, probes, keys, typical):
                            column.append(None)
                        continue
                    prefix = n - -(-percent * n // 100) + 1
                    levels_of = level[own >> shift]
                    key = own[np.argsort(levels_of, kind="stable")[:prefix]]
                    typical.append(float(levels_of.mean()))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bits.append(set_bits(own).tobytes())
                    probes.append(np.sort(words.mix(own))[:PROBES].view(np.int64))
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        _ids(batch, i, block),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bits, pa.binary()),
                        pa.array(probes, pa.list_(pa.int64())),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(typical, pa.float64()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bits", "probes", "keys", "typical"],
                )

    schema = f"doc_id {kind}, n_shingles BIGINT, digest BINARY, bits BINARY, probes ARRAY<BIGINT>, keys ARRAY<BIGINT>, typical DOUBLE"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(build, schema)


# -- pairs -------------------------------------------------------------------------------


def _spot(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SPOTS))


def _spots(spots: DataFrame) -> bytes:
    """A bitmap of the column ``spot``, of fixed size, built by partial aggregation."""
    maps = spots.groupBy(F.floor(F.col("spot") / SLOTS).alias("slab")).agg(F.bitmap_construct_agg(F.col("spot") % SLOTS).alias("bits"))
    table = np.zeros(SPOTS // 8, np.uint8)
    for r in maps.collect():
        table[r.slab * SLOTS // 8 : (r.slab + 1) * SLOTS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return zlib.compress(table.tobytes(), 1)


def _table(spots: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(spots), np.uint8)


def _on(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (table[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1


def _asked(rows: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``ids``: most others go before anything is shuffled."""
    wanted, schema = _spots(ids.select(_spot(name).alias("spot"))), rows.schema

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(wanted)
        for t in batches:
            yield t.filter(pa.array(_on(table, t["spot"].to_numpy()))).select(schema.names)

    return rows.withColumn("spot", _spot(name)).mapInArrow(some, schema).join(ids, name, "left_semi")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    schema = pairs.schema

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            columns = (t[c].to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))
            keep = [within_bound(*row) for row in zip(*columns)]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # First the few sets that are asked for: what is joined twice is then small and of known size.
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    asked = stored(_asked(sets.select("doc_id", "n_shingles", "bits"), ids), "asked-bits")
    side = lambda c: asked.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(test, schema).distinct()


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs that link, by the intersection of their sorted arrays.

    Only texts of ids in ``pairs`` are cut into shingles again.  A bitmap of fixed
    size tells which these are; the joins that follow are exact.
    """
    wanted = _spots(pairs.select(F.explode(F.array("a", "b")).alias("id")).select(_spot("id").alias("spot")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(wanted)
        for batch in batches:
            batch = batch.filter(pa.array(_on(table, batch.column(2).to_numpy())))
            for i, block in words.blocks(batch.column(1), TEXTS):
                hashes, at = block.shingles(shingle)
                sets = [np.unique(hashes[at[k] : at[k + 1]]).tobytes() for k in range(len(block))]
                yield pa.RecordBatch.from_arrays([_ids(batch, i, block), pa.array(sets, pa.binary())], names=["id", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t["hashes_a"].to_pylist(), t["hashes_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = docs.select("doc_id", F.col("text"), _spot("doc_id").alias("spot")).filter("doc_id IS NOT NULL")
    sets = sets.mapInArrow(cut, f"id {kind}, hashes BINARY")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}")), c)
    return pairs.mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def _star_pairs(sets: DataFrame, turn: int) -> DataFrame:
    """For each set one other, of another component: the centre that most of its probes name.

    The centre of a tile is its most typical set, in later turns that of a quarter of them.
    ``sets`` has ``doc_id, n_shingles, probes, typical, component``.
    """
    band = size_band(F.col("n_shingles")) if turn == 0 else size_band(F.col("n_shingles") * 9 / 8)
    rows = sets.select("doc_id", "component", "typical", band.alias("band"), F.explode("probes").alias("tile"))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(4 if turn else 1)) == 0
    centres = stored(
        rows.groupBy("tile", "band")
        .agg(
            F.max(F.struct(chosen.alias("chosen"), "typical", "doc_id", "component")).alias("c"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .filter("low < high")
        .select("tile", "band", F.col("c.doc_id").alias("b"), F.col("c.component").alias("other")),
        "centres",
    )
    votes = rows.join(centres, ["tile", "band"]).filter("component <> other").groupBy(F.col("doc_id").alias("a"), "b").count()
    return votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _tile_pairs(sets: DataFrame, classes: DataFrame | None, tile: int = TILE) -> DataFrame:
    """All pairs of different components that share a prefix shingle and, in tiles of more than two, pass the bitmap bound."""
    kind = sets.schema["doc_id"].dataType.simpleString()
    tiles = stored(
        sets.select("doc_id", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
        .filter("a < b"),
        "tiles",
    )
    twos = tiles.filter("n = 2").select("a", "b").distinct()
    for c in "ab":
        twos = _classed(twos, classes, c).withColumnRenamed("component", f"component_{c}")
    twos = twos.filter("component_a <> component_b").select("a", "b")

    more = tiles.filter("n > 2").select("key", "n", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    wanted = _spots(more.select(F.pmod("key", F.lit(SPOTS)).alias("spot")))

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(wanted)
        for t in batches:
            keys = t["keys"].flatten().to_numpy()
            row = np.repeat(np.arange(t.num_rows), pa.compute.list_value_length(t["keys"]).to_numpy())
            on = _on(table, keys & (SPOTS - 1))
            yield t.select(["doc_id", "n_shingles"]).take(pa.array(row[on])).append_column("key", pa.array(keys[on], pa.int64()))

    rows = sets.select("doc_id", "n_shingles", "keys").mapInArrow(in_tiles, f"doc_id {kind}, n_shingles BIGINT, key BIGINT")
    rows = stored(_classed(rows.join(more.hint("merge"), "key"), classes), "tile-rows")
    # Where all sets are of one component by now, nothing is left to do.
    mixed = stored(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "mixed-tiles")
    rows = stored(rows.join(mixed, "key", "left_semi"), "mixed-rows")
    order = ["key", "at", "i", "j"]
    few = rows.filter(F.col("n") <= min(FEW, tile)).selectExpr("*", f"{ANY_BAND} AS at", "0 AS part", "0 AS i", "0 AS j", "0 AS band")
    few = few.repartition(*order).sortWithinPartitions(*order)
    # A large tile is cut by size band, and its bands into blocks that are compared in pairs.
    many, band = rows.filter(F.col("n") > min(FEW, tile)), size_band(F.col("n_shingles"))
    bits = _asked(sets.select("doc_id", "n_shingles", "bits"), stored(many.select("doc_id").distinct(), "asked"))
    large = F.col("parts") > 1
    many = (
        many.join(bits, ["doc_id", "n_shingles"])
        .withColumn("band", band)
        .withColumn("at", F.explode(F.when(large, F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array(F.lit(ANY_BAND)))))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "with"))
        .withColumn("j", F.greatest("part", "with"))
        .repartition(*order)
        .sortWithinPartitions(*order)
    )

    def compare(t: pa.Table, n: np.ndarray, component: np.ndarray, i: int, j: int) -> Iterator[tuple]:
        m = j - i
        if m < 2:
            return
        size, comp = n[i:j], component[i:j]
        at, first, second = (t[c][i].as_py() for c in ("at", "i", "j"))
        part, band = (t[c].slice(i, m).to_numpy() for c in ("part", "band"))
        by_size = np.argsort(size, kind="stable")
        sizes = size[by_size]
        ids = t["doc_id"].slice(i, m).to_pylist()
        # Without bitmaps, pairs are bounded after they were made distinct.
        maps = [np.frombuffer(b, np.uint64) for b in t["bits"].slice(i, m).to_pylist()] if "bits" in t.schema.names else None
        for x in range(m):
            a = by_size[x]
            others = by_size[x + 1 : np.searchsorted(sizes, 100 * int(size[a]) // PERCENT, "right")]
            others = others[comp[others] != comp[a]]
            if at != ANY_BAND:
                others = others[np.minimum(band[others], band[a]) == at]
            if first != second:
                others = others[part[others] != part[a]]
            for b in others:
                if maps is not None:
                    least = min(len(maps[a]), len(maps[b]))
                    differ = int(np.bitwise_count(_fold(maps[a], least) ^ _fold(maps[b], least)).sum())
                    if not _may_link(int(size[a] + size[b]), differ):
                        continue
                if ids[a] != ids[b]:
                    yield (ids[a], ids[b]) if ids[a] < ids[b] else (ids[b], ids[a])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            cuts = _run_starts(t, order)
            rest = t.slice(cuts[-1])
            yield from out(t, cuts)
        if rest is not None:
            yield from out(rest.combine_chunks(), [0, len(rest)])

    def out(t: pa.Table, cuts) -> Iterator[pa.RecordBatch]:
        n, component = t["n_shingles"].to_numpy(), t["component"].to_numpy()
        found: set = set()
        for i, j in zip(cuts, cuts[1:]):
            found.update(compare(t, n, component, i, j))
            if len(found) > 100_000:
                yield _pair_batch(found)
                found = set()
        yield _pair_batch(found)

    pairs = f"a {kind}, b {kind}"
    return twos.unionByName(few.mapInArrow(scan, pairs)).unionByName(many.mapInArrow(scan, pairs)).distinct()


def _run_starts(t: pa.Table, columns: list[str]) -> list[int]:
    """Where the values of the columns change in a sorted table; 0 first."""
    change = np.zeros(max(0, len(t) - 1), bool)
    for c in columns:
        v = t[c].to_numpy()
        change |= v[1:] != v[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist()]


def _pair_batch(pairs: set) -> pa.RecordBatch:
    a, b = (pa.array([p[k] for p in pairs]) for k in (0, 1))
    if not pairs:
        a = b = pa.array([], pa.int64())
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


# -- the join ----------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = stored(profiles(docs, shingle_levels(docs, "text"), "doc_id", "text"), "profiles")
    some = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    groups = stored(
        some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal-sets"
    )
    members = every.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    members = stored(members.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")), "members")
    copies = members.filter("first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    # Representatives, once: the wide rows are shuffled by id for this, and not again.
    heads = members.filter("first = doc_id").select("doc_id").distinct()
    sets = stored(some.drop("digest").join(heads.hint("merge"), "doc_id", "left_semi"), "sets")

    links, classes = copies, None
    for turn in range(rounds):
        near = stored(_bounded(stored(_star_pairs(_classed(sets.select("doc_id", "n_shingles", "probes", "typical"), classes), turn), "pairs"), sets), "near")
        if near.isEmpty():
            break
        links = stored(links.unionByName(_confirmed(docs, near)), "links")
        classes = components(links)
    near = stored(_bounded(stored(_tile_pairs(sets, classes, tile), "pairs"), sets), "near")
    if not near.isEmpty():
        links = stored(links.unionByName(_confirmed(docs, near)), "links")
        classes = None
    if classes is None:
        classes = components(links)
    classes = classes.select(F.col("id").alias("doc_id"), "component")
    return members.join(classes, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _classed(rows: DataFrame, classes: DataFrame | None, name: str = "doc_id") -> DataFrame:
    """With the component known so far."""
    if classes is None:
        return rows.withColumn("component", F.col(name))
    own = classes.select(F.col("id").alias(name), "component")
    return rows.join(own, name, "left").withColumn("component", F.coalesce("component", name))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; rows with a null id stay."""
    found = jaccard_components(docs, doc_id, text)
    drop = stored(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "near-copies")
    return docs.join(drop, F.col(doc_id) == F.col("__id"), "left_anti")
