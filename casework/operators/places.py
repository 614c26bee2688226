"""Gazetteers, and finding their names in texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import windows
from casework.functions.windows import Wanted
from casework.sources.work import work_dir

# Administrative suffixes that short city names may drop.
SUFFIXES = "市|县|区"

# Names are broadcast up to these bounds (some 30 MB in the driver and in a task), and shuffled beyond.
BROADCAST_NAMES, BROADCAST_CHARS = 100_000, 4_000_000
# Characters of a key gram, and how many characters from a key gram on are compared at once.
GRAM, AHEAD = 6, 32
BEHIND = AHEAD - GRAM
# Bytes of texts that are looked through together.
CHUNK = 1 << 18


def clean_gazetteer(names: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """Distinct ``kind, place`` from raw entries.

    Blanks go; a city loses its administrative suffix if two characters remain.
    """
    bare = F.replace(F.col(name), F.lit(" "), F.lit(""))
    short = F.regexp_replace(bare, SUFFIXES, "")
    entry = F.when((F.col(kind) == "city") & (F.length(short) >= 2), short).otherwise(bare)
    return (
        names.select(F.col(kind).alias("kind"), F.explode(F.split(entry, r"(?U)\s+")).alias("place"))
        .filter(F.col("place") != "")
        .distinct()
    )


def short_names(gazetteer: DataFrame) -> DataFrame:
    """Entries of a single character: kept, but worth a look."""
    return gazetteer.filter(F.length("place") < 2)


def best_place(places: Column) -> Column:
    """The longest name, the last in order among equals."""
    ranked = F.array_max(F.transform(places, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return ranked["p"]


@dataclass
class Names:
    """Stored names by what of them is compared at once, what tells a text where they may be, names longer than what is compared at once, and whether all may be broadcast."""

    rows: DataFrame
    wanted: Wanted
    long: bool
    fits: bool


def prepared_names(gazetteer: DataFrame) -> Names:
    """The names of a gazetteer with the gram by which texts look for them, stored for repeated use.

    A name of up to ``GRAM`` characters is its own gram.  A longer one is known by that of
    its grams which the fewest names have, so that a place in a text meets few names however many
    there are and however they begin.  ``seen`` are the characters around the gram, up to ``back`` before it, that
    are compared at once, ``key`` their hash, and ``whole`` says whether these are all of the name.
    """
    names = gazetteer.select("kind", "place").filter("place <> ''").groupBy("place").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    # Read three times below.
    names = _written(names, "gazetteer")
    short = names.filter(F.length("place") <= GRAM)
    grams = names.filter(F.length("place") > GRAM).select("place", "kinds", F.posexplode_outer(_grams(F.col("place"), GRAM)).alias("at", "gram"))
    # A few MB of names in files look broadcastable, and are some ten grams a name.
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).hint("merge")
    # The number of names and the place in one long: a plain minimum.
    rank = F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("bigint"))
    rarest = grams.join(shared, "gram").groupBy("place", "kinds").agg(F.min(rank).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"))
    place, at = F.col("place"), F.col("at")
    keyed = short.select("place", "kinds", F.col("place").alias("gram"), F.lit(0).alias("at")).unionByName(
        rarest.select("place", "kinds", F.substring(place, at + 1, F.lit(GRAM)).alias("gram"), "at")
    )
    back = F.least(at, F.lit(BEHIND))
    seen = F.substring(place, at - back + 1, back + AHEAD)
    rows = keyed.select("gram", "place", "kinds", back.alias("back"), seen.alias("seen"), (F.length(seen) == F.length(place)).alias("whole"))
    rows = _written(windows.with_key(rows, "seen"), "names")
    size = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.length("place") + F.length("seen")), F.lit(0)).alias("chars"),
        # A few hundred at most, as what is compared at once is short.
        F.collect_set(F.octet_length("seen")).alias("lengths"),
        F.coalesce(F.bool_or(~F.col("whole")), F.lit(False)).alias("long"),
    ).first()
    return Names(rows, windows.wanted(rows, "seen", size.n, size.lengths), size.long, size.n <= BROADCAST_NAMES and size.chars <= BROADCAST_CHARS)


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1))


def tag_places(pages: DataFrame, gazetteer: DataFrame | Names, text: Column) -> DataFrame:
    """Add ``places`` (all names in the text), ``city`` and ``county`` (one each), for a gazetteer of any size.

    ``gazetteer`` is one, or the names of :func:`prepared_names`.  A table of bits tells
    at which places of a text a name may be; those characters meet the names on
    equality of their hash and are then compared: only names that are there go on to be grouped by text.
    Names longer than what is compared at once are looked for in the text itself before that.

    Places belong to a text, not to a page: they are joined back on a digest of it,
    so pages without a URL, or several of one URL, keep their own places.
    """
    names = gazetteer if isinstance(gazetteer, Names) else prepared_names(gazetteer)
    marked = pages.withColumn("_text", F.coalesce(text, F.lit("")))
    marked = marked.withColumns({"_digest": F.xxhash64("_text"), "_also": F.xxhash64(F.lit(1), "_text")})
    found = _names_there(marked.select("_digest", "_also", "_text"), names)
    if names.long:
        # Texts are far larger than the files of their pages, by which they would be taken as small.
        found = found.filter("whole").unionByName(
            found.filter("NOT whole").distinct().join(marked.select("_digest", "_also", "_text").distinct().hint("merge"), ["_digest", "_also"])
            .filter(F.contains("_text", F.col("place"))).drop("_text")
        )
    found = found.groupBy("_digest", "_also").agg(F.collect_set(F.struct("place", *KINDS)).alias("_there"))
    tagged = marked.join(found, ["_digest", "_also"], "left").withColumn("_there", F.coalesce("_there", F.expr(NONE_THERE)))

    def best(kind: str) -> Column:
        own = F.filter("_there", lambda c: c[kind])
        return best_place(F.transform(own, lambda c: c["place"])).alias(kind)

    return tagged.select(
        *[F.col(c) for c in pages.columns],
        F.sort_array(F.transform("_there", lambda c: c["place"])).alias("places"),
        *map(best, KINDS),
    )


# Kinds of places that a text has one of.
KINDS = ("city", "county")
NONE_THERE = f"CAST(array() AS array<struct<place:string,{','.join(f'{k}:boolean' for k in KINDS)}>>)"


def _names_there(texts: DataFrame, names: Names) -> DataFrame:
    """``_digest, _also, place, whole`` and one flag a kind, of the names whose visible characters are in a text."""
    around = windows.candidates(texts.select("_digest", "_also", "_text"), "_text", names.wanted, CHUNK)
    # Each text has a name once, so a name that is in every text is as many narrow rows as there are texts.
    # Flags are all that a name in a text takes along of its kinds.
    rows = names.rows.select("key", "seen", "place", "whole", *[F.array_contains("kinds", k).alias(k) for k in KINDS])
    met = around.join(F.broadcast(rows) if names.fits else rows.hint("merge"), "key")
    there = F.substring("around", F.lit(1), F.length("seen")) == F.col("seen")
    return met.filter(there).select("_digest", "_also", "place", "whole", *KINDS)
