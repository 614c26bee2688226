"""Lines that many sites share (boilerplate), found by sketches and removed.

A line counts by its digest; the digests of all lines are made once and stored.  Each digest and site is first reduced to one row where
it lies; a HyperLogLog sketch of the sites then merges by aggregation.  A line whose
estimate is clearly above or below the threshold is decided by it; near the threshold
its sites are counted exactly.  Shared lines are removed from every text.

A line that a third of all rows hold is one row per task after the first reduction,
so no task gathers its occurrences.

Defined results: lines are what lies between ``\\n``; runs of ASCII white space in a
line count as one space and its ends are trimmed, blank lines are never shared; a null
site is no site; a null text stays null and an emptied one is empty; rows with the same
id are worked on one by one; an empty table gives an empty table; columns named like
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.llm.work import stored

#: Sites from which on a line is boilerplate.
SITES = 5
#: Size of a sketch (2^10 registers), and the relative error that leaves a line undecided: three deviations.
LG_K = 10
NEAR = 0.1


#: Runs of white space within a line that are not one space already.
_BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, " ")


def _digest(line: Column) -> Column:
    return F.when(line != "", F.unhex(F.substring(F.sha2(line.cast("binary"), 256), 1, 32)))


def line_key(line: Column) -> Column:
    """Digest of a line; null for a blank one."""
    return _digest(F.trim(_squeezed(line)))


def _line_keys(text: Column) -> Column:
    """``line_key`` of each line of a text, whose blanks are squeezed at once."""
    lines = F.transform(F.split(_squeezed(text), "\n", -1), lambda x: F.trim(x))
    return F.transform(lines, lambda x: _digest(x))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed_lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """``text, site, keys``: for each row a digest of its text and one of each line, made once for all that follows."""
    return stored(docs.select(_text_key(F.col(text)).alias("text"), F.col(site).cast("string").alias("site"), _line_keys(F.col(text)).alias("keys")), "lines")


def shared_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, near: float = NEAR, lg_k: int = LG_K) -> DataFrame:
    """``key, n_sites`` of the lines on at least ``sites`` sites; ``n_sites`` is an estimate unless it is near."""
    return _shared(keyed_lines(docs, text, site), sites, near, lg_k)


def _shared(keyed: DataFrame, sites: int, near: float, lg_k: int = LG_K) -> DataFrame:
    lines = keyed.filter("site IS NOT NULL").select("site", F.explode("keys").alias("key"))
    pairs = stored(lines.filter("key IS NOT NULL").groupBy("key", "site").agg(F.count("*").alias("n")).drop("n"), "line-sites")
    # Most lines are on one site and need no sketch.
    several = pairs.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a < b").select("key")
    some = pairs.join(several, "key", "left_semi")
    found = some.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    found = stored(found.select("key", F.hll_sketch_estimate("sketch").alias("n_sites")).filter(F.col("n_sites") >= sites * (1 - near)), "spread")
    sure = found.filter(F.col("n_sites") > sites * (1 + near))
    close = found.filter(F.col("n_sites") <= sites * (1 + near)).select("key")
    exact = pairs.join(close, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= sites)
    return sure.unionByName(exact)


def without_shared_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, near: float = NEAR) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, and ``n_lines, n_removed``."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*rest)
    keyed = keyed_lines(docs, text, site)
    shared = stored(_shared(keyed, sites, near).select("key"), "shared-lines")
    # Which lines to drop, by the digest of the whole text: texts are joined on that, copies of a text need one row.
    lines = keyed.select(F.col("text").alias("__text"), F.posexplode("keys").alias("place", "key")).filter("key IS NOT NULL")
    hits = lines.join(shared, "key", "left_semi").select("__text", "place").distinct()
    hits = stored(hits.groupBy("__text").agg(F.collect_set("place").alias("__drop")), "lines-to-drop")
    out = docs.withColumn("__text", _text_key(F.col(text))).join(hits, "__text", "left").withColumn("__lines", F.split(F.col(text), "\n", -1))
    # By the places that are left, so a text takes time by its lines, not by its lines times those dropped.
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    return out.select(
        *[F.when(F.col("__drop").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in rest],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("bigint").alias("n_removed"),
    )
