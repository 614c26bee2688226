"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.operators import ranks

# Headlines that mark an error page, the default platform, and the
# lengths below which a post is noise when it holds a mention or a link.
ERROR_WORDS = ("Service", "Hotspot")
PLATFORM, PLATFORM_DOMAIN, OTHER_DOMAIN = "weibo", "weibo.com", "qq.com"
MENTION_LENGTH, LINK_LENGTH = 10, 28


def mentions_keyword(text: Column, keyword: str, ignore_case: bool = False) -> Column:
    """Text contains a keyword; ``ignore_case`` takes letters of either case as equal."""
    if ignore_case:
        escaped = keyword.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        return text.ilike(f"%{escaped}%")
    return F.contains(text, F.lit(keyword))


def valid_record(headline: Column, content: Column, sentinels: bool = False) -> Column:
    """A record may replace an older one: no error headline, and a content.

    With ``sentinels`` missing values are the word None instead of NULL.
    """
    ok = content.isNotNull()
    for word in ERROR_WORDS:
        ok = ok & ~F.contains(F.coalesce(headline, F.lit("")), F.lit(word))
    if sentinels:
        ok = ok & ~F.contains(content, F.lit("None"))
    return F.coalesce(ok, F.lit(False))


def worth_keeping(post: Column, domain: str = PLATFORM_DOMAIN) -> Column:
    """Short posts are noise when they hold a mention, longer ones when a link."""
    return (
        F.when(F.length(post) < MENTION_LENGTH, ~F.contains(post, F.lit("@")))
        .when(F.length(post) < LINK_LENGTH, ~F.contains(post, F.lit(domain)))
        .otherwise(True)
    )


def author_link(link: Column, platform: str = PLATFORM, other: str = OTHER_DOMAIN) -> Column:
    """Markup of a link leads to an author on the platform."""
    return F.coalesce(F.contains(link, F.lit(platform)) & ~F.contains(link, F.lit(other)), F.lit(False))


def slice_rows(df: DataFrame, key: str, start: int = 12, stop: int | None = 100) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` in the order of a key; places below 0 count from the end, no ``stop`` is the end.

    The order is settled on the keys and their counts, by ranges, so no task sorts more than a range of narrow
    rows; the wide rows are then picked by a join.  Of rows that share a key at either end the first by a digest
    of all columns are taken; equal rows are interchangeable, so the number of rows is always exact.  (The rows of such a key, two keys at most, are
    numbered in one task each.)
    """
    if start >= 0 and stop is not None and 0 <= stop < start:
        raise ValueError("start <= stop is required")
    start, stop = ranks.bounds(df, start, stop)
    picked = ranks.ahead(df, key, start, stop)
    rows = df.join(picked, F.col(key).eqNullSafe(F.col("_key")))
    # Only keys that reach over an end need to be numbered.
    whole = (F.col("_ahead") >= start) & (F.lit(True) if stop is None else F.col("_ahead") + F.col("_n") <= stop)
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*df.columns), *df.columns)) - 1 + F.col("_ahead")
    cut = rows.filter(~whole).withColumn("_place", place).filter(F.col("_place") >= start)
    cut = cut if stop is None else cut.filter(F.col("_place") < stop)
    return rows.filter(whole).select(df.columns).unionByName(cut.select(df.columns))
