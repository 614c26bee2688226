"""URLs: normalising, choosing, reading ids, and what is still to be processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def normalise(url: Column) -> Column:
    """URL without line breaks and surrounding blanks."""
    return F.trim(F.regexp_replace(url, r"[\r\n]", ""))


def of_site(url: Column, site: str, excluded_host: str | None = None) -> Column:
    """URL contains the site name and not the excluded host."""
    keep = F.contains(url, F.lit(site))
    return keep & ~F.contains(url, F.lit(excluded_host)) if excluded_host else keep


def post_id(url: Column) -> Column:
    """Number of the post in its URL: the fifth part, or the head of the last part."""
    parts = F.split(url, "/")
    return (
        F.when(F.contains(url, F.lit("post")), F.get(parts, F.lit(4)))
        .otherwise(F.split_part(F.element_at(parts, -1), F.lit("_"), F.lit(1)))
        .try_cast("bigint")
    )


def _urls(df: DataFrame, column: str) -> DataFrame:
    return df.select(normalise(F.col(column)).alias("url")).filter(F.col("url").isNotNull()).distinct()


def frontier(candidates: DataFrame, done: DataFrame, column: str = "url") -> DataFrame:
    """Distinct candidate URLs that are not done yet.

    Both sides are made distinct first: copies of one URL collapse before the
    shuffle, and the anti-join reuses the partitioning by URL.
    """
    return _urls(candidates, column).join(_urls(done, column), "url", "left_anti")


def progress(candidates: DataFrame, done: DataFrame, column: str = "url") -> DataFrame:
    """One row: entries done and URLs remaining."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = done.select(one.alias("done"), zero.alias("remaining")).unionByName(
        frontier(candidates, done, column).select(zero.alias("done"), one.alias("remaining"))
    )
    return rows.agg(
        F.coalesce(F.sum("done"), zero).alias("done"),
        F.coalesce(F.sum("remaining"), zero).alias("remaining"),
    )
