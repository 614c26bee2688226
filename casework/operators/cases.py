"""Case records: one coded event per page, their upsert and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import coding, markup
from casework.operators.filters import valid_record
from casework.operators.places import Names, tag_places
from casework.operators.urls import normalise

# Container classes in the order they are tried.
CONTAINERS = ("article-content entry-content", "content")

CASE_SCHEMA = (
    "url STRING, date DATE, date_raw STRING, city STRING, county STRING, headline STRING, "
    "content STRING, keyword1 STRING, keyword2 STRING, people INT"
)
CASE_COLUMNS = (
    "url", "date", "date_raw", "city", "county", "headline", "content", "keyword1", "keyword2", "people",
)


def headline(html: Column, unescape: bool = False) -> Column:
    """Text of the first title on one line; NULL without a title."""
    title = F.when(
        F.rlike(html, F.lit(r"(?i)<title[\s>]")),
        markup.squeeze(markup.strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)(?:</title|\z)", 1))),
    )
    return markup.unescape(title) if unescape else title


def container(labelled: Column, classes: tuple[str, ...] = CONTAINERS) -> Column:
    """Content of the first container found, classes tried in order."""
    return F.coalesce(*[markup.first_div(labelled, c, exact=False) for c in classes])


def page_texts(
    pages: DataFrame,
    classes: tuple[str, ...] = CONTAINERS,
    unescape: bool = False,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Other columns of the pages plus ``headline`` and ``content``."""
    keep = [c for c in pages.columns if c not in (url, html)]
    labelled = pages.select(
        *keep,
        normalise(F.col(url)).alias("url"),
        headline(F.col(html), unescape).alias("headline"),
        markup.label(markup.clean(F.col(html))).alias("_labelled"),
    )
    content = markup.strip_tags(container(F.col("_labelled"), classes))
    return labelled.select(
        *keep, "url", "headline", (markup.unescape(content) if unescape else content).alias("content")
    )


def case_records(
    pages: DataFrame,
    gazetteer: DataFrame | Names,
    classes: tuple[str, ...] = CONTAINERS,
    compat: bool = False,
    keep: tuple[str, ...] = (),
    unescape: bool = False,
) -> DataFrame:
    """One case per page: date, places, keywords, headline, text and head count.

    Every field but the places is computed inside the row; places are joined to
    pieces of the texts.  ``keep`` names page columns to carry along.
    """
    texts = page_texts(pages.select("url", "html", *keep), classes, unescape)
    tagged = tag_places(texts, gazetteer, F.concat_ws("\n", "headline", "content"))
    head, content = F.col("headline"), F.col("content")
    return tagged.select(
        *keep,
        "url",
        coding.headline_date(head).alias("date"),
        coding.headline_date_raw(head).alias("date_raw"),
        "city",
        "county",
        "headline",
        "content",
        coding.keyword1(head).alias("keyword1"),
        coding.keyword2(head).alias("keyword2"),
        coding.people(content, compat).alias("people"),
    )


def with_sentinels(cases: DataFrame) -> DataFrame:
    """All fields as text, missing ones as ``none``, ``None`` or ``NA``."""
    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c)
    rest = [c for c in cases.columns if c not in CASE_COLUMNS]
    return cases.select(
        *rest,
        "url",
        F.coalesce(F.col("date").cast("string"), "date_raw", F.lit("None")).alias("date"),
        text("city", "none"),
        text("county", "none"),
        text("headline", "None"),
        text("content", "None"),
        text("keyword1", "none"),
        text("keyword2", "none"),
        text("people", "NA"),
    )


def resolve(records: DataFrame, order: tuple[str, ...], is_old: Column | None = None) -> DataFrame:
    """One record per URL out of a history of records.

    The last valid record wins; without one, the stored record stays; a new URL
    without any valid record keeps its first one.  This is what inserting the
    records one by one, and updating only with valid ones, leaves behind.  Copies
    of a URL are reduced before the shuffle, so a frequent URL makes no large task.
    """
    old = F.coalesce(is_old, F.lit(False)) if is_old is not None else F.lit(False)
    valid = valid_record(F.col("headline"), F.col("content"))
    fields = [c for c in CASE_COLUMNS if c != "url"]
    rank = F.when(old, 1).when(valid, 2).otherwise(0)
    place = [F.when(rank == 0, -F.col(c)).otherwise(F.col(c)).alias(c) for c in order]
    best = F.max_by(
        F.struct(*fields), F.struct(rank.alias("rank"), *place, F.xxhash64(*fields).alias("digest"))
    ).alias("best")
    resolved = records.filter(F.col("url").isNotNull()).groupBy("url").agg(best)
    return resolved.select("url", *[F.col("best")[c].alias(c) for c in fields])


def upsert(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Stored cases with new records merged in by URL.

    ``stored`` has one row per URL; ``new`` may hold several, ``order`` (a number)
    tells which came later.  One union and one aggregation: a single shuffle.
    """
    rows = (
        stored.select(*CASE_COLUMNS)
        .withColumn("_order", F.lit(0).cast("bigint"))
        .withColumn("_old", F.lit(True))
        .unionByName(
            new.select(*CASE_COLUMNS, F.col(order).cast("bigint").alias("_order")).withColumn("_old", F.lit(False))
        )
    )
    return resolve(rows, ("_order",), F.col("_old"))


def constraint_report(
    rows: DataFrame, required: tuple[str, ...] = CASE_COLUMNS, unique: bool = True, key: str = "url"
) -> DataFrame:
    """``check, violations``: missing values per column, and keys that occur again.

    Posts are checked with ``required=POST_REQUIRED, unique=False``.
    """
    per_key = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    )
    repeated = F.count_if((F.col("n") > 1) & F.col(key).isNotNull())
    total = per_key.agg(
        *([F.coalesce(repeated, F.lit(0)).alias(f"duplicate_{key}")] if unique else []),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in required],
    )
    return total.unpivot([], total.columns, "check", "violations")
