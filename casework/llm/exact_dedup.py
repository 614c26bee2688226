"""Exact copies: frequent digests apart, the rest by an ordinary shuffle.

A Misra-Gries summary (``approx_top_k``, the frequent-items sketch) finds digests
that may hold many rows.  Their groups are counted exactly with a partial
aggregation and are then broadcast, so the rows of a large group are decided
where they lie.  Only the other digests are shuffled; none of these is large.

Which digests the summary names decides the cost only: both ways give the same
rows, so its error never shows in the result.

Defined results: a null text counts as empty; null ids come last among equals; of
rows with the same text and the same id one stays; an empty table gives an empty
table; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.llm.work import stored

#: Most digests that are treated as frequent, and so the most rows that are broadcast.
FREQUENT = 1000
#: Counters of the summary: it misses no digest with more than about one row in so many.
COUNTERS = 16_384
#: Copies below which a group is left to the shuffle.
LEAST_COPIES = 32


def normalised(text: Column) -> Column:
    """Runs of the six ASCII white-space characters become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def frequent_digests(rows: DataFrame, frequent: int = FREQUENT, least: int = LEAST_COPIES) -> DataFrame:
    """``text_sha256, group_size, first`` of at most ``frequent`` digests, counted exactly."""
    top = rows.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {COUNTERS})").alias("top"))
    named = top.select(F.inline("top")).filter(F.col("count") >= least).select(F.col("item").alias("text_sha256"))
    return _groups(rows.join(F.broadcast(named), "text_sha256", "left_semi"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_order()).alias("first"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, least: int = LEAST_COPIES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``."""
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_digest(F.col(text)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    winners = stored(frequent_digests(rows, frequent, least), "frequent")
    large = rows.join(F.broadcast(winners), "text_sha256").select(*rows.columns, "group_size", "first")
    group = Window.partitionBy("text_sha256")
    small = (
        rows.join(F.broadcast(winners), "text_sha256", "left_anti")
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("first", F.min(_order()).over(group))
        .select(*rows.columns, "group_size", "first")
    )
    return large.unionByName(small).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without copies; all columns stay.

    Only the dropped ids are joined.  An id with several rows is the exception: its
    kept texts are looked up by digest, and one row of each stays.
    """
    groups = stored(copy_groups(docs, doc_id, text), "copies")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept_rows"))
    ids = stored(ids.filter("rows > kept_rows OR rows > 1"), "dropped")
    mark = "__text_sha256"
    one = docs.join(ids.select(F.col("doc_id").alias("__id")), F.col(doc_id).eqNullSafe(F.col("__id")), "left_anti")
    several = ids.filter("rows > 1 AND kept_rows > 0").select("doc_id")
    if several.isEmpty():
        return one
    texts = groups.filter("kept").join(several, groups.doc_id.eqNullSafe(several.doc_id), "left_semi")
    again = (
        docs.withColumn(mark, text_digest(F.col(text)))
        .join(
            texts.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept")),
            F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__kept")),
            "left_semi",
        )
        .dropDuplicates([doc_id, mark])
        .drop(mark)
    )
    return one.unionByName(again)
