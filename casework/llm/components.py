"""Connected components of an edge table, without collecting any of it.

Alternates two contractions: every node hands its larger neighbours, then its
smaller ones, to the least node it knows.  Each halves the distance to the least
node of the component, so a few rounds end with one star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casework.llm.work import stored


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id that has a link; the least id names its component (and has no row)."""
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    rows = stored(rows, "edges")
    before = _summary(rows)
    while True:
        rows = stored(_small(_large(rows)), "edges")
        after = _summary(rows)
        if after == before:
            return rows.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after
