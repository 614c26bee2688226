"""Places in an order, without a task that holds all keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casework.sources.work import work_dir


def ahead(df: DataFrame, key: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``_key, _n, _ahead``: each value of a key, its rows, and the rows with smaller values; NULL comes first.

    Values with their counts are cut into ranges and stored; the sums of the ranges (one row for each) give what
    lies ahead of a range, and the sums within it the rest.  ``start`` and ``stop`` choose values that have rows at
    these places, and only ranges that hold such rows are sorted.
    """
    spark = df.sparkSession
    path = work_dir(spark, "ranges")
    order = F.col("_key").asc_nulls_first()
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    counts.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    sums = stored.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    def within(rows: DataFrame, first: str, count: str) -> DataFrame:
        if start is not None:
            rows = rows.filter(F.col(first) + F.col(count) > start)
        return rows if stop is None else rows.filter(F.col(first) < stop)

    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: as many as the shuffle has partitions.
    placed = stored.join(F.broadcast(within(ranges, "_before", "_rows")), "_range").withColumn(
        "_ahead", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    return within(placed, "_ahead", "_n").select("_key", "_n", "_ahead")


def bounds(df: DataFrame, start: int, stop: int | None) -> tuple[int, int | None]:
    """Places from the beginning; counts the rows only where one is given from the end."""
    if start >= 0 and (stop is None or stop >= 0):
        return start, stop
    total = df.count()
    return (max(0, start + total) if start < 0 else start), (max(0, stop + total) if stop is not None and stop < 0 else stop)
