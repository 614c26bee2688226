"""Uniform random samples of exactly n rows, without replacement."""

from __future__ import annotations

import itertools
import math
import re
import secrets

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from casework.sources.work import work_dir

SCORE_RANGE = 1 << 60


def check_table(name: object) -> str:
    """Table name made of ASCII letters, digits and underscores."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError("table name must consist of letters, digits and underscores")
    return name


def check_size(n: object) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError("sample size must be a non-negative integer")
    return n


def score(key: Column, seed: int) -> Column:
    """Reproducible uniform number of a row, 60 bits of a digest of key and seed."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows with the smallest scores; all rows if there are fewer.

    ``key`` must be unique and not NULL.  The score of the n-th row is found
    first, reading the key column only: two cuts around the expected place are
    counted, and just the rows between them are ordered.  The sample itself is
    then a plain filter, so no task ever holds more than its share of it.
    """
    check_size(n)
    total = df.count()
    if total <= n:
        return df
    if n == 0:
        return df.limit(0)
    mark = score(F.col(key), seed)
    marks = df.select(mark.alias("_score"), F.col(key).alias("_key"))
    share, spread = n / total, (6 * math.sqrt(n) + 10) / total
    low = int(max(0.0, share - spread) * SCORE_RANGE)
    high = int(min(1.0, share + spread) * SCORE_RANGE)
    below = marks.agg(
        F.count_if(F.col("_score") < low).alias("low"), F.count_if(F.col("_score") < high).alias("high")
    ).first()
    # The cuts nearly always enclose the n-th row; if not, the outer range does.
    if below.low >= n:
        begin, end, before = 0, low, 0
    elif below.high >= n:
        begin, end, before = low, high, below.low
    else:
        begin, end, before = high, SCORE_RANGE, below.high
    last = (
        marks.filter((F.col("_score") >= begin) & (F.col("_score") < end))
        .orderBy("_score", "_key")
        .offset(n - before - 1)
        .limit(1)
        .first()
    )
    return df.filter(
        (mark < last["_score"]) | ((mark == last["_score"]) & (F.col(key) <= F.lit(last["_key"])))
    )


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random rows of a table without a key.

    Every row draws a number, and only rows below a cut, n and a few more, are stored in the shared folder, so that
    the draw is one and the same for all that follows.  A draw with fewer than n or more than ``most_stored`` such
    rows is thrown away and repeated (one in a few hundred); that depends on how many they are, not on which, so
    every set of n rows stays equally likely.  Numbers are all different (a row number breaks ties), which makes
    the sample that of a keyed table: a plain filter, with no task that holds n rows.
    """
    check_size(n)
    total = df.count()
    if total <= n:
        return df
    if n == 0:
        return df.limit(0)
    start = secrets.randbits(31) if seed is None else seed
    share = (n + 3 * math.sqrt(n) + 5) / total
    for attempt in itertools.count():
        path = work_dir(df.sparkSession, "draw")
        number = F.struct(F.rand(start + attempt).alias("number"), F.monotonically_increasing_id().alias("row"))
        drawn = df.withColumn("_draw", number).filter(F.col("_draw.number") < share)
        seen = Observation()
        drawn.withColumn("_draw", F.format_string("%.17f %020d", "_draw.number", "_draw.row")).observe(
            seen, F.count("*").alias("rows")
        ).write.parquet(path)
        if n <= seen.get["rows"] <= max(most_stored(n), total * (share >= 1)):
            return sample_n(df.sparkSession.read.parquet(path), n, "_draw", start).drop("_draw")


def most_stored(n: int) -> int:
    """Rows that ``sample_rows`` stores at most of a larger table."""
    return int(n + 6 * math.sqrt(n) + 10)


def sample_table(spark: SparkSession, table: str, n: int, seed: int | None = None) -> DataFrame:
    """n random rows of a catalog table."""
    return sample_rows(spark.table(check_table(table)), n, seed)
