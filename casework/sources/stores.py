"""Writing cases and posts.

Cases are kept as a log of coded batches.  Appending touches only new data, a
batch that is run again replaces itself, and reading resolves the log to one row
per URL; compacting does the same once and stores the outcome elsewhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from casework.operators.cases import CASE_COLUMNS, CASE_SCHEMA, resolve
from casework.operators.posts import POST_SCHEMA, protect
from casework.sources.work import WORK_DIR, work_dir  # noqa: F401

HANDLE_KEY = "spark.casework.handleKey"
# Layouts in the order in which they are preferred, and the parts of a decimal that orders copies of a post.
LAYOUTS = ("1a", "1b", "2", "3")
WIDE = "decimal(38,0)"


class CaseLog:
    """Case records by batch under one path.

    Batches are numbered from 0 by the one stream (or job) that fills the log; a
    compacted log starts with batch ``BASE``, which no stream writes.
    """

    BASE = -1

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        """Numbers of the stored batches, at least those with records."""
        return _batches(self.records())

    def append(self, cases: DataFrame, batch: int, order: str) -> None:
        """Store a batch of records; running a batch again replaces it."""
        rows = cases.select(*CASE_COLUMNS, F.col(order).cast("bigint").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")

    def records(self) -> DataFrame:
        return _read(self.spark, self.path, f"{CASE_SCHEMA}, seq BIGINT, batch BIGINT")

    def current(self) -> DataFrame:
        """One row per URL, as upserting the batches in turn would leave it."""
        return resolve(self.records(), ("batch", "seq"))

    def compact(self, path: str) -> CaseLog:
        """The resolved cases as the base of a new log.

        The new log must lie elsewhere: a path is never overwritten while read.
        """
        target = CaseLog(self.spark, path)
        if target.path == self.path:
            raise ValueError("compact into another path")
        target.append(self.current().withColumn("seq", F.lit(0)), self.BASE, "seq")
        return target


def append_posts(posts: DataFrame, path: str, batch: int, key: str | None = None, raw: bool = False) -> int:
    """Store a batch of posts and return how many rows were written; running it again replaces it.

    Account names are hashed with ``key`` or the session setting unless ``raw``
    is asked for; the count is observed during the write, not in a second pass.
    A digest of the unmasked post, hashed with the same key, tells copies apart from posts that only look
    alike when masked; ``current_posts`` reads it.
    """
    secret = "" if raw else key or posts.sparkSession.conf.get(HANDLE_KEY, "")
    posts = posts.withColumn("digest", _post_digest(secret))
    if not raw:
        posts = protect(posts, secret)
    seen = Observation()
    rows = posts.observe(seen, F.count("*").alias("rows"))
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch)}")
    return seen.get["rows"]


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """All stored posts with their batch; none if nothing was stored yet."""
    return _read(spark, path, f"{POST_SCHEMA}, batch BIGINT")


def current_posts(spark: SparkSession, path: str) -> DataFrame:
    """Each stored post once, with its batch: that of the first batch, there of the first layout and place.

    Copies are found on narrow rows (two halves of the digest, a decimal for the order, the place in the file)
    that hash aggregation reduces before and after the shuffle, so a post stored very often is no burden.  Wide
    rows are only read again without those that lost; while these are few, AQE broadcasts them and the wide rows
    stay where they are.  Rows stored without a digest are compared by what is stored.  NULLs are values.
    """
    try:
        files = spark.read.schema(f"{POST_SCHEMA}, digest STRING, batch BIGINT").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{POST_SCHEMA}, batch BIGINT")
    columns = [c for c in files.columns if c != "digest"]
    place = _number(F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 62) - 1)), F.col("_metadata.row_index"))
    digest = F.coalesce("digest", _post_digest(""))
    narrow = files.select(
        *[F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "_one"), (16, "_two"))],
        _rank().alias("_rank"),
        place.alias("_row"),
    )
    several = (
        narrow.groupBy("_one", "_two", "_rank")
        .agg(F.min("_row").alias("_row"), F.count("*").alias("_n"))
        # Ranks differ by now, so there is one smallest.
        .groupBy("_one", "_two")
        .agg(F.min_by("_row", "_rank").alias("_first"), F.sum("_n").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    lost = narrow.join(several, ["_one", "_two"]).filter("_row <> _first").select("_row")
    return files.withColumn("_row", place).join(lost, "_row", "left_anti").select(*columns)


def _post_digest(key: str) -> Column:
    fields = F.to_json(F.struct("url", "nickname", "post"), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(key), fields), 256)


def _number(high: Column, low: Column) -> Column:
    """Two numbers below 2^62 and 2^63 as one that orders by the first."""
    return (high.cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast(WIDE)


def _rank() -> Column:
    """Order of the copies of a post: batch, layout and place as far as 62 bits go, then a digest of the rest."""
    layout = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LAYOUTS]), F.col("layout")), F.lit(0))
    known = F.when(layout == 0, len(LAYOUTS)).otherwise(layout - 1)
    seq = F.coalesce("post_seq", F.lit(0)).cast("bigint")
    rest = F.xxhash64("layout", "source_post_id", "images").bitwiseAND(F.lit((1 << 31) - 1))
    high = F.coalesce("batch", F.lit(0)) * len(LAYOUTS + ("",)) + known
    return _number(high, seq * (1 << 31) + rest)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _batches(rows: DataFrame) -> list[int]:
    return sorted(r.batch for r in rows.select("batch").distinct().collect())
