"""A table with gap-free ids that lets in only rows that keep its constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from casework.operators import ranks
from casework.operators.cases import CASE_COLUMNS
from casework.sources.work import work_dir

ACCEPTED, QUARANTINED = "accepted", "quarantined"
DUPLICATE, STORED = "duplicate", "stored"


def checked(rows: DataFrame, order: str, required: tuple[str, ...] = CASE_COLUMNS, key: str = "url", taken: DataFrame | None = None, last: int = 0) -> DataFrame:
    """The rows with ``id, state, reasons``.

    A row is quarantined when a required column is NULL (``null_<column>``), when a row before it in ``order`` that
    lacks nothing has the same key (``duplicate``), or when the key is in ``taken`` (``stored``).  The others are
    numbered from ``last + 1`` without gaps in that order.  ``order`` must differ from row to row and not be NULL.
    A NULL key is a value of its own where the key is not required.  First rows are found by partial aggregation
    of keys and orders, ids by ranges, and wide rows are joined once, by ``order``; no task holds the rows of a key.
    """
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"null_{c}")) for c in required]) if required else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    complete = rows.filter(_complete(required)).groupBy(F.col(key).alias("_url")).agg(F.min(order).alias("_order"))
    if taken is None:
        fresh = complete
    else:
        old = taken.select(F.col(key).alias("_old"))
        same = F.col("_url").eqNullSafe(F.col("_old"))
        fresh = complete.join(old, same, "left_anti")
        known = complete.join(old, same, "left_semi").select(F.col("_order").alias("_known"))
    ids = ranks.ahead(fresh, "_order").select("_key", (F.col("_ahead") + last + 1).cast("bigint").alias("id"))
    rows = rows.join(ids, F.col(order) == F.col("_key"), "left")
    reason = F.lit(DUPLICATE)
    if taken is not None:
        rows = rows.join(known, F.col(order) == F.col("_known"), "left")
        reason = F.when(F.col("_known").isNotNull(), STORED).otherwise(DUPLICATE)
    others = F.when(F.size(missing) > 0, missing).otherwise(F.array(reason))
    accepted = F.col("id").isNotNull()
    return rows.select(
        *[c for c in rows.columns if c not in ("_key", "_known")],
        F.when(accepted, ACCEPTED).otherwise(QUARANTINED).alias("state"),
        F.when(~accepted, others).alias("reasons"),
    )


def _complete(required: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return ok


class GuardedTable:
    """Accepted rows with ids, and the rows that were kept out with their reasons, in numbered batches.

    One writer at a time; the batches must be inserted in turn.  Inserting the last batch again replaces it, with
    the same ids; an earlier one is refused, since later ids build on it.
    """

    def __init__(self, spark: SparkSession, path: str, required: tuple[str, ...] = CASE_COLUMNS, key: str = "url"):
        self.spark, self.path, self.required, self.key = spark, path.rstrip("/"), required, key

    def _stored(self, batch: int) -> list[str]:
        return [f"{self.path}/batch={n}" for n in range(batch)]

    def _read(self, batches: int) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*self._stored(batches))

    def insert(self, rows: DataFrame, batch: int, order: str) -> dict[str, int]:
        """Store a batch; counts of accepted and quarantined rows and of each reason, observed while writing.

        Only the keys and the largest id of earlier batches are read.  The rows are stored once in the shared folder
        before they are checked, so that costly ones are worked out once and every step sees the same.
        """
        taken, last = None, 0
        if self._exists(batch + 1):
            raise ValueError("a later batch is stored already")
        if batch:
            earlier = self._read(batch).filter(F.col("state") == ACCEPTED)
            taken = earlier.select(self.key)
            last = earlier.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first().last
        arrived = work_dir(self.spark, "arrived")
        rows.write.parquet(arrived)
        rows = self.spark.read.parquet(arrived)
        marked = checked(rows, order, self.required, self.key, taken, last)
        seen = Observation()
        names = [f"null_{c}" for c in self.required] + [DUPLICATE, STORED]
        marked.observe(
            seen,
            F.count_if(F.col("state") == ACCEPTED).alias(ACCEPTED),
            F.count_if(F.col("state") == QUARANTINED).alias(QUARANTINED),
            *[F.count_if(F.array_contains("reasons", name)).alias(name) for name in names],
        ).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")
        return seen.get

    def _exists(self, batch: int) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def rows(self) -> DataFrame:
        """The accepted rows with their ids."""
        return self._all().filter(F.col("state") == ACCEPTED).drop("state", "reasons")

    def quarantine(self) -> DataFrame:
        """The rows that were kept out, with their reasons."""
        return self._all().filter(F.col("state") == QUARANTINED).drop("state", "id")
