"""The table of cases, one row per URL, kept in buckets.

Rows lie in one file for each bucket of a hash of their URL.  A manifest, one small file with a
number, names the live file of every bucket and the batches that are in them.  An upsert
reads and writes the buckets that its URLs fall into, and no others; it becomes visible
when its manifest appears, all at once.  A writer that is lost before that leaves files that
no manifest names, and the old table as it was; of two writers with the same base the second
fails and may be run again.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from casework.operators.cases import CASE_COLUMNS, CASE_SCHEMA
from casework.operators.filters import valid_record
from casework.operators.urls import normalise
from casework.sources.pages import read_urls

#: Buckets of a new table: so many that a bucket is a few hundred megabytes.
BUCKETS = 64
#: URLs of a batch that are broadcast.
BROADCAST_URLS, BROADCAST_CHARS = 1_000_000, 100_000_000
ROW = f"{CASE_SCHEMA}, bucket INT"


@dataclass
class Manifest:
    """One version of the table."""

    number: int = 0
    buckets: int = BUCKETS
    files: dict[int, str] = field(default_factory=dict)
    #: The last batch of each stream that is in the table.
    streams: dict[str, int] = field(default_factory=dict)
    #: Folders of records without a URL.
    aside: list[str] = field(default_factory=list)


class CaseStore:
    """Cases under one path, read as of the last manifest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- manifests

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return sorted(str(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def manifest(self) -> Manifest:
        """The last whole one; one that a lost writer left unfinished does not count."""
        for name in reversed([n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]):
            text = self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()
            try:
                found = json.loads(text.value) if text else {}
                return Manifest(found["number"], found["buckets"], {int(b): f for b, f in found["files"].items()}, found["streams"], found["aside"])
            except (ValueError, KeyError):
                continue
        return Manifest(buckets=self.buckets)

    def _commit(self, manifest: Manifest) -> None:
        """Write the next manifest; fails if there is one of that number already."""
        taken = [int(n[: -len(".json")]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]
        if [n for n in taken if n > manifest.number] and self.manifest().number != manifest.number:
            raise RuntimeError("another writer was faster; run the upsert again")
        number = max([manifest.number, *taken]) + 1
        body = {"number": number, "buckets": manifest.buckets, "files": manifest.files, "streams": manifest.streams, "aside": manifest.aside}
        fs, file = self._fs(f"{self.path}/manifest/{number:020d}.json")
        out = fs.create(file, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()

    # -- reading

    def _read(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        files = [f for b, f in manifest.files.items() if buckets is None or b in buckets]
        return self.spark.read.schema(ROW).parquet(*files) if files else self.spark.createDataFrame([], ROW)

    def current(self) -> DataFrame:
        """One row per URL."""
        return self._read(self.manifest()).drop("bucket")

    def without_url(self) -> DataFrame:
        """Records that came without a URL."""
        folders = self.manifest().aside
        return self.spark.read.schema(CASE_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], CASE_SCHEMA)

    def urls(self, buckets: list[int] | None = None) -> DataFrame:
        """URLs that are in the table, or in some of its buckets; only that column is read."""
        files = [f for b, f in self.manifest().files.items() if buckets is None or b in buckets]
        return read_urls(self.spark, *files) if files else self.spark.createDataFrame([], "url STRING")

    def bucket(self, url: str):
        return F.pmod(F.xxhash64(url), F.lit(self.manifest().buckets)).cast("int")

    def not_done(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """The pages whose URL is not in the table; only URLs of the buckets that they fall into are read."""
        keys = pages.select(normalise(F.col(url)).alias("url")).filter("url IS NOT NULL").distinct()
        met = keys.groupBy(self.bucket("url").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length("url")).alias("chars")).collect()
        todo = keys.join(self.urls([r.bucket for r in met]), "url", "left_anti").select(F.col("url").alias("_todo"))
        # The URLs of a usual batch are few, and its pages stay where they are.
        few = sum(r.n for r in met) <= BROADCAST_URLS and sum(r.chars for r in met) <= BROADCAST_CHARS
        todo = F.broadcast(todo) if few else todo.hint("shuffle_hash")
        return pages.join(todo, normalise(F.col(url)) == F.col("_todo"), "left_semi")

    # -- writing

    def upsert(self, new: DataFrame, order: str, stream: str | None = None, batch: int | None = None) -> dict[str, int]:
        """Merge new records in by URL; of a URL with several, ``order`` (a number) tells which came later.

        The last valid record wins; without one, the stored record stays; a new URL
        without any valid record keeps its first one.  Which record wins is settled on
        narrow rows; the texts are then picked by a hash join and are never sorted.
        A batch of a stream that is in the table already is left out.  Records without a
        URL are kept apart (:meth:`without_url`).  Returns how many there were of each.
        """
        now = self.manifest()
        if stream is not None and batch is not None and batch <= now.streams.get(stream, -1):
            return {"rows": 0, "without_url": 0, "buckets": 0}
        version = uuid.uuid4().hex
        fields = [c for c in CASE_COLUMNS if c != "url"]
        staged, seen = f"{self.path}/staged/{version}", Observation()
        rows = new.select(*CASE_COLUMNS, F.col(order).cast("bigint").alias("seq")).withColumns(
            {
                "bucket": F.pmod(F.xxhash64("url"), F.lit(now.buckets)).cast("int"),
                "valid": valid_record(F.col("headline"), F.col("content")),
                "digest": F.xxhash64(*fields),
                "row": F.monotonically_increasing_id(),
            }
        )
        rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("url").isNull()).alias("without_url")).write.parquet(staged)
        counts = dict(seen.get)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        if counts["without_url"]:
            now.aside.append(f"{self.path}/aside/{version}")
            rows.filter("url IS NULL").select(*CASE_COLUMNS).write.parquet(now.aside[-1])
        rows = rows.filter("url IS NOT NULL")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if touched:
            self._merged(rows, self._read(now, touched)).repartitionById(now.buckets, "bucket").write.parquet(f"{self.path}/data/{version}")
            # A file of the folder holds the bucket with its number.
            for name in self._names(f"{self.path}/data/{version}"):
                part = re.match(r"part-(\d+)-", name)
                if part and int(part[1]) in touched:
                    now.files[int(part[1])] = f"{self.path}/data/{version}/{name}"
        if stream is not None and batch is not None:
            now.streams[stream] = batch
        self._commit(now)
        fs, folder = self._fs(staged)
        fs.delete(folder, True)
        return counts | {"buckets": len(touched)}

    @staticmethod
    def _merged(rows: DataFrame, old: DataFrame) -> DataFrame:
        """Old and new rows that stay."""
        place = F.when(F.col("valid"), F.col("seq")).otherwise(-F.col("seq"))
        rank = F.when(F.col("valid"), 2).otherwise(0)
        none = F.lit(0).cast("bigint")
        narrow = rows.select("url", F.struct(rank.alias("rank"), place.alias("place"), "digest", "row").alias("key"))
        narrow = narrow.unionByName(
            old.select("url", F.struct(F.lit(1).alias("rank"), none.alias("place"), none.alias("digest"), (none - 1).alias("row")).alias("key"))
        )
        won = narrow.groupBy("url").agg(F.max("key").alias("key")).select("url", F.col("key.row").alias("row")).filter("row >= 0")
        columns = [*CASE_COLUMNS, "bucket"]
        chosen = rows.join(won.select("row").hint("shuffle_hash"), "row", "left_semi").select(columns)
        return old.join(won.select("url").hint("shuffle_hash"), "url", "left_anti").select(columns).unionByName(chosen)

    def vacuum(self) -> int:
        """Remove data that the last manifest does not name; no one may be reading an older version or writing."""
        now, gone = self.manifest(), 0
        live = {f.rsplit("/", 2)[-2] for f in now.files.values()} | {f.rsplit("/", 1)[-1] for f in now.aside}
        for kind in ("data", "aside", "staged"):
            for name in self._names(f"{self.path}/{kind}"):
                if kind == "staged" or name not in live:
                    fs, folder = self._fs(f"{self.path}/{kind}/{name}")
                    gone += bool(fs.delete(folder, True))
        return gone
