"""Coding pages as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from casework.operators.cases import case_records
from casework.operators.places import Names, prepared_names
from casework.operators.posts import all_posts
from casework.sources.case_store import CaseStore
from casework.sources.pages import PAGE_SCHEMA
from casework.sources.stores import CaseLog, append_posts


def page_stream(
    spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Page files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def code_arriving(
    pages: DataFrame,
    gazetteer: DataFrame | Names,
    log: CaseLog,
    checkpoint: str,
    order: str = "page_id",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Code each batch of arriving pages into the log, once; without a ``trigger`` stop when all is done.

    A batch writes only its own records, keyed by its number, so a restart after
    a failure repeats no effect; the log resolves repeated URLs when it is read.
    A log belongs to one checkpoint: a new one starts on an empty or compacted log.
    """

    names = gazetteer if isinstance(gazetteer, Names) else prepared_names(gazetteer)

    def store(batch: DataFrame, number: int) -> None:
        if number < max(log.batches(), default=number):
            raise ValueError("the log holds later batches of another stream; start on a compacted copy")
        log.append(case_records(batch, names, keep=(order,), **options), number, order)

    return _started(pages, store, checkpoint, trigger)


def code_new_arriving(
    pages: DataFrame,
    gazetteer: DataFrame | Names,
    store: CaseStore,
    checkpoint: str,
    order: str = "page_id",
    again: bool = False,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Code each batch of arriving pages into the table of cases, without the URLs that are in it.

    The table is the state by URL: a batch looks up its own URLs in the buckets that they fall into,
    and only pages that are left are coded.  ``again`` codes these too and lets valid records replace
    older ones.  The names are prepared once.  The table knows the batches of a checkpoint, so one that is
    run again after a failure changes nothing.
    """
    names = gazetteer if isinstance(gazetteer, Names) else prepared_names(gazetteer)

    def merge(batch: DataFrame, number: int) -> None:
        todo = batch if again else store.not_done(batch)
        store.upsert(case_records(todo, names, keep=(order,), **options), order, checkpoint, number)

    return _started(pages, merge, checkpoint, trigger)


def store_arriving_posts(
    pages: DataFrame, path: str, checkpoint: str, key: str | None = None, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Cut each batch of arriving pages into posts and store them by the number of the batch.

    A batch that is run again after a failure replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        append_posts(all_posts(batch, **options), path, number, key)

    return _started(pages, store, checkpoint, trigger)


def _started(pages: DataFrame, store, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
