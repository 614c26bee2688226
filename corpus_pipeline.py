"""A corpus pipeline of five stages: language, exact copies, near copies, source mix, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with
their columns; the last adds the pieces of each text.  Every stage is written before
the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casework.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_codec
from casework.llm.queries import piece_model
from casework.llm.work import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that go to a Python worker together: whole texts, several copies of which are in memory at once.
ROWS = "1000"


def _modest(spark: SparkSession) -> None:
    """Smaller batches for Python workers, where the session asks for no size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from the labels in ``docs``."""
    _modest(spark)
    return language_id.identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    _modest(spark)
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _modest(spark)
    return jaccard_join.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    _modest(spark)
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, and whether these give the text back."""
    _modest(spark)
    return sentencepiece_codec.round_trip(docs, piece_model(spark)).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", source_mix),
    ("sentencepiece", piece_ids),
]

#: Language ID, the draws of the mix and the pieces are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
