"""Reading pages, URL lists and gazetteers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.operators.places import clean_gazetteer

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(path)


def read_page_files(spark: SparkSession, path: str, encoding: str = "UTF-8", pattern: str = "*.html") -> DataFrame:
    """Stored page files as ``url, html``, the URL being the file's location.

    Broken UTF-8 is replaced instead of failing the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding == "UTF-8" else F.decode("content", encoding)
    return files.load(path).select(F.col("path").alias("url"), text.alias("html"))


def read_urls(spark: SparkSession, *paths: str) -> DataFrame:
    """URLs of a stored table, or of some of its files; only that column is read."""
    return spark.read.parquet(*paths).select("url")


def read_gazetteer(spark: SparkSession, cities: str, counties: str) -> DataFrame:
    """``kind, place`` from two headerless CSV files with the name in the first column."""
    entries = [
        spark.read.schema("name STRING").csv(path).select(F.lit(kind).alias("kind"), "name")
        for kind, path in (("city", cities), ("county", counties))
    ]
    return clean_gazetteer(reduce(DataFrame.unionByName, entries).filter(F.col("name").isNotNull()))
