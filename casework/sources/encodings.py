"""Pages as bytes in any of the usual encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Byte order marks, and labels of encodings with the Java names by which they are read.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
LABELS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-8", "utf-16le": "UTF-8", "utf-16be": "UTF-8",
    "gb2312": "GB18030", "gbk": "GB18030", "x-gbk": "GB18030", "gb18030": "GB18030", "gb_2312-80": "GB18030",
    "big5": "Big5-HKSCS", "big5-hkscs": "Big5-HKSCS", "cn-big5": "Big5-HKSCS",
    "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252",
    "us-ascii": "windows-1252", "windows-1252": "windows-1252", "cp1252": "windows-1252",
    "shift_jis": "Shift_JIS", "sjis": "Shift_JIS", "euc-jp": "EUC-JP", "euc-kr": "EUC-KR",
}
CHARSETS = tuple(dict.fromkeys([*(name for _, name in MARKS), *LABELS.values()]))
# A declaration counts in the first part of a page.
HEAD = 1024
META = r"""(?is)<meta\s[^>]*charset\s*=\s*["']?\s*([a-z0-9_:.-]+)"""
SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


@contextmanager
def all_charsets(spark: SparkSession) -> Iterator[None]:
    """All charsets of Java for the expressions that are built within; the session is as before afterwards."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name in SETTINGS:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def declared(content: Column) -> Column:
    """Charset of a page: its byte order mark, else its meta declaration, else UTF-8; NULL for an unknown label."""
    start = F.hex(F.substring(content, 1, 3))
    label = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"), META, 1))
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    found = F.when(label == "", "UTF-8").otherwise(F.try_element_at(names, label))
    for mark, charset in reversed(MARKS):
        found = F.when(F.startswith(start, F.lit(mark)), charset).otherwise(found)
    return found


def with_text(rows: DataFrame, content: str = "content", html: str = "html", default: str | None = None) -> DataFrame:
    """The rows with ``charset`` and ``html``; ``html`` is NULL where the bytes do not fit their charset.

    ``default`` takes the place of UTF-8 where nothing is declared.  A byte order mark is no part of the text.
    NULL bytes give NULL, empty bytes an empty text.
    """
    spark, raw = rows.sparkSession, F.col(content)
    charset = declared(raw)
    if default:
        silent = (F.regexp_extract(F.decode(F.substring(raw, 1, HEAD), "ISO-8859-1"), META, 1) == "") & ~_marked(raw)
        charset = F.when(silent, default).otherwise(charset)
    with all_charsets(spark):
        found = rows.withColumn("charset", F.when(raw.isNotNull(), charset))
        text = _by_charset(F.col("charset"), lambda name: _read(raw, name), (*CHARSETS, *([default] if default else [])))
        return found.withColumn(html, F.regexp_replace(text, "^\ufeff", ""))


def _marked(raw: Column) -> Column:
    start = F.hex(F.substring(raw, 1, 3))
    marked = F.lit(False)
    for mark, _ in MARKS:
        marked = marked | F.startswith(start, F.lit(mark))
    return marked


def _by_charset(charset: Column, read: Callable[[str], Column], names: tuple[str, ...]) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in dict.fromkeys(names):
        chain = chain.when(charset == name, read(name))
    return chain


def _read(raw: Column, charset: str) -> Column:
    if charset == "UTF-8":
        return F.try_validate_utf8(raw.cast("string"))
    text = F.decode(raw, charset)
    # What can't be read comes out as the replacement character, which none of these bytes stands for otherwise.
    return F.when(~F.contains(text, F.lit("\ufffd")), text)


def read_encoded_pages(
    spark: SparkSession, path: str, pattern: str = "*.html", default: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Page files as ``url, charset, html``, each by its own encoding, and ``url, charset`` of those set aside.

    Empty files give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    pages = with_text(files.select(F.col("path").alias("url"), "content"), default=default).drop("content")
    return pages.filter(F.col("html").isNotNull()), pages.filter(F.col("html").isNull()).drop("html")
