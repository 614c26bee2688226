"""Derived WARC records: from each response a metadata record and a plain-text conversion.

A derived record names its response (``WARC-Refers-To``, with target and date), keeps
all header lines of the source (in the metadata record) and its own digests, else new
digests of the response's payload and block, and has its own identifier, a digest of
what it is derived from: deriving again gives the same records.  Every record follows
from its response alone, so the work is a map over the responses without a shuffle.

Files are written and read as text with a record separator, so that Spark splits and
retries them like any others.

Defined results: a response without a block, or with a null one, has an empty payload;
a block without a blank line has no payload but headers; a null target or date leaves its
header out; rows are derived one by one, repeated or not; an empty table gives an empty
table; columns named like the results are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.functions.markup import unescape

VERSION = "WARC/1.1"
#: Begin of the version lines that are read.
FAMILY = "WARC/1."
CRLF = "\r\n"
END = CRLF + CRLF
RECORD = "record_id, record_type, target_uri, date, content_type, block"

# Elements whose text is never read, and elements that end a line. One begin before all choices, and no
# way back where none can help: places without a ``<`` cost one comparison.
HIDDEN = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|head\b.*?</head\s*>|!--.*?-->)"
LINES = r"(?i)</?+(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre)\b[^>]*+>"
TAG = r"<[^>]*+>"


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(data, F.lit("")).cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid from a digest of the parts."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str, url: str = "url", html: str = "html") -> DataFrame:
    """Response records of stored pages: a success message with the page as its payload."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    return pages.select(
        record_id(F.lit("response"), F.col(url), F.lit(date), body).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(url).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        F.concat(head, body).alias("block"),
    )


def plain_text(html: Column) -> Column:
    """Visible text: one line for each block element, entities resolved, blanks and empty lines squeezed."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), LINES, "\n")
    lines = F.split(unescape(F.regexp_replace(text, TAG, "")), "\n", -1)
    lines = F.transform(lines, lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _head(names: list[tuple[str, Column]], block: Column) -> Column:
    """Named header lines; one without a value is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v)) for n, v in names]
    return F.concat_ws(CRLF, F.lit(VERSION), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))


def _header(name: str) -> Column:
    """A header of the source record, its name in any case; null without one."""
    found = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(found, F.lit(1))["value"]


def _source_lines() -> Column:
    """Header lines of the source, each as a field: of the HTTP message as they stand, and of the WARC record."""
    # A folded line belongs to the one before.
    lines = F.split(F.regexp_replace("http", r"\r?\n[ \t]+", " "), r"\r?\n")
    lines = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x != "")
    http = F.transform(lines, lambda x: F.concat(F.lit("sourceHttpHeader: "), x))
    entries = F.array_sort(F.map_entries("headers"))
    warc = F.transform(entries, lambda e: F.concat(F.lit("sourceWarcHeader: "), e["key"], F.lit(": "), e["value"]))
    return F.concat(http, F.coalesce(warc, F.array().cast("array<string>")))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``record_id, record_type, refers_to, target_uri, date, content_type, block, block_digest, payload_digest, head``.

    Where ``records`` have the map ``headers`` of their source, as ``read_warc`` gives it, its own digests are kept.
    """
    source = F.col("headers") if "headers" in records.columns else F.lit(None).cast("map<string,string>")
    rows = records.select(*[c.strip() for c in RECORD.split(",")], source.alias("headers")).filter(F.col("record_type") == "response")
    at = F.instr(F.coalesce("block", F.lit("")), END)
    rows = rows.withColumn("block", F.coalesce("block", F.lit(""))).withColumn("at", at)
    rows = rows.withColumn("http", F.when(F.col("at") > 0, F.expr("substring(block, 1, at - 1)")).otherwise(F.col("block")))
    payload = F.when(F.col("at") > 0, F.expr("substring(block, at + 4)")).otherwise(F.lit(""))
    rows = rows.withColumn("payload", payload).withColumn("payload_digest", F.coalesce(_header("WARC-Payload-Digest"), digest(F.col("payload"))))
    rows = rows.withColumn("source_digest", F.coalesce(_header("WARC-Block-Digest"), digest(F.col("block"))))
    rows = rows.withColumn("source_lines", _source_lines())
    title = unescape(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    # An entity may stand for a line break, which would end the field.
    title = F.regexp_replace(title, r"\s+", " ")
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("httpStatus: "), F.regexp_extract("http", r"^HTTP/\S+ (\d+)", 1)),
        F.concat(F.lit("sourceContentType: "), F.regexp_extract("http", r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)),
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("language: "), F.regexp_extract("payload", r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)),
        F.concat(F.lit("outlinks: "), F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href=")).cast("string")),
        F.concat(F.lit("sourcePayloadDigest: "), F.col("payload_digest")),
        F.when(F.size("source_lines") > 0, F.array_join("source_lines", CRLF)),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = rows.select(F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", "source_digest", F.explode(kinds).alias("k"))
    rows = rows.select("refers_to", "target_uri", "date", "payload_digest", "source_digest", "k.*")
    rows = rows.withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to"))).withColumn("block_digest", digest(F.col("block")))
    head = _head(
        [
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Date", F.col("date")),
            ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Refers-To-Target-URI", F.col("target_uri")),
            ("WARC-Refers-To-Date", F.col("date")),
            ("WARC-Block-Digest", F.col("block_digest")),
            ("WARC-Source-Block-Digest", F.col("source_digest")),
            ("WARC-Source-Payload-Digest", F.col("payload_digest")),
            ("Content-Type", F.col("content_type")),
        ],
        F.col("block"),
    )
    return rows.withColumn("head", head).select(
        "record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "block", "block_digest", "payload_digest", "head"
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``head`` and ``block`` of records as WARC files, one for each partition."""
    value = F.concat("head", F.lit(END), "block")
    records.select(value.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``head, block, complete, headers`` of the records of WARC files; ``complete`` tells that the length is as declared.

    Records are told apart by the version line after a blank line, of any WARC/1 version.
    """
    rows = spark.read.option("lineSep", f"{END}{FAMILY}").text(path)
    # What is left of the version line: its last number.
    line = f"^(?:{FAMILY})?([0-9]+){CRLF}"
    text = F.regexp_replace(F.regexp_replace("value", line, ""), f"{END}$", "")
    rows = rows.select(F.concat(F.lit(FAMILY), F.regexp_extract("value", line, 1)).alias("version"), text.alias("t")).withColumn("at", F.instr("t", END))
    rows = rows.select("version", F.expr("substring(t, 1, at - 1)").alias("head"), F.expr("substring(t, at + 4)").alias("block"))
    pairs = F.transform(F.split("head", CRLF), lambda x: F.split(x, ": ", 2))
    headers = F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(p[0], p[1])))
    rows = rows.withColumn("headers", headers)
    length = F.try_element_at("headers", F.lit("Content-Length")).try_cast("bigint")
    return rows.select(F.concat("version", F.lit(CRLF), "head").alias("head"), "block", "headers", F.coalesce(length == F.octet_length("block"), F.lit(False)).alias("complete"))
