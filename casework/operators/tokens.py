"""Token table: the tags and texts of each page in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casework.functions import markup
from casework.functions.arrays import running_sum


# A tag (a quoted value may hold a bracket), a text, or a bracket that opens no tag.
TOKEN = r"""<[/!?A-Za-z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|<[^<>]+>|[^<]+|<"""


def token_table(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """One row per token: ``idx, kind, tag, attrs, text, div_depth``.

    ``kind`` is open, close or text; ``div_depth`` counts the ``div`` elements
    around (and, for its own tags, including) the token.  The depth is a running
    sum inside the row, so pages are never shuffled.
    """
    tokens = F.regexp_extract_all(markup.clean(F.col(html)), F.lit(TOKEN), F.lit(0))
    # A closing tag still lies in its element, so the step down comes one token later.
    ups = F.transform(F.col("names"), lambda n: F.when(n == "div", 1).otherwise(0))
    downs = F.concat(
        F.array(F.lit(0)),
        F.transform(F.col("names"), lambda n: F.when(n == "/div", 1).otherwise(0)),
    )
    steps = F.zip_with(ups, F.slice(downs, F.lit(1), F.size("names")), lambda up, down: up - down)
    rows = (
        pages.select(*keys, tokens.alias("tokens"))
        .withColumn(
            "names",
            F.transform("tokens", lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))),
        )
        .select(*keys, "tokens", running_sum(steps).alias("depths"))
        .select(*keys, F.posexplode(F.arrays_zip("tokens", "depths")).alias("idx", "token"))
    )
    raw = F.col("token.tokens")
    is_tag = F.startswith(raw, F.lit("<")) & (F.length(raw) > 1)
    return rows.select(
        *keys,
        "idx",
        F.when(~is_tag, "text").when(F.startswith(raw, F.lit("</")), "close").otherwise("open").alias("kind"),
        F.when(is_tag, F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))).alias("tag"),
        F.when(is_tag, F.trim(F.regexp_extract(raw, r"^<[A-Za-z][A-Za-z0-9]*(.*?)/?>$", 1))).alias("attrs"),
        F.when(~is_tag, raw).alias("text"),
        F.col("token.depths").alias("div_depth"),
    )
