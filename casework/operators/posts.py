"""Cutting pages that quote microblog posts into one row per post.

All layouts are worked out inside the page row: the page becomes an array of
units (blocks or paragraphs), boundaries cut the array into runs, and each run
is one post.  So a single scan serves every layout and nothing is shuffled until
the posts, which are much smaller than the pages, are made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import markup
from casework.functions.arrays import filled, first_nonblank, let, nonblank, split_after, split_before
from casework.operators.filters import (
    OTHER_DOMAIN, PLATFORM, PLATFORM_DOMAIN, author_link, mentions_keyword, worth_keeping,
)
from casework.operators.urls import normalise, post_id

# The classes that mark the parts of quoted posts.
TEXT_UNIT, INFO_UNIT, MESSAGE, USER_NAME = "WB_text", "WB_info", "msgCnt", "userName"
NAME_LINK, NAME_LINK_2 = "WB_name S_func1", "con_name_txt S_txt1"
NAME_CLASSES = ("WB_name", "S_func1")
CONTAINER = "content"

MENTION = r"@[\p{L}\p{N}_-]+"

POST_TYPE = (
    "array<struct<layout:string,post_seq:int,nickname:string,post:string,images:array<string>>>"
)
POST_REQUIRED = ("url", "source_post_id", "nickname", "post")
POST_SCHEMA = (
    "url STRING, source_post_id BIGINT, layout STRING, post_seq INT, nickname STRING, post STRING, "
    "images ARRAY<STRING>"
)


def _first_found(items: Column, find) -> Column:
    """First non-empty result over the items; it may still be blank."""
    return F.get(F.filter(F.transform(items, find), lambda x: x != ""), F.lit(0))


def _post(layout: str, seq: Column, name: Column, pieces: Column, images: Column, sep: str = "") -> Column:
    return F.struct(
        F.lit(layout).alias("layout"),
        seq.cast("int").alias("post_seq"),
        nonblank(name).alias("nickname"),
        nonblank(F.array_join(pieces, sep)).alias("post"),
        F.filter(F.flatten(images), lambda i: i != "").alias("images"),
    )


def _field(run: Column, name: str) -> Column:
    return F.transform(run, lambda u: u[name])


def _links(block: Column) -> Column:
    return markup.child_links(markup.drop_divs(block))


def page_nickname(infos: Column, texts: Column, ps: Column) -> Column:
    """Name of the first post on a page: five places, the first that is not blank."""
    return first_nonblank(
        _first_found(infos, lambda i: markup.anchor_text(_links(i), NAME_LINK)),
        _first_found(infos, lambda i: markup.anchor_text(_links(i))),
        _first_found(texts, lambda t: markup.anchor_text(_links(t))),
        _first_found(
            F.flatten(F.transform(infos, lambda i: markup.divs(i, USER_NAME))),
            lambda d: markup.unescape(F.regexp_extract(d, r"(?:^|>)([^<>]+)", 1)),
        ),
        _first_found(ps, lambda p: markup.anchor_text(markup.child_links(p), NAME_LINK)),
    )


def layout_1a(infos: Column, texts: Column, page_name: Column) -> Column:
    """Text blocks; one that holds a name link ends a post and names the next."""

    def unit(block: Column) -> Column:
        return let(
            markup.drop_divs(block, MESSAGE),
            lambda own: F.struct(
                _first_found(
                    markup.divs(block, INFO_UNIT), lambda i: markup.anchor_text(_links(i), NAME_LINK)
                ).alias("next_name"),
                markup.own_text(own, ("span", "div")).alias("text"),
                markup.own_images(own, ("div",)).alias("images"),
            ),
        )

    def posts(runs: Column) -> Column:
        return F.transform(
            runs,
            lambda run, k: _post(
                "1a",
                k,
                F.when(k == 0, page_name).otherwise(F.element_at(F.get(runs, k - 1), -1)["next_name"]),
                _field(run, "text"),
                _field(run, "images"),
            ),
        )

    units = F.transform(texts, unit)
    found = let(split_after(units, lambda u: u["next_name"].isNotNull()), posts)
    return F.when((F.size(infos) > 0) & (F.size(texts) > 0), found)


def layout_1b(infos: Column, texts: Column, page_name: Column, domain: str, other: str) -> Column:
    """Info blocks alone: an author link starts a post, later blocks add to it."""

    def unit(info: Column, k: Column) -> Column:
        return let(
            markup.drop_divs(info),
            lambda own: let(
                markup.anchor(markup.child_links(own), attr="href"),
                lambda link: F.struct(
                    author_link(link, domain, other).alias("author"),
                    markup.anchor_text(link).alias("name"),
                    F.when(author_link(link, domain, other), markup.own_text(own))
                    .when(link.isNotNull() | (F.size(markup.images(info)) > 0) | (k < 2), "")
                    .otherwise(markup.own_text(own))
                    .alias("text"),
                    F.when(link.isNull(), markup.images(info)).otherwise(F.array()).alias("images"),
                ),
            ),
        )

    runs = split_before(F.transform(infos, unit), lambda u: u["author"])
    found = F.transform(
        runs,
        lambda run, k: _post(
            "1b",
            k,
            F.when(k == 0, page_name).otherwise(F.get(run, F.lit(0))["name"]),
            _field(run, "text"),
            _field(run, "images"),
        ),
    )
    return F.when((F.size(infos) > 0) & (F.size(infos) > F.size(texts)), found)


def layout_2(ps: Column) -> Column:
    """Paragraphs of the page: a name link starts a post."""

    def unit(p: Column) -> Column:
        return let(
            markup.anchor_text(markup.child_links(p), NAME_LINK_2),
            lambda name: F.struct(
                F.when(name != "", name).alias("name"),
                F.when((name != "") | (F.size(markup.images(p)) > 0), "")
                .otherwise(markup.unescape(markup.strip_tags(p)))
                .alias("text"),
                F.when(name == "", markup.images(p)).otherwise(F.array()).alias("images"),
            ),
        )

    runs = split_before(F.transform(ps, unit), lambda u: u["name"].isNotNull())
    found = F.transform(
        runs,
        lambda run, k: _post(
            "2", k, F.when(k > 0, F.get(run, F.lit(0))["name"]), _field(run, "text"), _field(run, "images")
        ),
    )
    return F.when(F.exists(ps, lambda p: markup.anchor_text(markup.child_links(p), NAME_LINK_2) != ""), found)


def has_real_text(text: Column) -> Column:
    """Some word is longer than one character and no mention."""
    return F.exists(
        F.split(text, " "),
        lambda t: (F.length(t) > 1) & (F.substring(t, 1, 1) != "@") & (F.substring(t, 2, 1) != "@"),
    )


def layout_3(container_ps: Column, platform: str, other: str) -> Column:
    """Paragraphs of the container: an author link opens a post.

    The open post goes on instead while it has no text yet (the link's paragraph
    is then its text) or holds mentions only (the link is one more mention).
    """

    def unit(p: Column) -> Column:
        text = markup.squeeze(markup.own_text(p, ("span", "em"), " "))
        return let(
            markup.anchor(markup.child_links(p), attr="href"),
            lambda link: F.struct(
                F.when(link.isNull(), "body")
                .when(author_link(link, platform, other), "open")
                .when(F.contains(link, F.lit(platform)), "skip")
                .otherwise("stop")
                .alias("kind"),
                first_nonblank(
                    markup.anchor_text(link),
                    markup.unescape(F.regexp_extract(link, r"(?is)<a(?=[\s>])[^>]*>\s*<span[^>]*>([^<]+)", 1)),
                ).alias("link_text"),
                filled(text).alias("text"),
                F.when(link.isNull(), markup.images(p)).otherwise(F.array()).alias("images"),
            ),
        )

    def segment(run: Column) -> Column:
        stop = F.array_position(_field(run, "kind"), F.lit("stop"))
        collected = F.when(stop > 0, F.slice(run, F.lit(1), (stop - 1).cast("int"))).otherwise(run)
        return let(
            F.filter(collected, lambda u: u["kind"] == "body"),
            lambda body: F.struct(
                F.get(run, F.lit(0))["link_text"].alias("link_text"),
                F.get(run, F.lit(0))["text"].alias("own"),
                F.concat_ws(" ", _field(body, "text")).alias("body"),
                F.flatten(_field(body, "images")).alias("images"),
            ),
        )

    def state(text: Column) -> Column:
        return F.when(text == "", "empty").when(has_real_text(text), "real").otherwise("mentions")

    def step(acc: Column, seg: Column) -> Column:
        joins = F.when(acc["named"] & (acc["state"] == "empty"), "own").when(
            acc["named"] & (acc["state"] == "mentions"), "link"
        )
        return F.struct(
            F.when(joins == "own", state(F.concat_ws(" ", seg["own"], filled(seg["body"]))))
            .when(joins == "link", F.when(has_real_text(seg["body"]), "real").otherwise("mentions"))
            .otherwise(state(seg["body"]))
            .alias("state"),
            F.when(joins.isNotNull(), acc["named"]).otherwise(is_name(seg["link_text"])).alias("named"),
            F.concat(acc["joins"], F.array(joins)).alias("joins"),
        )

    def is_name(text: Column) -> Column:
        # A site address is no name.
        return F.coalesce(~F.contains(text, F.lit(".com")), F.lit(False))

    def joined(segments: Column) -> Column:
        start = F.struct(
            F.lit("real").alias("state"), F.lit(False).alias("named"), F.array().cast("array<string>").alias("joins")
        )
        pieces = F.zip_with(
            segments,
            F.reduce(segments, start, step, lambda acc: acc["joins"]),
            lambda seg, joins: F.struct(
                joins.isNull().alias("opens"),
                F.when(is_name(seg["link_text"]), seg["link_text"]).alias("name"),
                nonblank(
                    F.concat_ws(
                        " ",
                        F.when(joins == "own", seg["own"]).when(joins == "link", seg["link_text"]),
                        filled(seg["body"]),
                    )
                ).alias("text"),
                seg["images"].alias("images"),
            ),
        )
        return F.transform(
            split_before(pieces, lambda u: u["opens"], keep_head=False),
            lambda run, k: _post(
                "3", k + 1, F.get(run, F.lit(0))["name"], _field(run, "text"), _field(run, "images"), " "
            ),
        )

    runs = split_before(F.transform(container_ps, unit), lambda u: u["kind"] == "open", keep_head=False)
    return let(F.transform(runs, segment), joined)


def page_posts(
    pages: DataFrame,
    layouts: tuple[str, ...] = ("1a", "1b", "2", "3"),
    platform: str = PLATFORM,
    domain: str = PLATFORM_DOMAIN,
    other: str = OTHER_DOMAIN,
    filter_1b: bool = True,
) -> DataFrame:
    """One row per quoted post, before posts found by several layouts are merged.

    ``filter_1b=False`` leaves the noise filter out for layout 1b.
    """
    marked = pages.filter(mentions_keyword(F.col("html"), platform)).select(
        normalise(F.col("url")).alias("url"), markup.label(markup.clean(F.col("html"))).alias("_page")
    )
    page = F.col("_page")
    boxes = markup.divs(page, CONTAINER)
    blocks = marked.select(
        "url",
        markup.divs(page, INFO_UNIT).alias("_infos"),
        markup.divs(page, TEXT_UNIT).alias("_texts"),
        markup.paragraphs(page).alias("_ps"),
        # First container without a script, else the first one.
        let(
            boxes,
            lambda b: F.coalesce(
                F.get(F.filter(b, lambda x: ~F.contains(x, F.lit("<script"))), F.lit(0)), F.get(b, F.lit(0))
            ),
        ).alias("_box"),
    ).withColumn("_name", page_nickname(F.col("_infos"), F.col("_texts"), F.col("_ps")))
    infos, texts, ps, name = (F.col(c) for c in ("_infos", "_texts", "_ps", "_name"))
    # Without a container there is nothing to search, whatever the layout.
    boxed = lambda found: F.when(F.col("_box").isNotNull(), found)
    every = {
        "1a": lambda: boxed(layout_1a(infos, texts, name)),
        "1b": lambda: boxed(layout_1b(infos, texts, name, domain, other)),
        "2": lambda: boxed(layout_2(ps)),
        "3": lambda: layout_3(markup.paragraphs(F.col("_box")), platform, other),
    }
    found = F.concat(*[F.coalesce(every[k]().cast(POST_TYPE), F.array().cast(POST_TYPE)) for k in layouts])

    def keep(p: Column) -> Column:
        good = worth_keeping(p["post"], domain)
        if not filter_1b:
            good = good | (p["layout"] == "1b")
        return p["nickname"].isNotNull() & p["post"].isNotNull() & good

    return (
        blocks.select("url", F.filter(found, keep).alias("_posts"))
        # An outer generator: Spark would copy all of the above into a filter for a plain one.
        .select("url", F.inline_outer("_posts"))
        .filter(F.col("nickname").isNotNull())
        .select(
            "url", post_id(F.col("url")).alias("source_post_id"), "layout", "post_seq", "nickname", "post",
            F.when(F.size("images") > 0, F.col("images")).alias("images"),
        )
    )


def distinct_posts(posts: DataFrame) -> DataFrame:
    """Each ``url, nickname, post`` once, as its first layout found it.

    Copies are reduced before the shuffle, so a page crawled very often is no burden.
    """
    rest = [c for c in posts.columns if c not in ("url", "nickname", "post")]
    ordered = ["layout", "post_seq"] + [c for c in rest if c not in ("layout", "post_seq")]
    first = F.min(F.struct(*ordered)).alias("first")
    return posts.groupBy("url", "nickname", "post").agg(first).select(
        *[F.col("first")[c].alias(c) if c in rest else F.col(c) for c in posts.columns]
    )


def all_posts(pages: DataFrame, **options) -> DataFrame:
    """All quoted posts of the pages: every layout, merged."""
    return distinct_posts(page_posts(pages, **options))


def sibling_posts(pages: DataFrame, mixed: bool = True, platform: str = PLATFORM) -> DataFrame:
    """One post per page, read from the child nodes of the container.

    The name stands in one child, the text two children further on; the last hit
    wins.  Pages without such blocks may quote mixed sources (``mixed``): there a
    child that mentions the platform holds the name, and the spans of the child
    two further on the text.
    """
    nodes = pages.select(
        normalise(F.col("url")).alias("url"),
        markup.child_nodes(
            markup.first_div(markup.label(markup.clean(F.col("html"))), CONTAINER, exact=False)
        ).alias("_nodes"),
    )

    def is_block(c: Column) -> Column:
        return F.contains(c, F.lit(INFO_UNIT)) | F.contains(c, F.lit(TEXT_UNIT))

    def last(find) -> Column:
        hits = F.filter(F.transform("_nodes", find), lambda x: x.isNotNull())
        return F.try_element_at(hits, F.lit(-1))

    def text_of(node: Column) -> Column:
        return markup.unescape(markup.strip_tags(node))

    def two_on(i: Column) -> Column:
        return F.get(F.col("_nodes"), i + 2)

    classes = "|".join(NAME_CLASSES)
    name_element = (
        r"(?is)<([a-z][a-z0-9-]*)(?=[\s])(?=[^<>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?"
        rf"(?:{classes})(?:\s[^\"']*)?[\"'])[^>]*>(.*?)</\1\s*>"
    )
    name = last(
        lambda c, i: F.when(
            is_block(c) & F.contains(c, F.lit(NAME_CLASSES[0])),
            text_of(F.regexp_extract(c, name_element, 2)),
        )
    )
    text = last(
        lambda c, i: F.when(
            is_block(c) & F.contains(c, F.lit(NAME_CLASSES[0])) & F.contains(two_on(i), F.lit(TEXT_UNIT)),
            text_of(two_on(i)),
        )
    )
    other = last(
        lambda c, i: F.when(
            F.contains(c, F.lit(platform)),
            F.struct(
                text_of(F.regexp_extract(c, r"(?is)<a(?=[\s>])[^>]*>(.*?)</a\s*>", 1)).alias("name"),
                F.array_join(
                    F.transform(
                        F.regexp_extract_all(
                            two_on(i), F.lit(r"(?is)<span(?=[\s>])[^>]*>(.*?)</span\s*>"), F.lit(1)
                        ),
                        lambda s: F.coalesce(nonblank(text_of(s)), F.lit("")),
                    ),
                    "",
                ).alias("text"),
            ),
        )
    )
    read = nodes.select(
        "url",
        F.coalesce(F.exists("_nodes", is_block), F.lit(False)).alias("_blocks"),
        name.alias("_name"),
        text.alias("_text"),
        other.alias("_other"),
    )
    use_other = ~F.col("_blocks") & F.lit(mixed)
    return read.select(
        "url",
        post_id(F.col("url")).alias("source_post_id"),
        nonblank(F.when(use_other, F.col("_other")["name"]).otherwise(F.col("_name"))).alias("nickname"),
        nonblank(F.when(use_other, F.col("_other")["text"]).otherwise(F.col("_text"))).alias("post"),
    )


def protect(posts: DataFrame, key: str) -> DataFrame:
    """Replace account names by keyed digests and mask mentions in the text."""
    if not key:
        raise ValueError("a key is needed to hash account names")
    return posts.withColumn(
        "nickname", F.sha2(F.concat(F.lit(key), F.col("nickname")), 256)
    ).withColumn("post", F.regexp_replace("post", MENTION, "@_"))
