"""Node table: every element and text of a page with its parent, depth and place among its siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import markup
from casework.functions.arrays import BLOCK, let
from casework.operators.tokens import TOKEN

# Fixed values of the HTML standard: elements without an end tag (a script is a bare tag in a cleaned page), and
# which open elements a start tag ends, unless one of the walls lies between.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "script", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "ul",
)
SCOPE = ("applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th")
ENDS = (
    (BLOCKS, ("p",), SCOPE),
    (("li",), ("li", "p"), ("ol", "ul", *SCOPE)),
    (("dd", "dt"), ("dd", "dt", "p"), ("dl", *SCOPE)),
    (("td", "th"), ("td", "th"), ("table", "tr")),
    (("tr",), ("tr",), ("table",)),
    (("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead"), ("table",)),
    (("option",), ("option",), ("select",)),
)

TEXT, OTHER = "#", ""
OPEN_TYPE = "struct<tag:string,idx:int,kids:int>"
NODE_TYPE = "struct<parent:int,depth:int,child:int>"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _name(token: Column) -> Column:
    """Lower-case tag name, ``/name`` of an end tag, TEXT for a text, OTHER for the rest."""
    is_tag = F.startswith(token, F.lit("<")) & (F.length(token) > 1)
    return F.when(is_tag, F.lower(F.regexp_extract(token, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))).otherwise(TEXT)


def _first(stack: Column, tags: Column) -> Column:
    """Place, from 1, of the innermost open element with one of the names; 0 when none."""
    hits = F.filter(
        F.transform(stack, lambda e, i: F.when(F.array_contains(tags, e["tag"]), i + 1)), lambda i: i.isNotNull()
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def _popped(stack: Column, count: Column) -> Column:
    return F.when(count > 0, F.slice(stack, count + 1, F.size(stack))).otherwise(stack)


def _implied(stack: Column, name: Column) -> Column:
    """The stack after the elements that a start tag ends without their end tags."""

    def ended(ends: tuple[str, ...], walls: tuple[str, ...]) -> Column:
        return let(
            F.struct(_first(stack, _strings(ends)).alias("hit"), _first(stack, _strings(walls)).alias("wall")),
            lambda at: F.when((at["wall"] == 0) | (at["hit"] < at["wall"]), _popped(stack, at["hit"])).otherwise(stack),
        )

    def nearest(ends: tuple[str, ...], walls: tuple[str, ...]) -> Column:
        # A paragraph inside the item ends with the item: the outer of the two is asked for first.
        own = tuple(e for e in ends if e != "p") or ends
        inner = ended(own, walls)
        return inner if own == ends else let(inner, lambda s: F.when(F.size(s) < F.size(stack), s).otherwise(ended(("p",), SCOPE)))

    rule = F.when(F.lit(False), stack)
    for names, ends, walls in ENDS:
        rule = rule.when(name.isin(*names), nearest(ends, walls))
    return rule.otherwise(stack)


def _nodes(names: Column) -> Column:
    """``array<NODE_TYPE>`` beside the tokens, NULL where a token begins no node.

    One pass with the stack of open elements, innermost first.  The result grows block by block, so a long page
    costs no quadratic copying.
    """

    def state(stack: Column, out: Column, idx: Column) -> Column:
        return F.struct(stack.alias("stack"), out.alias("out"), idx.alias("idx"))

    def added(acc: Column, stack: Column, name: Column) -> Column:
        top = F.get(stack, F.lit(0))
        node = F.struct(
            top["idx"].alias("parent"), (F.size(stack) - 1).alias("depth"), top["kids"].alias("child")
        ).cast(NODE_TYPE)
        counted = F.concat(
            F.array(F.struct(top["tag"].alias("tag"), top["idx"].alias("idx"), (top["kids"] + 1).alias("kids")).cast(OPEN_TYPE)),
            F.slice(stack, F.lit(2), F.size(stack)),
        )
        opened = F.array(F.struct(name.alias("tag"), acc["idx"].alias("idx"), F.lit(0).alias("kids")).cast(OPEN_TYPE))
        leaf = name.isin(TEXT, *VOID)
        return state(
            F.when(leaf, counted).otherwise(F.concat(opened, counted)), F.concat(acc["out"], F.array(node)), acc["idx"] + 1
        )

    def step(acc: Column, name: Column) -> Column:
        stack, none = acc["stack"], F.array(F.lit(None).cast(NODE_TYPE))
        closing = F.startswith(name, F.lit("/"))
        # An end tag without an open element of its name is passed over.
        closed = let(F.array(F.substr(name, F.lit(2))), lambda tag: _popped(stack, _first(stack, tag)))
        return (
            F.when(closing, state(closed, F.concat(acc["out"], none), acc["idx"] + 1))
            .when(name == OTHER, state(stack, F.concat(acc["out"], none), acc["idx"] + 1))
            .when(name == TEXT, added(acc, stack, name))
            .otherwise(let(_implied(stack, name), lambda s: added(acc, s, name)))
        )

    def block(acc: Column, start: Column, all_names: Column) -> Column:
        nothing = F.array().cast(f"array<{NODE_TYPE}>")
        done = F.reduce(F.slice(all_names, start, F.lit(BLOCK)), state(acc["stack"], nothing, start - 1), step)
        return let(
            done, lambda d: F.struct(d["stack"].alias("stack"), F.concat(acc["blocks"], F.array(d["out"])).alias("blocks"))
        )

    root = F.array(F.struct(F.lit("").alias("tag"), F.lit(-1).alias("idx"), F.lit(0).alias("kids")).cast(OPEN_TYPE))
    empty = F.struct(root.alias("stack"), F.array().cast(f"array<array<{NODE_TYPE}>>").alias("blocks"))
    return let(
        names,
        lambda all_names: F.reduce(
            F.sequence(F.lit(1), F.greatest(F.size(all_names), F.lit(1)), F.lit(BLOCK)),
            empty,
            lambda acc, start: block(acc, start, all_names),
            lambda acc: F.flatten(acc["blocks"]),
        ),
    )


def node_table(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """One row per element or text: ``idx, kind, tag, attrs, text, parent, depth, child``.

    ``idx`` is the place of the token that begins the node, ``parent`` that of the parent's (-1 at the top),
    ``child`` counts from 0 among all children of the parent, texts included.  An end tag ends the innermost
    open element of its name and all within; one that fits none is passed over.  A start tag ends what it
    implies (paragraphs before blocks, items, cells, rows, options); other elements stay open until an
    outer one ends.  The work stays inside the page row: no shuffle.  NULL or empty pages have no nodes.
    """
    tokens = F.regexp_extract_all(markup.clean(F.col(html)), F.lit(TOKEN), F.lit(0))
    raw = F.col("_node.token")
    rows = (
        pages.select(*keys, tokens.alias("_tokens"))
        .select(*keys, "_tokens", _nodes(F.transform("_tokens", _name)).alias("_places"))
        .select(*keys, F.posexplode_outer(F.zip_with("_tokens", "_places", lambda t, p: F.struct(t.alias("token"), p.alias("place")))).alias("idx", "_node"))
        .filter(F.col("_node.place").isNotNull())
    )
    is_text = _name(raw) == TEXT
    return rows.select(
        *keys,
        "idx",
        F.when(is_text, "text").otherwise("element").alias("kind"),
        F.when(~is_text, _name(raw)).alias("tag"),
        F.when(~is_text, F.trim(F.regexp_extract(raw, r"(?s)^<[A-Za-z][A-Za-z0-9]*(.*?)/?>$", 1))).alias("attrs"),
        F.when(is_text, raw).alias("text"),
        *[F.col(f"_node.place.{c}").alias(c) for c in ("parent", "depth", "child")],
    )
