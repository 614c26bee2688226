"""Reading nodes out of page markup with native string expressions.

The key step is :func:`label`: it writes the nesting depth of every ``div`` into
its tag (``<div3 class=..> .. </div3>``).  After that, the end of an element is
the first closing tag with the same number, so one regular expression with a
back-reference finds whole elements, nested or not, and no shuffle or
user-defined function is needed.

Patterns only repeat single character classes or a lazy dot; repeated groups
would recurse once per character in Java and overflow on long pages.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from casework.functions.arrays import filled, let, running_sum

# What is dropped before reading a page, and tags that never enclose text.
NOISE = (
    r"(?is)(?=<[s!])(?:(<script)\b.*?</script\s*(>)|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>)"
)
TAG = r"<[^<]+?>"
VOID = "area|base|br|col|embed|hr|input|link|meta|script|source|track|wbr"

# Named character entities are those of the HTML standard, from Python's own table of it.
ENTITIES = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
# The daily ones are tried first; a page rarely holds others.
COMMON = ("&nbsp;", "&lt;", "&gt;", "&quot;", "&apos;", "&copy;", "&middot;", "&hellip;", "&amp;", "&mdash;", "&ndash;", "&ldquo;", "&rdquo;", "&lsquo;", "&rsquo;")


def _entity_map(names) -> Column:
    # One literal: the pieces are split and folded into a constant map when the query is planned.
    pairs = "\u0001".join(f"{n}\u0002{ENTITIES[n]}" for n in names)
    return F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))


IMAGE = r"(?is)<img(?=\s)[^>]*\ssrc\s*=\s*[\"']?([^\"'\s>]+)"
IMG_OPEN, IMG_CLOSE = "\u0002", "\u0003"
LINK_OPEN, LINK_CLOSE = "\u0005", "\u0006"


def clean(html: Column) -> Column:
    """Page without styles, comments and document type.

    A script shrinks to a bare tag: its code goes, the fact that there was one stays.
    """
    return F.regexp_replace(html, NOISE, "$1$2")


def strip_tags(markup: Column) -> Column:
    """Remove all tags; entities stay escaped."""
    return F.regexp_replace(markup, TAG, "")


def unescape(text: Column) -> Column:
    """Resolve numeric and named character entities, as the HTML standard lists them.

    No-break spaces become plain ones.  Entities without a semicolon stay as written.
    """

    def numeric(entity: Column) -> Column:
        code = F.coalesce(
            F.conv(filled(F.regexp_extract(entity, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)), 16, 10),
            filled(F.regexp_extract(entity, r"^&#0*([0-9]{1,7});$", 1)),
        ).cast("int")
        # Surrogates and numbers beyond the last character stay as written.
        return let(
            code,
            lambda n: F.when(
                ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF)),
                F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
            ).otherwise(entity),
        )

    def resolve(piece: Column) -> Column:
        return (
            F.when(F.startswith(piece, F.lit("&#")), numeric(piece))
            .when(
                F.startswith(piece, F.lit("&")),
                F.coalesce(F.try_element_at(_entity_map(COMMON), piece), F.try_element_at(_entity_map(ENTITIES), piece), piece),
            )
            .otherwise(piece)
        )

    def joined(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit("&#?[0-9a-zA-Z]+;|[^&]+|&"), F.lit(0))
        plain = F.replace(F.array_join(F.transform(pieces, resolve), ""), F.lit("\u00a0"), F.lit(" "))
        return F.when(F.contains(t, F.lit("&")), plain).otherwise(t)

    return let(text, joined)


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _class(value: str, exact: bool) -> str:
    """Look-ahead for a class attribute: the whole value, or one of its words."""
    # A selector with several classes is compared as a whole, like an exact one.
    words = exact or " " in value
    quoted = [
        f"{q}{value if words else rf'(?:[^{q}]*\s)?{value}(?:\s[^{q}]*)?'}{q}" for q in ('"', "'")
    ]
    bare = [] if " " in value else [rf"{value}(?=[\s>/])"]
    return rf"(?=[^<>]*\s(?i:class)\s*=\s*(?:{'|'.join(quoted + bare)}))"


def label(html: Column) -> Column:
    """Write the nesting depth into every opening and closing ``div``."""

    def step(piece: Column, i: Column) -> Column:
        return F.when(i == 0, 0).when(F.startswith(piece, F.lit("/")), -1).otherwise(1)

    def number(piece: Column, step: Column, depth: Column) -> Column:
        return (
            F.when(step > 0, F.concat(F.lit("<div"), depth, F.substr(piece, F.lit(4))))
            .when(step < 0, F.concat(F.lit("</div"), depth + 1, F.substr(piece, F.lit(5))))
            .otherwise(piece)
        )

    def joined(pieces: Column) -> Column:
        return let(
            F.transform(pieces, step),
            lambda steps: let(
                running_sum(steps),
                lambda depths: F.array_join(
                    F.transform(pieces, lambda p, i: number(p, F.get(steps, i), F.get(depths, i))), ""
                ),
            ),
        )

    # All pieces but the first begin behind the bracket of a div tag.
    return let(F.split(html, r"<(?=/?[dD][iI][vV][\s>/])"), joined)


def divs(labelled: Column, cls: str, exact: bool = True) -> Column:
    """Contents of all ``div`` of a class in document order, nested ones included."""
    # The element is matched inside a look-ahead, so the search goes on right
    # after its opening tag and also finds what lies within.
    pattern = rf"(?s)<div(?=(-?\d+){_class(cls, exact)}[^>]*>(.*?)(?:</div\1\s*>|\z))"
    return F.regexp_extract_all(labelled, F.lit(pattern), F.lit(2))


def first_div(labelled: Column, cls: str, exact: bool = True) -> Column:
    """Content of the first ``div`` of a class, NULL when there is none."""
    pattern = rf"(?s)<div(-?\d+){_class(cls, exact)}[^>]*>(.*?)(?:</div\1\s*>|\z)"
    return F.when(
        F.rlike(labelled, F.lit(rf"<div-?\d+{_class(cls, exact)}")),
        F.regexp_extract(labelled, pattern, 2),
    )


def drop_divs(labelled: Column, keep_class: str | None = None) -> Column:
    """Remove child ``div`` elements, except those of ``keep_class``."""
    keep = f"(?!{_class(keep_class, True)})" if keep_class else ""
    return F.regexp_replace(labelled, rf"(?s)<div(-?\d+)(?=[\s>/]){keep}.*?(?:</div\1\s*>|\z)", "")


def paragraphs(labelled: Column) -> Column:
    """Contents of all ``p``; a paragraph ends at its end tag, the next ``p`` or a block."""
    return F.regexp_extract_all(
        labelled,
        F.lit(r"(?is)<p(?=[\s>])[^>]*>(.*?)(?=<(?:/p\s*>|p[\s>]|/?div-?\d|/?article)|\z)"),
        F.lit(1),
    )


def anchor(markup: Column, cls: str | None = None, attr: str = "") -> Column:
    """First ``a`` element, whole, of a class or with an attribute; NULL when none."""
    cond = _class(cls, True) if cls else ""
    cond += rf"(?=[^<>]*\s{attr}\s*=)" if attr else ""
    return filled(F.regexp_extract(markup, rf"(?is)<a(?=[\s>]){cond}[^>]*>.*?</a\s*>", 0))


def anchor_text(markup: Column, cls: str | None = None) -> Column:
    """Own text of the first ``a`` of a class, or of the first one."""
    cond = _class(cls, True) if cls else ""
    return unescape(F.regexp_extract(markup, rf"(?is)<a(?=[\s>]){cond}[^>]*>([^<]+)", 1))


def images(markup: Column) -> Column:
    """``src`` of every image, in order."""
    return F.regexp_extract_all(markup, F.lit(IMAGE), F.lit(1))


def own_markup(markup: Column, keep: tuple[str, ...], sep: str = "") -> Column:
    """Drop every child element except ``keep``, whose tags are removed instead.

    What is left is the text of the node itself and of its ``keep`` children.
    Images become ``IMG_OPEN src IMG_CLOSE`` so that they can be read afterwards.
    ``sep`` takes the place of what is removed.
    """
    marked = F.regexp_replace(markup, rf"{IMAGE}[^>]*>", f"{IMG_OPEN}$1{IMG_CLOSE}")
    shed = rf"(?i)<(?:{VOID}|img)\b[^<>]*>|</?(?:{'|'.join(keep)})(?=[\s>/\d-])[^<>]*>"

    return let(F.regexp_replace(marked, shed, sep), lambda text: _peeled(text, sep))


def _peeled(markup: Column, sep: str = "") -> Column:
    """Take out all whole elements, from the innermost outwards, until a step changes nothing."""
    leaf = r"(?i)<([a-z][a-z0-9]*)\b[^<>]*>[^<]*</\1\s*>"

    def state(text: Column, busy: Column) -> Column:
        return F.struct(text.alias("text"), busy.alias("busy"))

    def step(acc: Column, _: Column) -> Column:
        return F.when(
            acc["busy"],
            let(F.regexp_replace(acc["text"], leaf, sep), lambda new: state(new, new != acc["text"])),
        ).otherwise(acc)

    def peel(text: Column) -> Column:
        # No nesting is deeper than there are end tags.
        ends = F.regexp_extract_all(text, F.lit("</"), F.lit(0))
        return F.reduce(ends, state(text, F.lit(True)), step, lambda acc: acc["text"])

    return let(markup, peel)


def child_links(markup: Column) -> Column:
    """The markup of a block in which only its own ``a`` children are left, whole; links inside other children go.

    Links are hidden while the other elements are taken out.
    """
    pieces = F.split(markup, r"(?i)(?=<a[\s>])|(?<=</a>)")
    hidden = F.transform(
        pieces,
        lambda p: F.when(F.rlike(p, F.lit(r"(?is)^<a[\s>].*</a>$")), F.translate(p, "<>", LINK_OPEN + LINK_CLOSE)).otherwise(p),
    )
    bare = F.regexp_replace(F.array_join(hidden, ""), rf"(?i)<(?:{VOID}|img)\b[^<>]*>", "")
    links = F.translate(_peeled(bare), LINK_OPEN + LINK_CLOSE, "<>")
    return F.when(F.contains(markup, F.lit("<a")) | F.contains(markup, F.lit("<A")), links).otherwise("")


def own_text(markup: Column, keep: tuple[str, ...] = ("span",), sep: str = "") -> Column:
    """Text of a node and of its ``keep`` children, in document order."""
    return unescape(
        strip_tags(F.regexp_replace(own_markup(markup, keep, sep), f"{IMG_OPEN}[^{IMG_CLOSE}]*{IMG_CLOSE}", ""))
    )


def own_images(markup: Column, keep: tuple[str, ...] = ("div",)) -> Column:
    """``src`` of the images that are direct children (or children of ``keep``)."""
    return F.regexp_extract_all(
        own_markup(markup, keep), F.lit(f"{IMG_OPEN}([^{IMG_CLOSE}]*){IMG_CLOSE}"), F.lit(1)
    )


def child_nodes(labelled: Column) -> Column:
    """Direct child nodes of a container, text nodes included, as an array of markup."""
    return F.regexp_extract_all(
        labelled,
        F.lit(
            r"(?is)<div(-?\d+)(?=[\s>/]).*?(?:</div\1\s*>|\z)"
            r"|<p(?=[\s>])[^>]*>.*?(?:</p\s*>|(?=<p[\s>]|</?div-?\d|\z))"
            rf"|<(?:{VOID}|img)\b[^>]*>"
            r"|<([a-z][a-z0-9]*)\b[^>]*>.*?(?:</\2\s*>|\z)"
            r"|</[^>]*>"
            r"|[^<]+"
        ),
        F.lit(0),
    )
