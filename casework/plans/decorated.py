"""Test inputs derived from the page table.

The supplied pages hold neither the titles nor the markup that the operators
look for.  The expressions below add them to every page, depending on its id,
and are plain SQL that Spark and other engines evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ID = "CAST(page_id AS STRING)"


def _num(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def swap(expr: str, *pairs: tuple[str, str]) -> str:
    """Nested ``replace`` calls; the second item of a pair is an SQL expression."""
    for old, new in pairs:
        expr = f"replace({expr}, '{old}', {new})"
    return expr


# URLs that carry a post number, in both spellings.
POST_URL = (
    f"CASE WHEN page_id % 9 = 8 THEN 'http://example.org/short' "
    f"WHEN page_id % 2 = 0 THEN 'http://example.org/post/' || {ID} || '/x' "
    f"ELSE 'http://example.org/a/' || {ID} || '_x.html' END"
)
# The same without URLs that several pages share.
POST_URL_UNIQUE = (
    f"CASE WHEN page_id % 2 = 0 THEN 'http://example.org/post/' || {ID} || '/x' "
    f"ELSE 'http://example.org/a/' || {ID} || '_x.html' END"
)

TITLE_TAIL = (
    f"CASE page_id % 5 "
    f"WHEN 0 THEN ' 201' || {_num('page_id % 10')} || '年' || {_num('page_id % 13 + 1')} || '月' || {_num('page_id % 28 + 1')} || '日' "
    f"WHEN 1 THEN ' 201' || {_num('page_id % 10')} || '.' || {_num('page_id % 13 + 1')} || '.' || {_num('page_id % 28 + 1')} "
    f"WHEN 2 THEN ' 201' || {_num('page_id % 10')} || ' ' || {_num('page_id % 13 + 1')} || ' ' || {_num('page_id % 28 + 1')} "
    f"WHEN 3 THEN ' 201' || {_num('page_id % 10')} || '年' || {_num('page_id % 12 + 1')} || '月' "
    f"ELSE '' END"
    f" || CASE WHEN page_id % 2 = 0 THEN '［old］［k' || {_num('page_id % 7')} || '］' ELSE '' END"
    f" || CASE WHEN page_id % 3 = 0 THEN '（w' || {_num('page_id % 5')} || '）' WHEN page_id % 3 = 1 THEN '（）' ELSE '' END"
    f" || CASE WHEN page_id % 17 = 0 THEN ' Service' ELSE '' END"
)

COUNT_PHRASE = (
    f"CASE page_id % 12 "
    f"WHEN 0 THEN {_num('page_id + 10')} || '人参加了活动' "
    f"WHEN 1 THEN {_num('page_id + 10')} || '元工资' "
    f"WHEN 2 THEN {_num('page_id + 10')} || '人民警察到场了' "
    f"WHEN 3 THEN '三百人聚集在那里' "
    f"WHEN 4 THEN '上千人到场' "
    f"WHEN 5 THEN '' "
    f"WHEN 6 THEN '约' || {_num('page_id % 9 + 1')} || '人，2015年' "
    f"WHEN 7 THEN '二百五十六名工人，' || {_num('page_id * 7 + 10')} || '户' "
    f"WHEN 8 THEN '三万五千人' || {_num('page_id')} "
    f"WHEN 9 THEN {_num('page_id + 1234567')} || '人' "
    f"WHEN 10 THEN '１２' || {_num('page_id % 10')} || '名业主，' || {_num('page_id')} || '元' "
    f"ELSE '一百零五家，上十人，' || {_num('page_id + 20')} || '老人' END"
)

CASE_HTML = swap(
    "html",
    ("</title>", f"{TITLE_TAIL} || '</title>'"),
    ("<body>", "CASE WHEN page_id % 7 = 0 THEN '<body><div class=\"content\">decoy</div>' ELSE '<body>' END"),
    (
        "<article>",
        "CASE WHEN page_id % 11 = 0 THEN '' "
        "WHEN page_id % 7 = 0 THEN '<div class=\"article-content entry-content\">' "
        "WHEN page_id % 2 = 0 THEN '<div id=\"c\" class=\"main content\">' "
        "ELSE '<div class=\"content\">' END "
        f"|| '<div class=\"note\">' || {COUNT_PHRASE} || '</div><article>'",
    ),
    (
        "</article>",
        "'</article>' || CASE WHEN page_id % 11 = 0 THEN '' ELSE '<div><div>inner</div> tail</div></div>' END",
    ),
)

IMG = f"'<img src=\"http://img.example.org/' || {ID} || '.png\">'"
NAME = f"'user_' || {_num('page_id % 50')}"
NOISE = (
    "CASE page_id % 3 WHEN 0 THEN ' @x' WHEN 1 THEN ' weibo.com' ELSE '' END"
)

# Every thirteenth page has no container.
BOX = "CASE WHEN page_id % 13 = 5 THEN '<div class=\"box\">' ELSE '<div class=\"content\">' END"
ODD_ENTITIES = "' &mdash;&ldquo;was&rdquo; &eacute;&euro;&Uuml;&szlig;&rarr;&frac12;&hearts;&Omega;&trade;&#x0000e9;&#0233; '"

# Layout 1A: text blocks; the page's first name stands in one of five places.
HTML_1A = swap(
    "html",
    (" is ", "' <i><a class=\"WB_name S_func1\" href=\"http://weibo.com/u\">wrapped</a></i> is '"),
    ("<br>", IMG),
    ("</p>", f"CASE WHEN page_id % 2 = 1 THEN {NOISE} ELSE '' END"),
    (
        "<p><b>",
        "'</div><div class=\"WB_text\"><div class=\"WB_info\"><a class=\"WB_name S_func1\" href=\"http://weibo.com/u\">' "
        f"|| {NAME} || '</a></div>'",
    ),
    (
        "<p>",
        "CASE WHEN page_id % 2 = 1 THEN '</div><div class=\"WB_text\"><div class=\"WB_info\">"
        "<a class=\"WB_name S_func1\" href=\"http://weibo.com/u\">' "
        f"|| {NAME} || '</a></div>' ELSE '</div><div class=\"WB_text\">' END",
    ),
    (" the ", "' <span>the</span> '"),
    (" a ", "' <em>a</em> '"),
    (" of ", f"'<div class=\"msgCnt\"> of ' || {IMG} || '</div>'"),
    (" in ", "'<div class=\"other\"> in</div> '"),
    (
        "<article>",
        f"{BOX} || CASE page_id % 6 "
        "WHEN 0 THEN '<div class=\"WB_info\"><a class=\"WB_name S_func1\">first_0</a></div>' "
        "WHEN 1 THEN '<div class=\"WB_info\"><a href=\"x\">first_1</a></div>' "
        "WHEN 2 THEN '<div class=\"WB_info\"></div><div class=\"WB_text\"><a>first_2</a>head</div>' "
        "WHEN 3 THEN '<div class=\"WB_info\"><div class=\"userName\"><i>first_3</i></div></div>' "
        "WHEN 4 THEN '<div class=\"WB_info\"></div><p><a class=\"WB_name S_func1\">first_4</a></p>' "
        "ELSE '<div class=\"WB_info\"> </div>' END || '<div class=\"lead\">'",
    ),
    ("</article>", "'</div></div>'"),
)

# Layout 1B: info blocks only.
HTML_1B = swap(
    "html",
    (" is ", "' <i><a class=\"WB_name S_func1\" href=\"http://weibo.com/u\">wrapped</a></i> is '"),
    ("<br>", f"'</div><div class=\"WB_info\">' || {IMG}"),
    ("</p>", f"CASE WHEN page_id % 2 = 1 THEN {NOISE} ELSE '' END"),
    ("<p><b>", f"'</div><div class=\"WB_info\"><a href=\"http://weibo.com/u\">' || {NAME} || '</a>'"),
    (
        "<p>",
        "CASE WHEN page_id % 2 = 1 THEN '</div><div class=\"WB_info\"><a href=\"http://weibo.com/u\">' "
        f"|| {NAME} || '</a>' ELSE '</div><div class=\"WB_info\">' END",
    ),
    (" the ", "' <span>the</span> '"),
    (" a ", "' <em>a</em> '"),
    (
        " in ",
        "CASE WHEN page_id % 4 = 0 THEN '</div><div class=\"WB_info\"><a href=\"http://weibo.com/qq.com\">no</a> in ' ELSE ' in ' END",
    ),
    (
        "<article>",
        f"{BOX} || '<div class=\"WB_info\">zero</div><div class=\"WB_info\">one</div>"
        "<div class=\"WB_info\">two</div><div class=\"lead\">'",
    ),
    ("</article>", "'</div></div>'"),
)

# Layout 2: name links in paragraphs of their own.
NAME_P = f"'<p><a class=\"con_name_txt S_txt1\" href=\"u\">' || {NAME} || '</a>x</p><p>'"
HTML_2 = swap(
    "html",
    (" is ", "' <i><a class=\"con_name_txt S_txt1\" href=\"http://weibo.com/u\">wrapped</a></i> is '"),
    ("<br>", f"'</p><p>img' || {IMG} || '</p>'"),
    ("</p><p>", f"CASE WHEN page_id % 2 = 1 THEN {NOISE} || '</p><p>' ELSE '</p><p>' END"),
    ("<p><b>", NAME_P),
    ("<p>E", f"CASE WHEN page_id % 2 = 1 THEN {NAME_P} || 'E' ELSE '<p>E' END"),
    ("<p>T", f"CASE WHEN page_id % 2 = 1 THEN {NAME_P} || 'T' ELSE '<p>T' END"),
    (" the ", "' <span>the</span> '"),
    (" was ", ODD_ENTITIES),
    ("<article>", f"{BOX} || 'weibo<article>'"),
    ("</article>", "'</article></div>'"),
)

# Layout 3: links to authors, other links, mentions.
LINK = "<a href=\"http://weibo.com/u\">"
HTML_3 = swap(
    "html",
    (" is ", "' <i><a class=\"x\" href=\"http://weibo.com/u\">wrapped</a></i> is '"),
    ("<br>", f"'</p><p>' || {IMG} || '</p>'"),
    ("</p><p>", f"CASE WHEN page_id % 2 = 1 THEN {NOISE} || '</p><p>' ELSE '</p><p>' END"),
    (
        "<p><b>",
        f"'<p>{LINK}' || CASE page_id % 5 WHEN 0 THEN 'site.com' WHEN 1 THEN '<span>' || {NAME} || '</span>' ELSE {NAME} END || '</a>lost</p>' "
        f"|| CASE page_id % 4 WHEN 0 THEN '<p>@a @b</p><p>{LINK}@c</a></p>' "
        f"WHEN 1 THEN '<p>{LINK}second</a>own words<span> here</span></p>' ELSE '' END || '<p>'",
    ),
    ("<p>E", f"CASE WHEN page_id % 2 = 1 THEN '<p>{LINK}' || {NAME} || '</a></p><p>E' ELSE '<p>E' END"),
    ("<p>T", f"CASE WHEN page_id % 2 = 1 THEN '<p>{LINK}' || {NAME} || '</a></p><p>T' ELSE '<p>T' END"),
    (" the ", "' <span>the</span> '"),
    (" a ", "' <em>a</em> '"),
    (" to ", "' <i>to</i> '"),
    (" de ", "CASE WHEN page_id % 7 = 0 THEN '</p><p><a href=\"http://weibo.com/qq.com\">q</a>skipped</p><p>de ' ELSE ' de ' END"),
    (" of ", "CASE WHEN page_id % 7 = 1 THEN '</p><p><a href=\"http://else.example.org\">l</a></p><p>of ' ELSE ' of ' END"),
    (
        "<article>",
        "CASE WHEN page_id % 3 = 0 THEN '<div class=\"content\"><script>x</script><p>scripted</p></div>' ELSE '' END "
        "|| '<div class=\"content\"><article>'",
    ),
    ("</article>", "'</article></div>'"),
)

# One post per page by sibling offset, and the mixed form on every third page.
HTML_SIBLING = swap(
    "html",
    (
        "<article>",
        "'<div class=\"content\">' || CASE WHEN page_id % 3 = 0 THEN "
        f"'<p>weibo <a href=\"u\">' || {NAME} || '</a></p> <p><span> one </span><b>x</b><span>two</span></p>' "
        "ELSE '<div class=\"WB_info\"><a class=\"WB_name S_func1\">' "
        f"|| {NAME} || '</a></div> <div class=\"WB_text\"> early <b>text</b> </div>' END || '<article>'",
    ),
    ("<p><b>", "CASE WHEN page_id % 3 = 0 THEN '<p><b>' ELSE '<p>' END"),
    (
        "</article>",
        "'</article>' || CASE page_id % 4 "
        f"WHEN 0 THEN '<div class=\"WB_info\"><i class=\"WB_name\">last_' || {ID} || '</i></div>gap<div class=\"WB_text\">late &amp; ' || {NAME} || '</div>' "
        f"WHEN 1 THEN '<div class=\"WB_info\"><i class=\"x S_func1\">WB_name' || {ID} || '</i></div>gap<div>none</div>' "
        "ELSE '' END || '</div>'",
    ),
)

HTML_ALL = (
    f"CASE page_id % 4 WHEN 0 THEN {HTML_1A} WHEN 1 THEN {HTML_1B} WHEN 2 THEN {HTML_2} ELSE {HTML_3} END"
)


def pages_with(pages: DataFrame, html: str = "html", url: str = POST_URL) -> DataFrame:
    """``page_id, url, html`` with the given expressions."""
    return pages.select("page_id", F.expr(url).alias("url"), F.expr(html).alias("html"))
