"""Plain SQL for the registered queries, worked out another way.

Pages are cut into one row per tag or text and positions are followed with
window sums and joins, where the library stays inside the page row with labelled
tags and arrays.
"""

from __future__ import annotations

from casework.operators.elements import ENDS, OTHER, SCOPE, TEXT, VOID
from casework.operators.filters import OTHER_DOMAIN, PLATFORM, PLATFORM_DOMAIN
from casework.plans import decorated as deco
from casework.plans import queries as q

SCRIPT = r"(?is)<script\b.*?</script\s*>"
NOISE = r"(?is)<!--.*?-->|<style\b.*?</style\s*>|<!DOCTYPE[^>]*>"
STRIP = r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$"
DIGITS = "translate({0}, '０１２３４５６７８９', '0123456789')"
# Nouns for people, and phrases that are no head count.
NOUN = "民名户人业主司机开发商投资者朋友众父母老学生家工师"
PHRASES = (
    r"[^\n]{0,2}岁|[^\n]{0,4}人口|[^\n]{0,4}元|[^\n]{0,4}人民币|[^\n]{0,4}金|[^\n]{0,4}工程"
    r"|[^\n]{0,4}块|[^\n]{0,4}钱|[^\n]{0,4}工资"
)


# Entities of the decorated pages, the ampersand last.
NAMED = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ldquo;": "“",
    "&rdquo;": "”", "&eacute;": "é", "&euro;": "€", "&Uuml;": "Ü", "&szlig;": "ß", "&rarr;": "→", "&frac12;": "½", "&hearts;": "♥",
    "&Omega;": "Ω", "&trade;": "™", "&#x0000e9;": "é", "&#0233;": "é", "&amp;": "&",
}


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def unescape(expr: str) -> str:
    return deco.swap(expr, *[(name, f"'{text}'") for name, text in NAMED.items()])


def headline_sql(html: str) -> str:
    title = rf"regexp_replace(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title', 1), '<[^<]+?>', '', 'g')"
    return rf"trim(regexp_replace({title}, '[\s\x{{3000}}]+', ' ', 'g'))"


def source(html: str, url: str, where: str = "true") -> str:
    return f"d AS (SELECT page_id, {url} AS url, {html} AS html FROM pages), dd AS (SELECT * FROM d WHERE {where})"


def markup(html: str, url: str = "url", where: str = "true") -> str:
    """CTEs: n = tokens with their div depth, el = div elements with start and end."""
    return rf"""{source(html, url, where)},
    l AS (SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(html, '{SCRIPT}', '<script>', 'g'),
          '{NOISE}', '', 'g'), '<[^<>]+>|[^<]+') AS toks FROM dd),
    r AS (SELECT page_id, url, unnest(toks) AS tok, generate_subscripts(toks, 1) AS idx FROM l),
    t AS (SELECT *, starts_with(tok, '<') AS tag, starts_with(tok, '</') AS closing,
          lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name,
          regexp_extract(tok, '\sclass\s*=\s*"([^"]*)"', 1) AS cls,
          regexp_extract(tok, '\ssrc\s*=\s*"([^"]*)"', 1) AS src,
          lead(tok) OVER (PARTITION BY page_id ORDER BY idx) AS next_tok FROM r),
    n AS (SELECT *, sum(CASE WHEN name <> 'div' THEN 0 WHEN closing THEN -1 ELSE 1 END)
          OVER (PARTITION BY page_id ORDER BY idx) AS depth,
          sum(CASE WHEN name NOT IN ('i', 'em', 'span') THEN 0 WHEN closing THEN -1 ELSE 1 END)
          OVER (PARTITION BY page_id ORDER BY idx) AS wrapped FROM t),
    eo AS (SELECT page_id, url, idx AS s, closing, cls, lead(idx, 1, 1000000000)
          OVER (PARTITION BY page_id, depth + closing::INT ORDER BY idx) AS e FROM n WHERE name = 'div'),
    el AS (SELECT * FROM eo WHERE NOT closing)"""


def content_sql(html: str, classes: str) -> str:
    """CTEs ending in c = page_id, url, content; classes ranks the class attribute."""
    return rf"""{markup(html)},
    box AS (SELECT page_id, s, e FROM (SELECT *, {classes} AS pick FROM el) WHERE pick > 0
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pick, s) = 1),
    body AS (SELECT b.page_id, coalesce(string_agg(CASE WHEN NOT n.tag THEN n.tok END, '' ORDER BY n.idx), '') AS content
             FROM box b LEFT JOIN n ON n.page_id = b.page_id AND n.idx > b.s AND n.idx < b.e GROUP BY b.page_id),
    c AS (SELECT d.page_id, d.url, {headline_sql('d.html')} AS headline, body.content
          FROM d LEFT JOIN body ON body.page_id = d.page_id)"""


CLASSES = (
    "CASE WHEN cls = 'article-content entry-content' THEN 1 "
    r"WHEN regexp_matches(cls, '(^|\s)content(\s|$)') THEN 2 ELSE 0 END"
)
ONLY_CONTENT = r"CASE WHEN regexp_matches(cls, '(^|\s)content(\s|$)') THEN 1 ELSE 0 END"
CONTENT = content_sql(deco.CASE_HTML, CLASSES)

DATE_RAW = rf"regexp_extract({DIGITS.format('headline')}, '201[0-9][.\s\x{{3000}}年]+[0-9]{{1,2}}[.\s\x{{3000}}月]*[0-9]{{1,2}}')"
DATE_PART = (
    rf"regexp_extract({DIGITS.format('headline')}, "
    r"'(201[0-9])[.\s\x{{3000}}年]+([0-9]{{1,2}})[.\s\x{{3000}}月]+([0-9]{{1,2}})', {0})"
)
DATE = (
    "strftime(try_strptime("
    + " || '.' || ".join(DATE_PART.format(g) for g in (1, 2, 3))
    + ", '%Y.%m.%d'), '%Y-%m-%d')"
)
KEYWORD1 = r"nullif(regexp_extract(headline, '^[^\n]*［([^\n]*)］', 1), '')"
KEYWORD2 = r"nullif(regexp_extract(headline, '^[^\n]*（([^\n]*)）', 1), '')"

LINE = DIGITS.format(r"replace(content, chr(10), '')")
STRICT = rf"(?:^|[^0-9])(([1-9][0-9]{{1,7}})[{NOUN}][^\n]{{0,5}})"


def _cleaned(hit: str) -> str:
    return f"regexp_replace(regexp_replace({hit}, '[0-9]{{1,10}}人民警察', '', 'g'), '{PHRASES}', '', 'g')"


def _bounded(expr: str) -> str:
    return f"CASE WHEN {expr} <= 999999 THEN {expr} END"


ARABIC = _bounded(
    f"CASE WHEN regexp_extract({_cleaned(f'''regexp_extract({LINE}, '{STRICT}', 1)''')}, '^[0-9]+') = "
    f"regexp_extract({LINE}, '{STRICT}', 2) THEN try_cast(regexp_extract({LINE}, '{STRICT}', 2) AS INT) END"
)
COMPAT = _bounded(
    "try_cast(regexp_extract("
    + _cleaned(rf"regexp_extract({LINE}, '[1-9][0-9]?0{{0,6}}[{NOUN}][^\n]{{5}}')")
    + ", '[0-9]{2,8}') AS INT)"
)
NUMERAL_HIT = (
    rf"regexp_replace(regexp_extract({LINE}, '[一二两三四五六七八九上][十百千万][^\n]{{0,4}}[{NOUN}]'), '{PHRASES}', '', 'g')"
)
RUN = f"regexp_extract({NUMERAL_HIT}, '^[一二两三四五六七八九十百千万零]+')"


def _digit(expr: str) -> str:
    return f"try_cast(translate({expr}, '一二两三四五六七八九', '1223456789') AS INT)"


def _section(run: str, leading: bool) -> str:
    pairs = f"regexp_extract_all({run}, '[一二两三四五六七八九][十百千]')"
    value = (
        f"coalesce(list_sum(list_transform({pairs}, lambda p: {_digit('p[1:1]')} * "
        "CASE p[2:2] WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END)), 0)"
    )
    ones = "(?:^|[十零])" if leading else "[十零]"
    return f"({value} + coalesce({_digit(f'''regexp_extract({run}, '{ones}([一二两三四五六七八九])$', 1)''')}, 0))"


def _numeral(run: str) -> str:
    left, right = f"split_part({run}, '万', 1)", f"split_part({run}, '万', 2)"
    return (
        f"nullif(CASE WHEN contains({run}, '万') THEN {_section(left, True)} * 10000 + {_section(right, False)} "
        f"ELSE {_section(run, True)} END, 0)"
    )


NUMERAL = _bounded(
    f"CASE WHEN contains({NUMERAL_HIT}, '上万') THEN 10000 WHEN contains({NUMERAL_HIT}, '上千') THEN 1000 "
    f"WHEN contains({NUMERAL_HIT}, '上百') THEN 100 ELSE {_numeral(RUN)} END"
)
PEOPLE = f"greatest({ARABIC}, {NUMERAL})"


def gazetteer(name: str, of: str = "documents") -> str:
    """CTE g = kind, place."""
    bare = f"replace({name}, ' ', '')"
    short = f"regexp_replace({bare}, '市|县|区', '', 'g')"
    return rf"""raw AS (SELECT {q.WORD_KIND} AS kind, {name} AS name, {bare} AS bare, {short} AS short
          FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM {of})),
    g AS (SELECT DISTINCT kind, place FROM (SELECT kind, unnest(regexp_split_to_array(
          CASE WHEN kind = 'city' AND length(short) >= 2 THEN short ELSE bare END, '[\s\x{{3000}}]+')) AS place FROM raw)
          WHERE place <> '')"""


def places_sql(of: str) -> str:
    return f"""{CONTENT}, {gazetteer(q.WORD_PLACE, of)},
    hit AS (SELECT c.page_id, g.kind, g.place FROM c JOIN g
            ON contains(c.headline || chr(10) || coalesce(c.content, ''), g.place)),
    pl AS (SELECT page_id, string_agg(DISTINCT place, '|' ORDER BY place) AS places,
           max({{'n': length(place), 'p': place}}) FILTER (WHERE kind = 'city') AS city,
           max({{'n': length(place), 'p': place}}) FILTER (WHERE kind = 'county') AS county
           FROM hit GROUP BY page_id)"""


def place_rows(of: str) -> str:
    return f"WITH {places_sql(of)} {PLACE_FIELDS}"


PLACES = places_sql("documents")
PLACE_FIELDS = (
    f"SELECT c.page_id, coalesce(pl.places, '') AS places, coalesce(pl.city.p, 'none') AS city, "
    "coalesce(pl.county.p, 'none') AS county FROM c LEFT JOIN pl ON pl.page_id = c.page_id"
)
CASES = f"""{PLACES},
    cs AS (SELECT c.page_id, c.url, coalesce({DATE}, nullif({DATE_RAW}, ''), 'None') AS date, {DATE} AS day,
           nullif({DATE_RAW}, '') AS date_raw, coalesce(pl.city.p, 'none') AS city, coalesce(pl.county.p, 'none') AS county,
           coalesce(headline, 'None') AS headline, coalesce(content, 'None') AS content,
           coalesce({KEYWORD1}, 'none') AS keyword1, coalesce({KEYWORD2}, 'none') AS keyword2,
           coalesce(CAST({PEOPLE} AS VARCHAR), 'NA') AS people
           FROM c LEFT JOIN pl ON pl.page_id = c.page_id)"""
CASE_FIELDS = "date, city, county, headline, content, keyword1, keyword2, people"
GUARD = "content <> 'None' AND NOT contains(headline, 'Service') AND NOT contains(headline, 'Hotspot')"


def counts(**values: str) -> str:
    fields = ", ".join(f"coalesce({v}, -1) AS {k}" for k, v in values.items())
    return f"WITH {CONTENT} SELECT page_id, {fields} FROM c"


def upsert_sql() -> str:
    merged = ", ".join(
        f"CASE WHEN o.url IS NULL OR ({GUARD.replace('content', 'n.content').replace('headline', 'n.headline')}) "
        f"THEN n.{f} ELSE o.{f} END AS {f}"
        for f in CASE_FIELDS.split(", ")
    )
    return f"""WITH {CASES},
    o AS (SELECT url, 'None' AS date, 'none' AS city, 'none' AS county, 'stored' AS headline, md5(url) AS content,
          'none' AS keyword1, 'none' AS keyword2, 'NA' AS people FROM pages WHERE page_id % 2 = 1)
    SELECT n.url, {merged} FROM cs n LEFT JOIN o ON o.url = n.url"""


def constraint_sql() -> str:
    nulls = {
        "url": "url IS NULL", "date": "day IS NULL", "date_raw": "date_raw IS NULL", "city": "city = 'none'",
        "county": "county = 'none'", "headline": "headline = 'None'", "content": "content = 'None'",
        "keyword1": "keyword1 = 'none'", "keyword2": "keyword2 = 'none'", "people": "people = 'NA'",
    }
    return (
        f"WITH {CASES}, x AS MATERIALIZED (SELECT * FROM cs UNION ALL SELECT * FROM cs WHERE page_id % 10 = 0) "
        "SELECT 'duplicate_url' AS \"check\", count(*) AS violations FROM (SELECT url FROM x GROUP BY url HAVING count(*) > 1) "
        + " ".join(f"UNION ALL SELECT 'null_{k}', count(*) FROM x WHERE {v}" for k, v in nulls.items())
    )


WEIBO = f"contains(html, '{PLATFORM}')"
POST_ID = (
    "coalesce(try_cast(CASE WHEN contains(url, 'post') THEN split_part(url, '/', 5) "
    "ELSE split_part(split_part(url, '/', -1), '_', 1) END AS BIGINT), -1)"
)


def noise_ok(post: str) -> str:
    return (
        f"CASE WHEN length({post}) < 10 THEN NOT contains({post}, '@') "
        f"WHEN length({post}) < 28 THEN NOT contains({post}, '{PLATFORM_DOMAIN}') ELSE true END"
    )


def post_rows(layout: str) -> str:
    """From found(page_id, url, post_seq, nickname, post, images) to the result columns."""
    return f"""SELECT url, {POST_ID} AS source_post_id, '{layout}' AS layout, CAST(post_seq AS INT) AS post_seq,
    {strip('nickname')} AS nickname, {strip('post')} AS post, coalesce(images, '') AS images FROM found
    WHERE {strip("coalesce(nickname, '')")} <> '' AND {strip("coalesce(post, '')")} <> '' AND {noise_ok(strip('post'))}"""


# Pages without a container give no posts.
BOXED = "EXISTS (SELECT 1 FROM el bx WHERE bx.page_id = {0}.page_id AND bx.cls = 'content')"

# inn: every token with the start and class of the innermost div around it.
INNER = """inn AS (SELECT n.page_id, n.url, n.idx, n.tok, n.tag, n.closing, n.name, n.cls, n.src, n.next_tok, n.wrapped,
      sum(CASE WHEN n.name NOT IN ('a', 'em', 'i', 'b') THEN 0 WHEN n.closing THEN -1 ELSE 1 END)
        OVER (PARTITION BY n.page_id ORDER BY n.idx) AS inline_depth, w.bs, w.bcls
    FROM n LEFT JOIN (SELECT n.page_id, n.idx, max(el.s) AS bs, arg_max(el.cls, el.s) AS bcls FROM n JOIN el
      ON el.page_id = n.page_id AND el.s < n.idx AND el.e > n.idx GROUP BY n.page_id, n.idx) w
      ON w.page_id = n.page_id AND w.idx = n.idx),
    lnk AS (SELECT page_id, idx, bs, bcls, cls, tok, wrapped, CASE WHEN starts_with(next_tok, '<') THEN '' ELSE next_tok END AS label,
      lag(name) OVER (PARTITION BY page_id ORDER BY idx) AS before FROM inn WHERE tag),
    an AS (SELECT l.* FROM lnk l WHERE (starts_with(l.tok, '<a ') OR l.tok = '<a>') AND l.wrapped = 0),
    chain AS (SELECT p.page_id, coalesce(
      (SELECT nullif(trim(min_by(label, idx)), '') FROM an WHERE page_id = p.page_id AND bcls = 'WB_info' AND cls = 'WB_name S_func1' AND label <> ''),
      (SELECT nullif(trim(min_by(label, idx)), '') FROM an WHERE page_id = p.page_id AND bcls = 'WB_info' AND label <> ''),
      (SELECT nullif(trim(min_by(label, idx)), '') FROM an WHERE page_id = p.page_id AND bcls = 'WB_text' AND label <> ''),
      (SELECT nullif(trim(min_by(tok, idx)), '') FROM inn WHERE page_id = p.page_id AND bcls = 'userName' AND NOT tag),
      (SELECT nullif(trim(min_by(label, idx)), '') FROM an WHERE page_id = p.page_id AND before = 'p' AND cls = 'WB_name S_func1' AND label <> '')
      ) AS page_name FROM dd p)"""


def layout_1a(html: str, url: str, where: str = "true") -> str:
    return f"""WITH {markup(html, url, f"{WEIBO} AND ({where})")}, {INNER},
    u AS (SELECT page_id, url, s, e FROM el WHERE cls = 'WB_text'),
    home AS (SELECT i.*, CASE WHEN i.bcls = 'msgCnt' THEN o.bs ELSE i.bs END AS us FROM inn i
      LEFT JOIN inn o ON o.page_id = i.page_id AND o.idx = i.bs),
    bnd AS (SELECT u.page_id, u.s, min_by(a.label, a.idx) AS next_name FROM u
      JOIN el c ON c.page_id = u.page_id AND c.cls = 'WB_info' AND c.s > u.s AND c.e < u.e
      JOIN an a ON a.page_id = u.page_id AND a.bs = c.s AND a.cls = 'WB_name S_func1' AND a.label <> '' GROUP BY u.page_id, u.s),
    num AS (SELECT u.*, bnd.next_name, coalesce(sum(CASE WHEN bnd.s IS NULL THEN 0 ELSE 1 END) OVER
      (PARTITION BY u.page_id ORDER BY u.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS post_seq
      FROM u LEFT JOIN bnd ON bnd.page_id = u.page_id AND bnd.s = u.s),
    body AS (SELECT num.page_id, num.url, num.post_seq,
      string_agg(CASE WHEN NOT h.tag AND h.inline_depth = 0 THEN {unescape('h.tok')} END, '' ORDER BY h.idx) AS post,
      string_agg(CASE WHEN h.name = 'img' AND h.inline_depth = 0 THEN h.src END, ',' ORDER BY h.idx) AS images
      FROM num LEFT JOIN home h ON h.page_id = num.page_id AND h.us = num.s GROUP BY ALL),
    nm AS (SELECT page_id, post_seq + 1 AS post_seq, next_name FROM num WHERE next_name IS NOT NULL),
    found AS (SELECT b.page_id, b.url, b.post_seq, CASE WHEN b.post_seq = 0 THEN ch.page_name ELSE nm.next_name END AS nickname,
      b.post, b.images FROM body b LEFT JOIN nm ON nm.page_id = b.page_id AND nm.post_seq = b.post_seq
      LEFT JOIN chain ch ON ch.page_id = b.page_id WHERE {BOXED.format('b')} AND EXISTS (SELECT 1 FROM el WHERE el.page_id = b.page_id AND el.cls = 'WB_info'))
    {post_rows('1a')}"""


def layout_1b(html: str, url: str, where: str = "true") -> str:
    return f"""WITH {markup(html, url, f"{WEIBO} AND ({where})")}, {INNER},
    sz AS (SELECT page_id, count(*) FILTER (WHERE cls = 'WB_info') AS ni, count(*) FILTER (WHERE cls = 'WB_text') AS nt FROM el GROUP BY page_id),
    u AS (SELECT el.page_id, el.url, el.s, el.e, row_number() OVER (PARTITION BY el.page_id ORDER BY el.s) - 1 AS k
      FROM el JOIN sz ON sz.page_id = el.page_id AND sz.ni > sz.nt WHERE el.cls = 'WB_info'),
    fl AS (SELECT page_id, bs, min_by(tok || label, idx) AS link, min_by(label, idx) AS name FROM an
      WHERE contains(tok, 'href') GROUP BY page_id, bs),
    ui AS (SELECT u.page_id, u.s, string_agg(t.src, ',' ORDER BY t.idx) AS images FROM u JOIN t
      ON t.page_id = u.page_id AND t.idx > u.s AND t.idx < u.e AND t.name = 'img' GROUP BY u.page_id, u.s),
    ut AS (SELECT page_id, bs, string_agg({unescape('tok')}, '' ORDER BY idx) AS text FROM inn
      WHERE NOT tag AND inline_depth = 0 GROUP BY page_id, bs),
    x AS (SELECT u.*, fl.name, fl.link IS NOT NULL AS has_link, ui.images, ut.text,
      coalesce(contains(fl.link, '{PLATFORM_DOMAIN}') AND NOT contains(fl.link, '{OTHER_DOMAIN}'), false) AS author
      FROM u LEFT JOIN fl ON fl.page_id = u.page_id AND fl.bs = u.s LEFT JOIN ui ON ui.page_id = u.page_id AND ui.s = u.s
      LEFT JOIN ut ON ut.page_id = u.page_id AND ut.bs = u.s),
    num AS (SELECT *, sum(author::INT) OVER (PARTITION BY page_id ORDER BY k) AS post_seq FROM x),
    found AS (SELECT num.page_id, num.url, num.post_seq,
      CASE WHEN num.post_seq = 0 THEN any_value(ch.page_name) ELSE max(CASE WHEN author THEN num.name END) END AS nickname,
      string_agg(CASE WHEN author OR (NOT has_link AND num.images IS NULL AND k >= 2) THEN text END, '' ORDER BY k) AS post,
      string_agg(CASE WHEN NOT has_link THEN num.images END, ',' ORDER BY k) AS images
      FROM num LEFT JOIN chain ch ON ch.page_id = num.page_id WHERE {BOXED.format('num')} GROUP BY num.page_id, num.url, num.post_seq)
    {post_rows('1b')}"""


# pr: paragraphs with start and end.
PARAGRAPHS = """ends AS (SELECT page_id, idx, name, closing FROM n WHERE name IN ('p', 'div') OR (name = 'article' AND closing)),
    pe AS (SELECT *, lead(idx, 1, 1000000000) OVER (PARTITION BY page_id ORDER BY idx) AS e FROM ends),
    pr AS (SELECT page_id, idx AS s, e FROM pe WHERE name = 'p' AND NOT closing)"""


def layout_2(html: str, url: str, where: str = "true") -> str:
    return f"""WITH {markup(html, url, f"{WEIBO} AND ({where})")}, {PARAGRAPHS},
    x AS (SELECT pr.page_id, pr.s,
      min_by(CASE WHEN n.name = 'a' AND n.wrapped = 0 AND n.cls = 'con_name_txt S_txt1' AND NOT starts_with(n.next_tok, '<') THEN n.next_tok END,
        CASE WHEN n.name = 'a' AND n.wrapped = 0 AND n.cls = 'con_name_txt S_txt1' AND NOT starts_with(n.next_tok, '<') THEN n.idx END) AS name,
      string_agg(CASE WHEN n.name = 'img' THEN n.src END, ',' ORDER BY n.idx) AS images,
      string_agg(CASE WHEN NOT n.tag THEN {unescape('n.tok')} END, '' ORDER BY n.idx) AS text
      FROM pr LEFT JOIN n ON n.page_id = pr.page_id AND n.idx > pr.s AND n.idx < pr.e GROUP BY pr.page_id, pr.s),
    num AS (SELECT *, sum((name IS NOT NULL)::INT) OVER (PARTITION BY page_id ORDER BY s) AS post_seq FROM x),
    found AS (SELECT num.page_id, any_value(dd.url) AS url, post_seq, max(name) AS nickname,
      string_agg(CASE WHEN name IS NULL AND images IS NULL THEN text END, '' ORDER BY s) AS post,
      string_agg(CASE WHEN name IS NULL THEN images END, ',' ORDER BY s) AS images
      FROM num JOIN dd ON dd.page_id = num.page_id WHERE post_seq > 0 AND {BOXED.format('num')} GROUP BY num.page_id, post_seq)
    {post_rows('2')}"""


def _real(text: str) -> str:
    return (
        f"len(list_filter(string_split(coalesce({text}, ''), ' '), lambda w: length(w) > 1 AND w[1:1] <> '@' AND w[2:2] <> '@')) > 0"
    )


def _state(text: str) -> str:
    return f"CASE WHEN coalesce({text}, '') = '' THEN 'empty' WHEN {_real(text)} THEN 'real' ELSE 'mentions' END"


def layout_3(html: str, url: str, where: str = "true") -> str:
    is_name = "(s.link_text IS NOT NULL AND NOT contains(s.link_text, '.com'))"
    own = "concat_ws(' ', s.own, s.body)"
    return rf"""WITH RECURSIVE {markup(html, url, f"{WEIBO} AND ({where})")}, {PARAGRAPHS},
    box AS (SELECT el.page_id, el.s, el.e FROM el LEFT JOIN (SELECT page_id, idx FROM n WHERE name = 'script') sc
      ON sc.page_id = el.page_id AND sc.idx > el.s AND sc.idx < el.e WHERE el.cls = 'content'
      GROUP BY el.page_id, el.s, el.e QUALIFY row_number() OVER (PARTITION BY el.page_id ORDER BY count(sc.idx) > 0, el.s) = 1),
    cp AS (SELECT pr.* FROM pr JOIN box ON box.page_id = pr.page_id AND pr.s > box.s AND pr.s < box.e),
    tk AS (SELECT cp.s, n.*, lead(n.next_tok) OVER (PARTITION BY n.page_id, cp.s ORDER BY n.idx) AS after_next,
      sum(CASE WHEN n.name NOT IN ('a', 'i') THEN 0 WHEN n.closing THEN -1 ELSE 1 END)
      OVER (PARTITION BY n.page_id, cp.s ORDER BY n.idx) AS inline_depth
      FROM cp JOIN n ON n.page_id = cp.page_id AND n.idx > cp.s AND n.idx < cp.e),
    x AS (SELECT page_id, s,
      min_by(tok || next_tok || after_next, idx) FILTER (WHERE name = 'a' AND NOT closing AND wrapped = 0) AS link,
      min_by(CASE WHEN starts_with(next_tok, '<') THEN after_next ELSE next_tok END, idx) FILTER (WHERE name = 'a' AND NOT closing AND wrapped = 0) AS link_text,
      nullif(trim(regexp_replace(string_agg(CASE WHEN NOT tag AND inline_depth = 0 THEN {unescape('tok')} END, ' ' ORDER BY idx), '\s+', ' ', 'g')), '') AS text,
      string_agg(CASE WHEN name = 'img' THEN src END, ',' ORDER BY idx) AS images FROM tk GROUP BY page_id, s),
    k AS (SELECT *, CASE WHEN link IS NULL THEN 'body' WHEN contains(link, '{PLATFORM}') AND NOT contains(link, '{OTHER_DOMAIN}') THEN 'open'
      WHEN contains(link, '{PLATFORM}') THEN 'skip' ELSE 'stop' END AS kind FROM x),
    sg AS (SELECT *, sum((kind = 'open')::INT) OVER (PARTITION BY page_id ORDER BY s) AS seg FROM k),
    st AS (SELECT *, sum((kind = 'stop')::INT) OVER (PARTITION BY page_id, seg ORDER BY s) AS stops FROM sg WHERE seg > 0),
    segs AS MATERIALIZED (SELECT page_id, seg, max(CASE WHEN kind = 'open' THEN trim(link_text) END) AS link_text,
      max(CASE WHEN kind = 'open' THEN text END) AS own,
      nullif(string_agg(CASE WHEN kind = 'body' AND stops = 0 THEN text END, ' ' ORDER BY s), '') AS body,
      string_agg(CASE WHEN kind = 'body' AND stops = 0 THEN images END, ',' ORDER BY s) AS images
      FROM st GROUP BY page_id, seg),
    walk AS (
      SELECT s.*, CAST(NULL AS VARCHAR) AS joins, {is_name} AS named, {_state('s.body')} AS state FROM segs s WHERE seg = 1
      UNION ALL
      SELECT s.*, CASE WHEN w.named AND w.state = 'empty' THEN 'own' WHEN w.named AND w.state = 'mentions' THEN 'link' END,
        CASE WHEN w.named AND w.state <> 'real' THEN w.named ELSE {is_name} END,
        CASE WHEN w.named AND w.state = 'empty' THEN {_state(own)}
             WHEN w.named AND w.state = 'mentions' THEN CASE WHEN {_real('s.body')} THEN 'real' ELSE 'mentions' END
             ELSE {_state('s.body')} END
      FROM walk w JOIN segs s ON s.page_id = w.page_id AND s.seg = w.seg + 1),
    num AS (SELECT *, sum((joins IS NULL)::INT) OVER (PARTITION BY page_id ORDER BY seg) AS post_seq FROM walk),
    found AS (SELECT num.page_id, any_value(dd.url) AS url, post_seq,
      max(CASE WHEN joins IS NULL AND NOT contains(link_text, '.com') THEN link_text END) AS nickname,
      string_agg(nullif(concat_ws(' ', CASE joins WHEN 'own' THEN own WHEN 'link' THEN link_text END, body), ''), ' ' ORDER BY seg) AS post,
      string_agg(images, ',' ORDER BY seg) AS images
      FROM num JOIN dd ON dd.page_id = num.page_id GROUP BY num.page_id, post_seq)
    {post_rows('3')}"""


def posts_all_sql() -> str:
    html, url = deco.HTML_ALL, deco.POST_URL_UNIQUE
    parts = " UNION ALL ".join(
        f"(SELECT * FROM ({layout(html, url)}))" for layout in (layout_1a, layout_1b, layout_2, layout_3)
    )
    return (
        f"SELECT * FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY url, nickname, post ORDER BY layout, post_seq) = 1"
    )


def stored_posts_sql() -> str:
    return rf"""SELECT url, source_post_id, layout, post_seq, sha256('{q.DEMO_KEY}' || nickname) AS nickname,
        regexp_replace(post, '@[\p{{L}}\p{{N}}_-]+', '@_', 'g') AS post, images FROM ({posts_all_sql()})"""


def sibling_sql(mixed: bool) -> str:
    block = "(contains(node, 'WB_info') OR contains(node, 'WB_text'))"
    named = f"({block} AND contains(node, 'WB_name'))"
    other_name = r"regexp_extract(node, '<a[^>]*>([^<]*)</a', 1)"
    spans = (
        "list_aggregate(list_transform(regexp_extract_all(coalesce(two, ''), '<span[^>]*>([^<]*)</span', 1), lambda x: trim(x)), "
        "'string_agg', '')"
    )
    use = "NOT bool_or(blk)" if mixed else "false"
    return rf"""WITH {markup(deco.HTML_SIBLING, deco.POST_URL_UNIQUE)},
    box AS (SELECT page_id, s, e FROM el WHERE regexp_matches(cls, '(^|\s)content(\s|$)')
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY s) = 1),
    c AS (SELECT n.*, sum(CASE WHEN n.name <> 'article' THEN 0 WHEN n.closing THEN -1 ELSE 1 END)
      OVER (PARTITION BY n.page_id ORDER BY n.idx) AS art FROM n JOIN box ON box.page_id = n.page_id AND n.idx > box.s AND n.idx < box.e),
    lv AS (SELECT *, sum(CASE WHEN name = 'article' OR (art = 0 AND name IN ('div', 'p', 'a', 'i', 'b', 'span'))
      THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS lvl FROM c),
    st AS (SELECT *, lag(lvl, 1, 0) OVER (PARTITION BY page_id ORDER BY idx) AS prev FROM lv),
    nn AS (SELECT *, sum(CASE WHEN prev = 0 AND NOT closing THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS node_no FROM st),
    nd AS (SELECT page_id, node_no, string_agg(tok, '' ORDER BY idx) AS node FROM nn GROUP BY page_id, node_no),
    w AS (SELECT *, lead(node, 2) OVER (PARTITION BY page_id ORDER BY node_no) AS two, {block} AS blk FROM nd),
    z AS (SELECT page_id, bool_or(blk) AS any_block,
      max_by(regexp_extract(node, 'class="(?:[^"]*\s)?(?:WB_name|S_func1)(?:\s[^"]*)?"[^>]*>([^<]*)<', 1), node_no) FILTER (WHERE {named}) AS n1,
      max_by(regexp_replace(two, '<[^<]+?>', '', 'g'), node_no) FILTER (WHERE {named} AND contains(two, 'WB_text')) AS t1,
      max_by({other_name}, node_no) FILTER (WHERE contains(node, '{PLATFORM}')) AS n2,
      max_by({spans}, node_no) FILTER (WHERE contains(node, '{PLATFORM}')) AS t2, {use} AS use2 FROM w GROUP BY page_id)
    SELECT d.url, {POST_ID.replace('url', 'd.url')} AS source_post_id,
      coalesce(nullif({strip(unescape('CASE WHEN use2 THEN n2 ELSE n1 END'))}, ''), 'none') AS nickname,
      coalesce(nullif({strip(unescape('CASE WHEN use2 THEN t2 ELSE t1 END'))}, ''), 'none') AS post
    FROM d LEFT JOIN z ON z.page_id = d.page_id"""


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _end_rules() -> str:
    """name, what it ends within which walls, and what it ends otherwise."""
    rows = {}
    for names, ends, walls in ENDS:
        own = tuple(e for e in ends if e != "p") or ends
        then = ("p",) if own != ends else ()
        for name in names:
            rows.setdefault(name, f"('{name}', {_list(own)}, {_list(walls)}, {_list(then)}, {_list(SCOPE)})")
    return ", ".join(rows.values())


def node_sql(html: str) -> str:
    """The open elements of each page, followed from token to token by recursion; children numbered at the end."""
    last = "list_max(list_filter(range(1, len(tags) + 1), lambda i: list_contains({0}, tags[i])))"
    rule = "CASE WHEN {0} > coalesce({1}, 0) THEN {0} - 1 ELSE {2} END"
    second = rule.format(last.format("e2"), last.format("w2"), "len(tags)")
    first = rule.format(last.format("e1"), last.format("w1"), second)
    opens = f"(name NOT IN ('{TEXT}', '{OTHER}') AND NOT starts_with(name, '/') AND NOT list_contains({_list(VOID)}, name))"
    return rf"""WITH RECURSIVE {source(html, 'url')},
    l AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '{SCRIPT}', '<script>', 'g'), '{NOISE}', '', 'g'),
          '<[/!?A-Za-z](?:[^<>"'']|"[^"<]*"|''[^''<]*'')*>|<[^<>]+>|[^<]+|<') AS toks FROM dd),
    r AS (SELECT page_id, unnest(toks) AS tok, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS idx FROM l),
    k AS (SELECT *, CASE WHEN starts_with(tok, '<') AND length(tok) > 1 THEN lower(regexp_extract(tok, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1))
          ELSE '{TEXT}' END AS name FROM r),
    rules(name, e1, w1, e2, w2) AS (VALUES {_end_rules()}),
    t AS MATERIALIZED (SELECT k.*, e1, w1, e2, w2 FROM k LEFT JOIN rules ON rules.name = k.name),
    walk AS (SELECT page_id, -1 AS idx, CAST([] AS VARCHAR[]) AS tags, CAST([] AS INT[]) AS ids, -1 AS parent, 0 AS depth FROM l
      UNION ALL
      SELECT page_id, idx, CASE WHEN {opens} THEN list_append(tags[1:keep], name) ELSE tags[1:keep] END,
        CASE WHEN {opens} THEN list_append(ids[1:keep], idx) ELSE ids[1:keep] END, coalesce(ids[keep], -1), CAST(keep AS INT)
      FROM (SELECT w.page_id, t.idx, t.name, w.tags, w.ids, CASE WHEN starts_with(name, '/')
          THEN coalesce({last.format('[substr(name, 2)]')} - 1, len(tags)) WHEN e1 IS NULL THEN len(tags) ELSE {first} END AS keep
        FROM walk w JOIN t ON t.page_id = w.page_id AND t.idx = w.idx + 1))
    SELECT t.page_id, t.idx, CASE WHEN name = '{TEXT}' THEN 'text' ELSE 'element' END AS kind,
      CASE WHEN name = '{TEXT}' THEN '' ELSE name END AS tag,
      CASE WHEN name = '{TEXT}' THEN '' ELSE trim(regexp_extract(tok, '(?s)^<[A-Za-z][A-Za-z0-9]*(.*?)/?>$', 1)) END AS attrs,
      CASE WHEN name = '{TEXT}' THEN tok ELSE '' END AS text, parent, depth,
      CAST(row_number() OVER (PARTITION BY t.page_id, parent ORDER BY t.idx) - 1 AS INT) AS child
    FROM walk JOIN t ON t.page_id = walk.page_id AND t.idx = walk.idx WHERE name <> '{OTHER}' AND NOT starts_with(name, '/')"""


def guarded_sql() -> str:
    """Batches as ranks over all complete rows: the first row of a URL in batch and place is the one that is kept."""
    return f"""WITH {content_sql(deco.CASE_HTML, CLASSES).replace("url AS url", f"{deco.POST_URL} AS url")},
    two AS (SELECT c.*, page_id * 2 + copy AS place FROM c, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR page_id % 10 = 0),
    x AS (SELECT 0 AS batch, * FROM two WHERE page_id % 2 = 0
          UNION ALL SELECT 1, * FROM two WHERE page_id % 2 = 1 OR page_id % 4 = 0),
    y AS (SELECT *, url IS NOT NULL AND headline IS NOT NULL AND content IS NOT NULL AS whole FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY url, whole ORDER BY batch, place) AS n,
          row_number() OVER (PARTITION BY url, whole, batch ORDER BY place) AS m FROM y)
    SELECT batch, place, url, CASE WHEN whole AND n = 1 THEN row_number() OVER (PARTITION BY whole AND n = 1 ORDER BY batch, place)
      ELSE 0 END AS id, CASE WHEN whole AND n = 1 THEN '' WHEN whole THEN CASE WHEN m = 1 THEN 'stored' ELSE 'duplicate' END
      ELSE concat_ws(',', CASE WHEN url IS NULL THEN 'null_url' END, CASE WHEN headline IS NULL THEN 'null_headline' END,
        CASE WHEN content IS NULL THEN 'null_content' END) END AS reasons FROM z"""


def all_oracles() -> dict[str, str]:
    urls = rf"SELECT page_id, trim(regexp_replace({q.URL_BROKEN}, '[\r\n]', '', 'g')) AS url FROM pages"
    todo = f"SELECT DISTINCT url FROM ({urls}) EXCEPT SELECT url FROM ({urls}) WHERE page_id % 2 = 0"
    plain = headline_sql("html")
    head = f"WITH {source(deco.CASE_HTML, 'url')}, h AS (SELECT page_id, {headline_sql('html')} AS headline FROM d)"
    flag = f"WITH {CASES} SELECT page_id, url, {CASE_FIELDS} FROM cs"
    unique = deco.POST_URL_UNIQUE
    return {
        "url_normalise_filter": f"SELECT * FROM ({urls}) WHERE contains(url, '{q.SITE}') AND NOT contains(url, '{q.EXCLUDED}')",
        "url_post_id": f"SELECT page_id, {POST_ID} AS post_id FROM (SELECT page_id, {deco.POST_URL} AS url FROM pages)",
        "frontier": todo,
        "progress": f"SELECT (SELECT count(*) FROM pages WHERE page_id % 2 = 0) AS done, (SELECT count(*) FROM ({todo})) AS remaining",
        "gazetteer_clean": f"WITH {gazetteer(q.WORD_RAW)} SELECT kind, place FROM g",
        "gazetteer_short": f"""WITH {gazetteer(q.WORD_PLACE)} SELECT kind, place FROM g WHERE length(place) < 2""",
        "headline": f"SELECT page_id, {plain} AS headline, {unescape(plain)} AS plain_headline FROM pages",
        "content_text": f"WITH {CONTENT} SELECT page_id, coalesce(content, 'None') AS content FROM c",
        "container_nested": f"WITH {content_sql(q.NESTED_HTML, ONLY_CONTENT)} SELECT page_id, content FROM c",
        "token_table": rf"""WITH {markup(q.NESTED_HTML)} SELECT page_id, CAST(idx - 1 AS INT) AS idx,
            CASE WHEN NOT tag THEN 'text' WHEN closing THEN 'close' ELSE 'open' END AS kind,
            CASE WHEN tag THEN name ELSE '' END AS tag,
            CASE WHEN tag THEN trim(regexp_extract(tok, '^<[A-Za-z][A-Za-z0-9]*([^>]*?)/?>', 1)) ELSE '' END AS attrs,
            CASE WHEN tag THEN '' ELSE tok END AS text,
            CAST(depth + CASE WHEN name = 'div' AND closing THEN 1 ELSE 0 END AS INT) AS div_depth FROM n""",
        "page_encodings": f"""SELECT page_id, ['GB18030', 'windows-1252', 'UTF-16LE', 'UTF-8'][CAST(page_id % 4 + 1 AS INT)] AS charset,
            CASE WHEN page_id % 7 = 0 AND page_id % 4 <> 1 THEN 'none' ELSE {q.NAMED_HTML} END AS html FROM pages""",
        "node_table": node_sql(q.TREE_HTML),
        "headline_date": f"{head} SELECT page_id, coalesce({DATE}, 'none') AS date, coalesce(nullif({DATE_RAW}, ''), 'none') AS date_raw FROM h",
        "bracket_keywords": f"{head} SELECT page_id, coalesce({KEYWORD1}, 'none') AS keyword1, coalesce({KEYWORD2}, 'none') AS keyword2 FROM h",
        "place_tags": place_rows("documents"),
        "place_tags_join": place_rows("documents"),
        "place_tags_inline": place_rows("benchmark"),
        "people_arabic": counts(people=ARABIC, people_compat=COMPAT),
        "people_numeral": counts(people=NUMERAL),
        "people_largest": counts(people=PEOPLE),
        "case_records": flag,
        "case_upsert": upsert_sql(),
        "constraint_check": constraint_sql(),
        "record_guard": f"WITH {CASES} SELECT page_id FROM cs WHERE {GUARD}",
        "keyword_filter": "SELECT doc_id, contains(text, 'The') AS exact FROM documents WHERE text ILIKE '%the%'",
        "keyword_slice": "SELECT doc_id, text FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 88 OFFSET 12",
        "slice_last": "SELECT text FROM documents ORDER BY text DESC LIMIT 100",
        "guarded_insert": guarded_sql(),
        "posts_1a": layout_1a(deco.HTML_1A, unique),
        "posts_1b": layout_1b(deco.HTML_1B, unique),
        "posts_2": layout_2(deco.HTML_2, unique),
        "posts_3": layout_3(deco.HTML_3, unique),
        "posts_all": posts_all_sql(),
        "post_append": stored_posts_sql(),
        "post_batches": f"""SELECT *, CAST(CASE WHEN regexp_extract(url, '[0-9]+')::INT % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS batch
            FROM ({stored_posts_sql()})""",
        "post_sibling": sibling_sql(False),
        "post_sibling_mixed": sibling_sql(True),
        "post_noise": f"""WITH s AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.,\\n]') AS ps FROM conversations),
            p AS (SELECT conv_id, turn, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS place, unnest(ps) AS piece FROM s)
            SELECT * FROM (SELECT conv_id, turn, place, {q.NOISY_TEXT} AS post FROM p) WHERE {noise_ok('post')}""",
        "sample_n": f"SELECT * FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|{q.SEED}') LIMIT {q.SAMPLE_SIZE}",
        "incremental_posts": stored_posts_sql(),
        "offline_posts": rf"""WITH s AS (SELECT page_id FROM (SELECT page_id, {deco.HTML_SIBLING} AS html FROM pages)
              WHERE contains(html, '{PLATFORM}') ORDER BY page_id LIMIT 88 OFFSET 12),
            u AS (SELECT {deco.POST_URL_UNIQUE} AS url FROM pages WHERE page_id IN (SELECT page_id FROM s))
            SELECT url, source_post_id, sha256('{q.DEMO_KEY}' || nickname) AS nickname,
              regexp_replace(post, '@[\p{{L}}\p{{N}}_-]+', '@_', 'g') AS post
            FROM ({sibling_sql(True)}) WHERE url IN (SELECT url FROM u) AND nickname <> 'none' AND post <> 'none'""",
        "sample_rand": f"SELECT least(count(*), {q.SAMPLE_SIZE}) AS rows, least(count(DISTINCT doc_id), {q.SAMPLE_SIZE}) AS ids, "
        f"least(count(*), {q.SAMPLE_SIZE}) AS whole_rows FROM documents",
        "incremental": f"WITH {CASES} SELECT url, {CASE_FIELDS} FROM cs",
    }
