from datetime import date
from itertools import accumulate
import random

from pyspark.sql import functions as F

from casework.functions import arrays, coding, markup
from casework.operators import filters


def test_running_sum(spark):
    random.seed(1)
    long = [random.choice([-1, 0, 1]) for _ in range(1500)]
    inputs = [long, [], [5], long[:256], long[:257], long[:512], long[:513]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i INT, x ARRAY<INT>")
    for r in rows.select("x", arrays.running_sum(F.col("x")).alias("s")).collect():
        assert r.s == list(accumulate(r.x))


def test_splits_put_every_item_in_one_run(spark):
    rows = spark.createDataFrame([([1, 0, 0, 1, 0, 1],), ([],), ([0, 0],)], "x ARRAY<INT>")
    got = rows.select(
        "x",
        arrays.split_before("x", lambda v: v == 1).alias("before"),
        arrays.split_before("x", lambda v: v == 1, keep_head=False).alias("tail"),
        arrays.split_after("x", lambda v: v == 1).alias("after"),
    ).collect()
    assert got[0].before == [[], [1, 0, 0], [1, 0], [1]]
    assert got[0].tail == got[0].before[1:]
    assert got[0].after == [[1], [0, 0, 1], [0, 1], []]
    for r in got:
        assert sum(r.before, []) == r.x and sum(r.after, []) == r.x


def test_headline_dates(values):
    heads = [
        "事件 2014年3月5日", "2014.3.5 x", "2014 3 5", "2014年12月", "2014　3　5", "２０１４年３月５日",
        "2014年13月5日", "none", None, "2009年1月1日", "2014..3..5",
    ]
    assert values(coding.headline_date, heads) == [
        date(2014, 3, 5), date(2014, 3, 5), date(2014, 3, 5), None, date(2014, 3, 5), date(2014, 3, 5),
        None, None, None, None, date(2014, 3, 5),
    ]
    assert values(coding.headline_date_raw, heads) == [
        "2014年3月5", "2014.3.5", "2014 3 5", "2014年12", "2014　3　5", "2014年3月5", "2014年13月5", None, None, None,
        "2014..3..5",
    ]


def test_bracket_keywords(values):
    heads = ["［a］b［c］（d）", "［］（）", "none", "（x［y］z）"]
    assert values(coding.keyword1, heads) == ["c", None, None, "y"]
    assert values(coding.keyword2, heads) == ["d", None, None, "x［y］z"]


def test_people_arabic(values):
    texts = [
        "30人参加了活动", "1500名业主聚集了", "1234人到场示威了", "5人，2015年至今", "5人来，30名工人到场了啊",
        "50元和200人民警察到场", "1234567人在这里了啊", "来了30人", "８０人聚集在那里", None, "30岁老人家都来", "30人\n口很多的地方",
    ]
    assert values(coding.people_arabic, texts) == [
        30, 1500, 1234, None, 30, None, None, 30, 80, None, None, None,
    ]
    compat = values(lambda t: coding.people_arabic(t, compat=True), texts)
    assert compat[:8] == [30, 1500, 34, 2015, 30, None, 67, None]


def test_people_numeral(values):
    texts = [
        "三百五十人", "上百名", "上千人", "上万工人", "上十人", "三十万人", "三万五千人", "一百零五家", "九百万人",
        "二百块钱民", "两千多户", "三百上千人", "十人", "三百五十六人",
    ]
    assert values(coding.people_numeral, texts) == [
        350, 100, 1000, 10000, None, 300000, 35000, 105, None, None, 2000, 1000, None, 356,
    ]


def test_people_takes_the_larger(values):
    assert values(coding.people, ["30人，上百人都在", "500人，三百人都在", "none", "上千人"]) == [100, 500, None, 1000]


def test_label_and_nodes(spark):
    html = (
        '<body><DIV class="a"><div class="main content">in <div>deep</div> out<p>one<p>two <b>b</b></p></div></DIV>'
        '<div class="content">z<img src="i.png"> <span>s<a>n</a></span><a>l <img src="j"></a> <em>e</em></div></body>'
    )
    page = spark.createDataFrame([(html,)], "h STRING").select(markup.label(F.col("h")).alias("p"))
    p = F.col("p")
    row = page.select(
        markup.first_div(p, "content", exact=False).alias("token"),
        markup.first_div(p, "content").alias("exact"),
        markup.first_div(p, "missing").alias("missing"),
        markup.divs(p, "content", exact=False).alias("both"),
        markup.paragraphs(p).alias("ps"),
    ).first()
    assert row.token == "in <div3>deep</div3> out<p>one<p>two <b>b</b></p>"
    assert row.exact.startswith("z<img") and row.missing is None
    assert row.both == [row.token, row.exact]
    assert row.ps == ["one", "two <b>b</b>"]
    box = markup.first_div(p, "content")
    row = page.select(
        markup.own_text(box).alias("span"),
        markup.own_text(box, ("span", "em")).alias("both"),
        markup.images(box).alias("images"),
        markup.own_images(box).alias("own_images"),
        markup.child_nodes(markup.first_div(p, "content", exact=False)).alias("nodes"),
    ).first()
    assert row.span == "z s " and row.both == "z s e"
    assert row.images == ["i.png", "j"] and row.own_images == ["i.png"]
    assert row.nodes == ["in ", "<div3>deep</div3>", " out", "<p>one", "<p>two <b>b</b></p>"]


def test_nested_divs_of_one_class_are_all_found(values):
    found = values(
        lambda t: markup.divs(markup.label(t), "q"), ['<div class="q">a<div class="q">b</div>c</div></div><div class="q">d']
    )[0]
    assert found == ['a<div2 class="q">b</div2>c', "b", "d"]


def test_own_text_of_nested_and_broken_markup(values):
    texts = [
        "<b>" * 300 + "x" + "</b>" * 300 + "y", "a</b>" * 3000 + "z", "a <b>open <i>no</i> end", "<a><span>n</span></a>k<span>s<a>n</a></span>",
        "p<br>q<hr/>r", None, "",
    ]
    assert values(markup.own_text, texts) == ["y", "a" * 3000 + "z", "a open  end", "ks", "pqr", None, ""]


def test_class_attributes_in_every_spelling(values):
    pages = [
        "<div CLASS='content'>a</div>", "<div id=x class=content>b</div>", '<div class="content x">c</div>',
        '<div class="x content">d</div>', '<div class="contents">e</div>', "<DIV class = \"content\" >f</DIV>",
        '<div data-class="content">g</div>', "<div>class=content</div>",
    ]
    read = lambda exact: values(lambda t: markup.first_div(markup.label(t), "content", exact), pages)
    assert read(True) == ["a", "b", None, None, None, "f", None, None]
    assert read(False) == ["a", "b", "c", "d", None, "f", None, None]


def test_image_addresses(values):
    assert values(markup.images, ["<img src=a.png><IMG alt='x' SRC='b.png'/><image src=c><img data-src=\"d\">"]) == [["a.png", "b.png"]]


def test_deep_and_wide_pages(values):
    deep = "<div>" * 700 + '<div class="content">x</div>' + "</div>" * 700
    wide = "<div>a</div>" * 3000 + '<div class="content">y<div>z</div></div>' + "<p>b</p>" * 3000
    got = values(lambda t: markup.strip_tags(markup.first_div(markup.label(markup.clean(t)), "content")), [deep, wide])
    assert got == ["x", "yz"]


def test_clean_keeps_only_that_there_was_a_script(values):
    page = '<!DOCTYPE html><style>p{}</style><SCRIPT a="b">var t="</p>";</SCRIPT>x<!-- <p> -->y<s>z</s>'
    assert values(markup.clean, [page]) == ["<SCRIPT>xy<s>z</s>"]


def test_unescape(values):
    texts = ["a &amp; b &lt;&gt;&quot;", "&#20013;&#x4e2d;&#999", "&#9999999;&#xD800;&#0;&#x1F600;", "&amp;lt; &quot;&apos;&nope;", "plain", None, "one &mdash; two &ldquo;x&rdquo; &eacute;&nbsp;&CounterClockwiseContourIntegral;", "&#00000000233;&#x00000000E9;&eacute &"]
    assert values(markup.unescape, texts) == ['a & b <>"', "中中&#999", "&#9999999;&#xD800;&#0;😀", "&lt; \"'&nope;", "plain", None, "one — two “x” é ∳", "éé&eacute &"]


def test_short_posts(values):
    posts = ["12345678@", "1234567890@", "123456789", "abc weibo.com", "x" * 27 + "weibo.com", "w" * 18 + "weibo.com", "w" * 19 + "weibo.com"]
    assert values(filters.worth_keeping, posts) == [False, True, True, False, True, False, True]


def test_record_guard(spark):
    rows = spark.createDataFrame(
        [("ok", "text"), ("Service down", "text"), ("a Hotspot", "text"), ("ok", None), (None, "text"), ("ok", "xNone")],
        "h STRING, c STRING",
    )
    got = rows.select(
        filters.valid_record(rows.h, rows.c).alias("a"), filters.valid_record(rows.h, rows.c, sentinels=True).alias("b")
    ).collect()
    assert [r.a for r in got] == [True, False, False, False, True, True]
    assert [r.b for r in got] == [True, False, False, False, True, False]


def test_keyword_case(values):
    assert values(lambda t: filters.mentions_keyword(t, "weibo", ignore_case=True), ["WEIBO", "a weibo", "x"]) == [True, True, False]
    assert values(lambda t: filters.mentions_keyword(t, "a%b", ignore_case=True), ["A%B", "axb"]) == [True, False]
    assert values(lambda t: filters.mentions_keyword(t, "weibo"), ["WEIBO", "a weibo"]) == [False, True]
