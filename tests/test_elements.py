"""Parent, depth and place of every node."""

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from casework.operators.elements import node_table


def _nodes(spark, html):
    table = spark.createDataFrame([(1, html)], "page_id INT, html STRING")
    return node_table(table).orderBy("idx").collect()


def _tree(rows):
    """``tag`` or text with that of the parent, and the place among its siblings."""
    label = {-1: None} | {r.idx: r.tag or r.text for r in rows}
    return [(label[r.idx], label[r.parent], r.depth, r.child) for r in rows]


def test_implied_ends(spark):
    assert _tree(_nodes(spark, "<ul><li>a<li><p>b<ul><li>c</ul><li>d</ul>")) == [
        ("ul", None, 0, 0), ("li", "ul", 1, 0), ("a", "li", 2, 0), ("li", "ul", 1, 1), ("p", "li", 2, 0), ("b", "p", 3, 0),
        ("ul", "li", 2, 1), ("li", "ul", 3, 0), ("c", "li", 4, 0), ("li", "ul", 1, 2), ("d", "li", 2, 0),
    ]
    assert _tree(_nodes(spark, "<p><b>a<br><div>b</p>c</div>")) == [
        ("p", None, 0, 0), ("b", "p", 1, 0), ("a", "b", 2, 0), ("br", "b", 2, 1), ("div", None, 0, 1), ("b", "div", 1, 0), ("c", "div", 1, 1),
    ]
    cells = _tree(_nodes(spark, "<table><tr><td>a<td><table><tr><td>b</table><tr><td>c<table></table></table><p>d"))
    assert [x for x in cells if x[0] in ("tr", "td", "p")] == [
        ("tr", "table", 1, 0), ("td", "tr", 2, 0), ("td", "tr", 2, 1), ("tr", "table", 4, 0), ("td", "tr", 5, 0),
        ("tr", "table", 1, 1), ("td", "tr", 2, 0), ("p", None, 0, 1),
    ]
    assert _tree(_nodes(spark, "<select><option>a<option>b</select><dl><dt>x<dd>y</dl>"))[3] == ("option", "select", 1, 1)


def test_attributes_and_strays(spark):
    rows = _nodes(spark, """</b>x<a href="1 > 0" title='<'>y</a> 3 < 4<img alt=">"/><!-- <p> --><script>"<p>"</script><I>z""")
    assert [(r.kind, r.tag, r.attrs) for r in rows if r.tag == "img"] == [("element", "img", 'alt=">"')]
    assert [r.tag for r in rows if r.tag in ("p", "script", "i")] == ["script", "i"]
    assert rows[0].text == "x" and rows[0].parent == -1


def test_null_empty_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a", "k"), (3, "a", "k")], "page_id INT, html STRING, parent STRING")
    assert [(r.page_id, r.text, r.parent, r.child) for r in node_table(table).collect()] == [(3, "a", -1, 0)] * 2
    assert node_table(table.limit(0)).count() == 0


def test_long_and_deep_page_equals_an_xml_parser(spark):
    draw = random.Random(5)

    def element(depth):
        tag, inside = draw.choice(["span", "b", "em", "section"]), ""
        for _ in range(draw.randint(0, 4) if depth < 9 else 0):
            inside += element(depth + 1) if draw.random() < 0.7 else draw.choice(["text ", "more"])
        return f"<{tag}>{inside}</{tag}>"

    page = "<main>" + "".join(element(0) for _ in range(150)) + "<i>" * 60 + "deep" + "</i>" * 60 + "</main>"
    rows = [r for r in _nodes(spark, page) if r.kind == "element"]
    assert len(rows) > 1000
    root, theirs = ElementTree.fromstring(page), []

    def walk(node, depth, parent, number):
        me = len(theirs)
        theirs.append((node.tag, depth, parent, number))
        place = 1 if node.text else 0
        for child in node:
            walk(child, depth + 1, me, place)
            place += 2 if child.tail else 1

    walk(root, 0, -1, 0)
    order = {-1: -1} | {r.idx: i for i, r in enumerate(rows)}
    assert [(r.tag, r.depth, order[r.parent], r.child) for r in rows] == theirs


def test_no_shuffle(spark):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("<p>a").alias("html"))
    text = node_table(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
