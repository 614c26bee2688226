from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import cases, filters, places, posts, sampling, urls
from casework.sources.case_store import CaseStore
from casework.sources.pages import read_gazetteer, read_page_files, read_urls
from casework.sources.stores import CaseLog, append_posts, read_posts, work_dir
from casework.streaming.incremental import code_arriving, code_new_arriving, page_stream

AUTHOR = '<a href="http://weibo.com/u">'


def test_urls(spark):
    rows = spark.createDataFrame(
        [("http://site.org/post/12/x\n",), ("http://site.org/a/34_b.html",), ("http://site.org/run",), ("x/post",), (" http://blog.site.org/1 ",)],
        "url STRING",
    ).withColumn("url", urls.normalise(F.col("url")))
    got = rows.select("url", urls.post_id(F.col("url")).alias("id"), urls.of_site(F.col("url"), "site", "blog.").alias("ok")).collect()
    assert [r.url for r in got][0::2] == ["http://site.org/post/12/x", "http://site.org/run", "http://blog.site.org/1"]
    assert [r.id for r in got] == [12, 34, None, None, 1]
    assert [r.ok for r in got] == [True, True, True, False, False]


def test_frontier_and_progress(spark):
    cand = spark.createDataFrame([("a",), ("b\n",), ("b",), ("c",), ("a",), (None,)], "url STRING")
    done = spark.createDataFrame([("b",), ("b",), ("z",)], "url STRING")
    left = urls.frontier(cand, done)
    assert sorted(r.url for r in left.collect()) == ["a", "c"]
    assert urls.frontier(left, done).exceptAll(left).count() == 0
    assert left.join(done, "url").count() == 0
    assert urls.progress(cand, done).first().asDict() == {"done": 3, "remaining": 2}


def test_gazetteer_files(spark, tmp_path):
    (tmp_path / "cities.csv").write_text("北京市,x\n 上 海 市,\n大县\n朝阳区\n北京市\n市\n", encoding="utf-8")
    (tmp_path / "counties.csv").write_text("大县,1\n朝阳区,2\n", encoding="utf-8")
    got = read_gazetteer(spark, str(tmp_path / "cities.csv"), str(tmp_path / "counties.csv"))
    assert {(r.kind, r.place) for r in got.collect()} == {
        ("city", "北京"), ("city", "上海"), ("city", "大县"), ("city", "朝阳"), ("city", "市"),
        ("county", "大县"), ("county", "朝阳区"),
    }
    assert [r.place for r in places.short_names(got).collect()] == ["市"]


NAMES = [
    ("city", "a"), ("city", "ab"), ("city", "abc"), ("county", "abc"), ("county", "bcd"), ("city", "x.y"), ("county", "(z]"),
    ("city", "北京"), ("county", "北京路"), ("county", "never"), ("city", "abcdefgh"), ("county", "^$\\d"),
] + [("city", chr(0x4E00 + 7 * i) + "州") for i in range(60)]
TEXTS = ["abcd", "xxabcdefgh", "在北京路上", "x.y (z] ^$\\d", "xzy", "", None, "一州", "bcd" * 50, "x\ny", "a\u0002b"]


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "small chunks", "prepared"])
def test_places_equal_brute_force(spark, monkeypatch, way):
    rest = "".join(chr(97 + i * i % 23) for i in range(40))
    names = NAMES + [("city", "\u0002b"), ("county", "x" * 300), ("city", "x" * 31 + "y"), ("city", "𝒳𝒴z"), ("county", "q" + rest), ("county", rest), ("city", rest[9:])]
    if way == "shuffle":
        monkeypatch.setattr(places, "BROADCAST_NAMES", 0)
    if way == "small chunks":
        monkeypatch.setattr(places, "CHUNK", 3)
    gaz = spark.createDataFrame(names, "kind STRING, place STRING")
    texts = TEXTS + ["y" + "x" * 300 + "\u0002b", "x" * 299, "𝒳𝒳𝒴zab", "𝒳" * 40 + "x" * 40 + "y", "𝒴" * 5 + "abcdefgh", rest * 3, "q" + rest, "ab " * 800 + "abcdefgh" + "\n ab" * 700]
    # No URL, or one URL for two pages, takes no match away.
    pages = spark.createDataFrame([(i, [None, "u", f"u{i}"][i % 3], t) for i, t in enumerate(texts)], "i INT, url STRING, t STRING")
    if way == "prepared":
        gaz = places.prepared_names(gaz)
    tag = places.tag_places
    got = {r.i: r for r in tag(pages, gaz, F.col("t")).collect()}
    for i, text in enumerate(texts):
        hits = [(k, p) for k, p in names if p in (text or "")]
        row = got[i]
        assert row.places == sorted({p for _, p in hits})
        for kind in ("city", "county"):
            best = max(((len(p), p) for k, p in hits if k == kind), default=(0, None))[1]
            assert row[kind] == best


def test_only_names_that_are_there_are_grouped(spark):
    """Ten thousand names of one head meet a text in few places, and what goes on to the grouping is in the text."""
    names = [("city", f"county of the long northern river {i:05d} b") for i in range(10_000)] + [("city", f"north{i:05d}") for i in range(10_000)]
    gaz = spark.createDataFrame(names, "kind STRING, place STRING").repartition(4)
    text = "in the county of the long northern river 00417 b near north00099 and " * 20
    pages = spark.createDataFrame([("u", text)], "url STRING, t STRING")
    prepared = places.prepared_names(gaz)
    assert prepared.rows.count() == 20_000 and prepared.long and prepared.rows.groupBy("gram").count().agg(F.max("count")).first()[0] <= 200
    texts = pages.select(F.lit(1).alias("_digest"), F.lit(2).alias("_also"), F.col("t").alias("_text"))
    for fits in (True, False):
        rows = places._names_there(texts, replace(prepared, fits=fits)).filter("whole").collect()
        assert {r.place for r in rows} == {"north00099"} and len(rows) <= 45
    assert places.tag_places(pages, prepared, F.col("t")).first().places == ["county of the long northern river 00417 b", "north00099"]
    plan = places.tag_places(pages, prepared, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    # The characters around a gram are compared below the grouping.
    grouped = plan.index("collect_set")
    assert "around" in plan[grouped:] and "substring(around" in plan


def test_many_names_are_not_broadcast(spark):
    """Names of some ten megabytes stay in the executors; what a text is looked through with has a bounded size."""
    gaz = spark.range(120_000).select(F.lit("city").alias("kind"), F.concat(F.lit("place"), F.col("id").cast("string")).alias("place"))
    pages = spark.createDataFrame([(1, "in place77, place119999 and place120000"), (2, None)], "i INT, t STRING")
    prepared = places.prepared_names(gaz)
    assert not prepared.fits
    tagged = places.tag_places(pages, prepared, F.col("t"))
    assert {r.i: r.places for r in tagged.collect()} == {1: ["place1", "place11", "place119", "place1199", "place11999", "place119999", "place12", "place120", "place1200", "place12000", "place7", "place77"], 2: []}
    joins = [line for line in tagged._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "[key" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_grams_and_texts_are_not_broadcast_by_the_size_of_files(spark, monkeypatch, tmp_path):
    """Names and pages of a few kilobytes in files may be many grams and long texts: nothing of them goes through the driver."""
    plans, written = [], places._written
    monkeypatch.setattr(places, "_written", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or written(rows, name))
    gaz = spark.createDataFrame([("city", "x" * 40 + "y"), ("county", "northern")], "kind STRING, place STRING")
    path = str(tmp_path / "pages")
    spark.range(3).select("id", F.repeat(F.concat(F.lit("x" * 40 + "y northern"), F.col("id").cast("string")), 1000).alias("t")).write.parquet(path)
    names = places.prepared_names(gaz)
    tagged = places.tag_places(spark.read.parquet(path), names, F.col("t"))
    assert [r.places for r in tagged.collect()] == [["northern", "x" * 40 + "y"]] * 3
    plans.append(tagged._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join [gram" in line or "Join [_digest" in line and "Inner" in line]
    assert names.long and len(joins) >= 2 and all("SortMergeJoin" in line for line in joins)


def test_only_windows_that_may_be_names_become_rows(spark):
    """A text of ten thousand characters without a name makes hardly a row, and copies of a name in a text make one."""
    gaz = spark.createDataFrame([("city", "평원시"), ("city", "northern"), ("county", "x" * 20)], "kind STRING, place STRING")
    prepared = places.prepared_names(gaz)
    texts = spark.createDataFrame([(1, 1, "abcdefghij" * 1000), (2, 2, "northern 평원시 " * 500 + "x" * 20)], "_digest BIGINT, _also BIGINT, _text STRING")
    rows = places.windows.candidates(texts, "_text", prepared.wanted, places.CHUNK).collect()
    assert {(r._digest, r.around) for r in rows if r._digest == 2} >= {(2, "northern"), (2, "평원시"), (2, "x" * 20)}
    assert len(rows) <= 10


def test_a_place_without_a_name_is_ruled_out_for_many_lengths_at_once(spark, monkeypatch):
    """Names of four to seven bytes share the look-up of their beginning, and are found all the same."""
    gaz = spark.createDataFrame([("city", n) for n in ("nort", "south", "easter", "western")], "kind STRING, place STRING")
    prepared = places.prepared_names(gaz).wanted
    windows, looked = places.windows, []
    through = windows._let_through
    monkeypatch.setattr(windows, "_let_through", lambda table, key: looked.append(len(key)) or through(table, key))
    text = np.frombuffer(b"abcdefghij" * 1000 + b" nort south easter western", np.uint8)
    _, begin, size, _ = windows._windows(text, len(text), np.array([len(text)]), np.array(prepared.lengths), windows._Sums().of(text), prepared.bits.value)
    assert {text[b : b + s].tobytes() for b, s in zip(begin, size)} >= {b"nort", b"south", b"easter", b"western"}
    assert sum(looked) < 1.5 * len(text)


def test_names_in_a_text_take_along_flags_and_are_sorted_plainly(spark):
    gaz = spark.createDataFrame(
        [("city", "b place"), ("county", "b place"), ("river", "long river"), ("city", "a"), (None, "dd"), ("county", "zz")], "kind STRING, place STRING"
    )
    pages = spark.createDataFrame([(1, "zz a b place, dd long river"), (2, "long river"), (3, None)], "i INT, t STRING")
    tagged = places.tag_places(pages, gaz, F.col("t"))
    assert sorted((r.i, r.places, r.city, r.county) for r in tagged.collect()) == [
        (1, ["a", "b place", "dd", "long river", "zz"], "b place", "b place"), (2, ["long river"], None, None), (3, [], None, None),
    ]
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "collect_set" in line)
    assert "kinds" not in grouped and "sort_array(" in plan and "array_sort(" not in plan


def test_more_names_never_remove_a_match(spark):
    pages = spark.createDataFrame([("u", "ab abc bcd")], "url STRING, t STRING")
    found = set()
    for n in (3, 6, len(NAMES)):
        gaz = spark.createDataFrame(NAMES[:n], "kind STRING, place STRING")
        now = set(places.tag_places(pages, gaz, F.col("t")).first().places)
        assert found <= now
        found = now


def test_case_record(spark):
    gaz = spark.createDataFrame([("city", "平原"), ("county", "东镇")], "kind STRING, place STRING")
    pages = spark.createDataFrame(
        [
            ("u1\n", '<title>［讨薪］平原 2014年3月5日\n（工人）</title><div class="content">旧</div>'
                     '<div class="article-content entry-content">东镇 <div>三百名工人</div>聚集 &amp; 50人到场了啊啊</div>'),
            ("u2", "<p>nothing</p>"),
        ],
        "url STRING, html STRING",
    )
    got = {r.url: r for r in cases.with_sentinels(cases.case_records(pages, gaz)).collect()}
    assert got["u1"].asDict() == {
        "url": "u1", "date": "2014-03-05", "city": "平原", "county": "东镇", "headline": "［讨薪］平原 2014年3月5日 （工人）",
        "content": "东镇 三百名工人聚集 &amp; 50人到场了啊啊", "keyword1": "讨薪", "keyword2": "工人", "people": "300",
    }
    assert got["u2"].asDict() == {
        "url": "u2", "date": "None", "city": "none", "county": "none", "headline": "None", "content": "None",
        "keyword1": "none", "keyword2": "none", "people": "NA",
    }


def _case(url, headline, content, order):
    return (url, None, None, None, None, headline, content, None, None, None, order)


def _case_table(spark, rows):
    return spark.createDataFrame(rows, cases.CASE_SCHEMA + ", page_id BIGINT")


def test_upsert(spark):
    stored = _case_table(spark, [_case(u, "old", "old", 0) for u in ("a", "b", "c", "d")])
    new = _case_table(
        spark,
        [
            _case("a", "new", "x", 1), _case("b", "Service", "x", 2), _case("c", "new", None, 3),
            _case("e", "Hotspot", None, 4), _case("f", "first", None, 5), _case("f", "second", None, 6),
            _case("g", "first", "x", 7), _case("g", "second", "x", 8), _case("g", "third", None, 9), _case(None, "n", "x", 10),
        ],
    )
    merged = cases.upsert(stored, new, "page_id")
    got = {r.url: r.headline for r in merged.collect()}
    assert got == {"a": "new", "b": "old", "c": "old", "d": "old", "e": "Hotspot", "f": "first", "g": "second"}
    again = cases.upsert(merged, new, "page_id")
    assert again.exceptAll(merged).count() == 0 and merged.exceptAll(again).count() == 0


def test_case_store(spark, tmp_path, monkeypatch):
    store = CaseStore(spark, str(tmp_path / "cases"), buckets=8)
    assert store.current().count() == 0
    old = _case_table(spark, [_case(f"u{i}", "old", "old", 0) for i in range(40)])
    assert store.upsert(old, "page_id") == {"rows": 40, "without_url": 0, "buckets": 8}
    first = store.manifest()
    # Every file holds the bucket that the manifest says.
    for b, file in first.files.items():
        assert {r[0] for r in spark.read.parquet(file).select(F.pmod(F.xxhash64("url"), F.lit(8))).distinct().collect()} == {b}
    new = _case_table(
        spark,
        [
            _case("u1", "new", "x", 1), _case("u2", "Service", "x", 2), _case("u3", "new", None, 3),
            _case("e", "Hotspot", None, 4), _case("f", "first", None, 5), _case("f", "second", None, 6),
            _case("g", "first", "x", 7), _case("g", "second", "x", 8), _case("g", "third", None, 9), _case(None, "n", "x", 10),
        ],
    )
    # A writer that is lost before its manifest leaves the old table; another one may follow.
    def lost(self, manifest):
        raise OSError("lost")

    monkeypatch.setattr(CaseStore, "_commit", lost)
    with pytest.raises(OSError):
        store.upsert(new, "page_id")
    monkeypatch.undo()
    assert store.manifest() == first and store.current().count() == 40
    # So does a manifest that was not written to its end.
    (tmp_path / "cases" / "manifest" / f"{2:020d}.json").write_text('{"number": 2, "buck')
    assert store.manifest() == first

    assert store.upsert(new, "page_id") == {"rows": 10, "without_url": 1, "buckets": len({r[0] for r in new.filter("url IS NOT NULL").select(store.bucket("url")).collect()})}
    got = {r.url: r.headline for r in store.current().collect()}
    assert got == {f"u{i}": "old" for i in range(40)} | {"u1": "new", "e": "Hotspot", "f": "first", "g": "second"}
    merged = cases.upsert(old.drop("page_id"), new, "page_id")
    assert merged.exceptAll(store.current()).count() == 0 and store.current().exceptAll(merged).count() == 0
    assert [r.headline for r in store.without_url().collect()] == ["n"]
    # Buckets that the batch does not meet keep their files.
    few = _case_table(spark, [_case("u1", "newer", "x", 1)])
    before = store.manifest()
    store.upsert(few, "page_id", "s", 4)
    after = store.manifest()
    assert sum(before.files[b] != after.files[b] for b in before.files) == 1
    # A batch that is run again changes nothing; a writer with an old base fails.
    store.upsert(_case_table(spark, [_case("u1", "again", "x", 1)]), "page_id", "s", 4)
    assert store.manifest() == after
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(before)
    assert store.vacuum() >= 1 and {r.url: r.headline for r in store.current().collect()} == got | {"u1": "newer"}


def test_case_store_sorts_no_texts(spark):
    """Winners are settled on narrow rows; the texts are joined by hash."""
    new = _case_table(spark, []).withColumns({"bucket": F.lit(1), "valid": F.lit(True), "digest": F.lit(0).cast("bigint"), "row": F.lit(0).cast("bigint")})
    new = new.withColumnRenamed("page_id", "seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = CaseStore._merged(new, new.select(*cases.CASE_COLUMNS, "bucket"))
        df._jdf.queryExecution().executedPlan()
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for section in text.split("\n\n"):
        if ") Sort\n" in section or ") SortAggregate" in section:
            assert "content" not in section
    assert "SortMergeJoin" not in text


def test_constraints(spark):
    table = _case_table(spark, [_case("a", "h", "c", 1), _case("a", "h", None, 2), _case(None, "h", "c", 3), _case("b", None, "c", 4)])
    got = {r.check: r.violations for r in cases.constraint_report(table).collect()}
    assert got["duplicate_url"] == 1 and got["null_url"] == 1 and got["null_content"] == 1 and got["null_headline"] == 1
    assert got["null_date"] == 4


def test_post_constraints(spark):
    rows = [("u", None, "1a", 0, "n", "p", None), ("u", 1, "1a", 1, None, "p", None)]
    report = cases.constraint_report(spark.createDataFrame(rows, posts.POST_SCHEMA), posts.POST_REQUIRED, unique=False)
    assert {r.check: r.violations for r in report.collect()} == {
        "null_url": 0, "null_source_post_id": 1, "null_nickname": 1, "null_post": 0,
    }


def test_one_url_may_hold_a_third_of_all_rows(spark):
    n = 3000
    ids = spark.range(n).withColumn("url", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")))
    assert urls.frontier(ids, ids.filter("id % 3 = 1")).count() == 1001
    assert urls.frontier(ids, ids.filter("id % 3 = 0")).count() == 2000
    gaz = spark.createDataFrame([("city", "平原"), ("county", "东镇")], "kind STRING, place STRING")
    text = F.concat(F.when(F.col("id") % 2 == 0, "平原").otherwise("东镇"), (F.col("id") + 10).cast("string"), F.lit("人"))
    post = F.concat(F.lit('<div class="WB_info"><a>n</a></div><div class="WB_text">weibo post '), F.col("id") % 5, F.lit("</div>"))
    pages = ids.select(
        F.col("id").alias("page_id"), "url",
        F.concat(F.lit("<title>t"), "id", F.lit('</title><div class="content">'), text, F.lit("</div>"), post).alias("html"),
    )
    for names in (gaz, places.prepared_names(gaz)):
        texts = cases.page_texts(pages)
        tagged = places.tag_places(texts, names, F.col("content"))
        got = tagged.groupBy(F.col("page_id") % 2).agg(F.collect_set("places"), F.count("*")).collect()
        assert {(r[0], str(r[1]), r[2]) for r in got} == {(0, "[['平原']]", 1500), (1, "[['东镇']]", 1500)}
    coded = cases.case_records(pages, gaz, keep=("page_id",))
    merged = cases.upsert(coded.filter("page_id = 0"), coded, "page_id")
    assert merged.count() == 2001
    assert merged.filter("url = 'hot'").first().headline == "t2997"
    found = posts.all_posts(pages)
    assert found.count() == 2005 and found.filter("url = 'hot'").count() == 5


def test_log_equals_upserts_and_reruns_change_nothing(spark):
    batches = [
        [_case("a", "1", "x", 1), _case("b", "Service", "x", 2)],
        [_case("a", "2", None, 3), _case("b", "3", None, 4), _case("c", "4", None, 5)],
        [_case("b", "5", "x", 6), _case("c", "6", None, 7), _case("a", "7", "x", 8)],
    ]
    log = CaseLog(spark, work_dir(spark, "test-cases"))
    table = _case_table(spark, [])
    for number, rows in enumerate(batches):
        batch = _case_table(spark, rows)
        for _ in range(2):
            log.append(batch, number, "page_id")
        table = cases.upsert(table, batch, "page_id")
    expected = {(r.url, r.headline) for r in table.collect()}
    assert expected == {("a", "7"), ("b", "5"), ("c", "4")}
    assert {(r.url, r.headline) for r in log.current().collect()} == expected
    small = log.compact(work_dir(spark, "test-compact"))
    assert {(r.url, r.headline) for r in small.current().collect()} == expected and small.records().count() == 3
    assert small.batches() == [CaseLog.BASE] and log.batches() == [0, 1, 2]
    small.append(_case_table(spark, [_case("c", "8", "x", 1)]), 0, "page_id")
    assert {(r.url, r.headline) for r in small.current().collect()} == {("a", "7"), ("b", "5"), ("c", "8")}
    with pytest.raises(ValueError):
        log.compact(log.path)
    assert CaseLog(spark, work_dir(spark, "test-empty")).current().count() == 0


def test_stream_in_two_deliveries(spark, tmp_path):
    gaz = spark.createDataFrame([("city", "平原")], "kind STRING, place STRING")
    page = lambda n, text: f'<title>t{n}</title><div class="content">平原 {text}</div>'
    folder, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    log = CaseLog(spark, str(tmp_path / "log"))
    deliveries = [
        [[(1, "a", page(1, "30人到了"))], [(2, "b", page(2, "x"))]],
        [[(3, "a", page(3, "上千人")), (4, "c", "<title>no</title>")]],
    ]
    seen = []
    for files in deliveries:
        for rows in files:
            one = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1)
            one.write.mode("append").parquet(folder)
            seen += rows
        stream = page_stream(spark, folder, files_per_batch=1)
        code_arriving(stream, gaz, log, progress).awaitTermination()
    got = cases.with_sentinels(log.current()).orderBy("url").collect()
    assert [(r.url, r.headline, r.people, r.city) for r in got] == [
        ("a", "t3", "1000", "平原"), ("b", "t2", "NA", "平原"), ("c", "no", "NA", "none"),
    ]
    batch = cases.case_records(
        spark.createDataFrame(seen, "page_id BIGINT, url STRING, html STRING"), gaz, keep=("page_id",)
    )
    whole = cases.upsert(batch.filter("false"), batch, "page_id")
    assert whole.exceptAll(log.current()).count() == 0
    # Another checkpoint would number its batches from 0 again and replace these.
    with pytest.raises(Exception, match="later batches"):
        code_arriving(page_stream(spark, folder), gaz, log, str(tmp_path / "other")).awaitTermination()
    assert whole.exceptAll(log.current()).count() == 0


def test_stream_codes_a_url_once(spark, tmp_path, monkeypatch):
    gaz = spark.createDataFrame([("city", "平原")], "kind STRING, place STRING")
    page = lambda n, text: f'<title>t{n}</title><div class="content">平原 {text}</div>'
    store = CaseStore(spark, str(tmp_path / "cases"), buckets=4)
    batches = [[(1, "a", page(1, "30人到了")), (2, "b", page(2, "x"))], [(3, "a\n", page(3, "x")), (4, "c", page(4, "x"))], [(5, "a", page(5, "x")), (6, "c", page(6, "x")), (7, None, page(7, "x"))]]
    folder, progress, coded = str(tmp_path / "in"), str(tmp_path / "progress"), []
    upsert = CaseStore.upsert
    monkeypatch.setattr(CaseStore, "upsert", lambda self, new, *rest: coded.append(new.count()) or upsert(self, new, *rest))
    for rows in batches:
        spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1).write.mode("append").parquet(folder)
        code_new_arriving(page_stream(spark, folder, files_per_batch=1), gaz, store, progress).awaitTermination()
    assert {r.url: r.headline for r in store.current().collect()} == {"a": "t1", "b": "t2", "c": "t4"}
    assert coded == [2, 1, 0] and store.manifest().streams == {progress: 2}
    # With ``again`` valid records replace older ones, as in the batch.
    pages = spark.read.parquet(folder)
    again = CaseStore(spark, str(tmp_path / "again"), buckets=4)
    code_new_arriving(page_stream(spark, folder), gaz, again, str(tmp_path / "progress2"), again=True).awaitTermination()
    batch = cases.case_records(pages, gaz, keep=("page_id",))
    whole = cases.upsert(batch.drop("page_id").filter("false"), batch, "page_id")
    assert whole.exceptAll(again.current()).count() == 0 and again.current().count() == whole.count()


def _posts(spark, html, layouts=("1a", "1b", "2", "3"), boxed=True, **options):
    html = html if 'class="content"' in html or not boxed else f'<div class="content">{html}</div>'
    pages = spark.createDataFrame([("http://x.org/post/7/a", "weibo" + html)], "url STRING, html STRING")
    rows = posts.page_posts(pages, layouts, **options).orderBy("layout", "post_seq").collect()
    assert all(r.source_post_id == 7 for r in rows)
    return [(r.nickname, r.post, r.images) for r in rows]


def _info(name, cls=' class="WB_name S_func1"'):
    return f'<div class="WB_info"><a{cls}>{name}</a></div>'


def test_layout_1a(spark):
    got = _posts(
        spark,
        '<div class="content">' + _info("user_1")
        + '<div class="WB_text">a <b>no</b><span>span </span><div class="msgCnt">cnt<img src="m.png"></div><a>no<img src="n.png"></a></div>'
        + f'<div class="WB_text"> own{_info("user_2")}</div><div class="WB_text">second &amp; last<img src="2.png"></div></div>',
        ("1a",),
    )
    assert got == [("user_1", "a span cnt own", ["m.png"]), ("user_2", "second & last", ["2.png"])]


@pytest.mark.parametrize(
    "head",
    [
        _info("first"), _info("first", ""), '<div class="WB_info"></div><div class="WB_text"><a>first</a></div>',
        '<div class="WB_info"><div class="userName"><i> first </i></div></div>',
        '<div class="WB_info"><a> </a></div><p><a class="WB_name S_func1">first</a></p>',
    ],
)
def test_first_name_of_a_page(spark, head):
    assert _posts(spark, head + '<div class="WB_text">a text that stays</div>', ("1a",)) == [("first", "a text that stays", None)]


def test_noise_in_1a(spark):
    texts = ["12345678@", "123456789@", "short weibo.com", "a" * 18 + "weibo.com", "a" * 19 + "weibo.com", "good"]
    html = _info("u0") + "".join(f'<div class="WB_text">{t}{_info(f"u{i + 1}")}</div>' for i, t in enumerate(texts))
    assert [p for _, p, _ in _posts(spark, html, ("1a",))] == ["123456789@", "a" * 19 + "weibo.com", "good"]


def test_layout_1b(spark):
    info = lambda inner: f'<div class="WB_info">{inner}</div>'
    html = "".join(
        info(i)
        for i in (
            "zero", "one", f"{AUTHOR}user_1</a> says<span> so</span>", "more", '<img src="q.png">no',
            '<a href="http://weibo.com/qq.com">q</a>ignored', f"{AUTHOR}user_2</a>", "two @x", f"{AUTHOR}user_3</a>", "three",
        )
    )
    assert _posts(spark, html, ("1b",)) == [("user_1", "says somore", ["q.png"]), ("user_3", "three", None)]
    assert [n for n, _, _ in _posts(spark, html, ("1b",), filter_1b=False)] == ["user_1", "user_2", "user_3"]
    assert _posts(spark, html + '<div class="WB_text">t</div>' * 20, ("1b",)) == []


def test_layout_2(spark):
    name = lambda n: f'<p><a class="con_name_txt S_txt1" href="u">{n}</a>x</p>'
    html = f"<p>lost{name('u1')}<p>one <b>bold</b></p><p>i<img src='1.png'></p>{name('u2')}{name('u3')}<p>three<p>more"
    assert _posts(spark, html, ("2",)) == [("u1", "one bold", ["1.png"]), ("u3", "threemore", None)]


def test_layout_3(spark):
    box = '<div class="content"><script>1</script><p>' + AUTHOR + 'no</a></p><p>scripted</p></div><div class="content">'
    link = lambda text, rest="": f"<p>{AUTHOR}{text}</a>{rest}</p>"
    html = box + "".join(
        [
            "<p>before</p>", link("user_1", "lost"), "<p>one <em>em</em> <i>no</i><span>span</span></p>", "<p><img src='1.png'>t</p>",
            '<p><a href="http://weibo.com/qq.com">q</a>skipped</p>', "<p>goes on</p>",
            '<p><a href="http://else.org">l</a></p>', "<p>stopped</p>",
            link("user_2"), "<p>@a @b</p>", link("user_3"), "<p>real words</p>",
            link("site.com"), "<p>dropped</p>",
            link("<span>user_4</span>"), link("user_5", "own words"), "<p>tail</p>",
            link("user_6"), link("user_7", "@m"), link("user_8"), "<p>at last</p>",
        ]
    ) + "</div>"
    assert _posts(spark, html, ("3",)) == [
        ("user_1", "one em span t goes on", ["1.png"]),
        ("user_2", "@a @b user_3 real words", None),
        ("user_4", "own words tail", None),
        ("user_6", "@m user_8 at last", None),
    ]


def test_links_inside_other_children_are_no_author_links(spark):
    wrapped = f'<b>{AUTHOR}n2</a></b> more words'
    html = f'<div class="content"><p>{AUTHOR}n1</a></p><p>first words</p><p>{wrapped}</p></div>'
    assert _posts(spark, html, ("3",)) == [("n1", "first words more words", None)]
    html = f'<div class="WB_info">0</div><div class="WB_info">1</div><div class="WB_info">{AUTHOR}n1</a> says</div><div class="WB_info"><b>{AUTHOR}n2</a></b>and more</div>'
    assert _posts(spark, html, ("1b",)) == [("n1", "saysand more", None)]
    name = '<a class="con_name_txt S_txt1" href="u">{}</a>'
    html = f"<p>{name.format('n1')}</p><p>one</p><p><i>{name.format('n2')}</i> two</p>"
    assert _posts(spark, html, ("2",)) == [("n1", "onen2 two", None)]
    html = '<div class="WB_info"><b><a class="WB_name S_func1">no</a></b><a>yes</a></div><div class="WB_text">a text that stays</div>'
    assert _posts(spark, html, ("1a",)) == [("yes", "a text that stays", None)]


def test_no_posts_without_a_container(spark):
    html = _info("user_1") + '<div class="WB_text">a text that stays</div>'
    assert _posts(spark, html, ("1a",)) and not _posts(spark, html, ("1a",), boxed=False)
    name = '<p><a class="con_name_txt S_txt1" href="u">n</a></p><p>words</p>'
    assert _posts(spark, name, ("2",)) and not _posts(spark, name, ("2",), boxed=False)


def test_union_keeps_each_post_once(spark):
    rows = [("u", 1, "3", 1, "n", "p", ["b"]), ("u", 1, "1a", 2, "n", "p", None), ("u", 1, "1a", 3, "n", "q", None)]
    table = spark.createDataFrame(rows, posts.POST_SCHEMA)
    got = sorted((r.post, r.layout, r.post_seq) for r in posts.distinct_posts(table.unionByName(table)).collect())
    assert got == [("p", "1a", 2), ("q", "1a", 3)]


def test_sibling_posts(spark):
    block = '<div class="content">{}</div>'
    pages = [
        ("1", '<div class="WB_info"><a class="WB_name S_func1"> n1 </a></div> <div class="WB_text">t &amp; <b>1</b></div>'),
        ("2", '<div class="WB_info"><a class="WB_name">n2</a></div><br><p>no</p>'),
        ("3", '<p>weibo <a>n3</a></p>\n<p><span> a </span>x<span>b</span></p>'),
        ("4", '<div class="WB_info"><a class="WB_name">n4</a></div>x<div class="WB_text">one</div><div class="WB_text"><i class="S_func1">WB_name</i></div>'),
        ("5", "<p>nothing</p>"),
    ]
    table = spark.createDataFrame([(f"http://x/{u}_a", block.format(h)) for u, h in pages], "url STRING, html STRING")
    got = {r.source_post_id: (r.nickname, r.post) for r in posts.sibling_posts(table).collect()}
    assert got == {1: ("n1", "t & 1"), 2: ("n2", None), 3: ("n3", "ab"), 4: ("WB_name", "one"), 5: (None, None)}
    plain = {r.source_post_id: r.nickname for r in posts.sibling_posts(table, mixed=False).collect()}
    assert plain[3] is None


def test_posts_are_stored_without_names(spark, tmp_path):
    table = spark.createDataFrame([("u", 1, "1a", 0, "user_1", "hello @user_2: x", None)], posts.POST_SCHEMA)
    path = str(tmp_path / "posts")
    with pytest.raises(ValueError):
        append_posts(table, path, 0)
    assert read_posts(spark, path).count() == 0
    for batch in (0, 1, 1):
        assert append_posts(table, path, batch, key="k") == 1
    rows = read_posts(spark, path).collect()
    assert len(rows) == 2 and {r.post for r in rows} == {"hello @_: x"}
    assert len(rows[0].nickname) == 64 and rows[0].nickname == rows[1].nickname
    raw = str(tmp_path / "raw")
    assert append_posts(table, raw, 0, raw=True) == 1
    assert read_urls(spark, raw).columns == ["url"]


def test_slice(spark):
    table = spark.range(0, 300).withColumn("text", F.lit("x"))
    assert sorted(r.id for r in filters.slice_rows(table, "id").collect()) == list(range(12, 100))
    assert filters.slice_rows(table, "id", 290, 400).count() == 10
    # Keys that repeat, also over both ends, and no key.
    rows = spark.range(0, 90).select(F.when(F.col("id") < 80, (F.col("id") / 7).cast("int")).alias("k"), (F.col("id") % 2).alias("v"))
    order = sorted((-1 if r.k is None else r.k) for r in rows.collect())
    for start, stop in ((0, 10), (3, 40), (12, 12), (85, 200)):
        got = sorted((-1 if r.k is None else r.k) for r in filters.slice_rows(rows, "k", start, stop).collect())
        assert got == order[start:stop]


@pytest.mark.parametrize("n", [0, 1, 10, 999, 1000, 5000])
def test_sample_is_exact_and_repeatable(spark, n):
    table = spark.range(1000).withColumn("text", F.lit("x"))
    got = {r.id for r in sampling.sample_n(table, n, "id", 3).collect()}
    assert len(got) == min(n, 1000)
    assert got == {r.id for r in sampling.sample_n(table.repartition(7), n, "id", 3).collect()}
    assert sampling.sample_rows(table, n, 3).distinct().count() == min(n, 1000)


def test_sample_arguments(spark):
    spark.range(5).createOrReplaceTempView("some_table1")
    assert sampling.sample_table(spark, "some_table1", 3).count() == 3
    for bad in ("a; drop", "a.b", "", 5, None, "é"):
        with pytest.raises(ValueError):
            sampling.check_table(bad)
    for bad in (1.5, "3", True, -1):
        with pytest.raises(ValueError):
            sampling.sample_rows(spark.range(5), bad)


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>é</title>", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no", encoding="utf-8")
    (tmp_path / "c.html").write_bytes(b"x\xff")
    rows = read_page_files(spark, str(tmp_path)).orderBy("url").collect()
    assert [r.html for r in rows] == ["<title>é</title>", "x\ufffd"] and rows[0].url.endswith("/a.html")
    (tmp_path / "d.htm").write_bytes("é".encode("latin-1"))
    assert read_page_files(spark, str(tmp_path), "ISO-8859-1", "*.htm").first().html == "é"
