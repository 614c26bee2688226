"""Ids and quarantine, places from the end, stored candidates of a sample, encodings."""

import pytest
from pyspark.sql import functions as F

from casework.operators import filters, ranks, sampling
from casework.sources.encodings import SETTINGS, read_encoded_pages, with_text
from casework.sources.guarded import GuardedTable

SCHEMA = "n BIGINT, url STRING, headline STRING, reasons STRING"


def _guarded(spark, path, batches):
    table = GuardedTable(spark, path, ("url", "headline"))
    counts = [table.insert(spark.createDataFrame(rows, SCHEMA).drop("reasons"), i, "n") for i, rows in enumerate(batches)]
    return table, counts


def test_ids_have_no_gaps_and_bad_rows_are_set_aside(spark, tmp_path):
    first = [(5, "b", "h", ""), (1, None, "h", ""), (2, "a", None, ""), (3, "a", "h", ""), (4, "a", "h", ""), (9, None, None, "")]
    second = [(1, "b", "h", ""), (2, "c", "h", ""), (3, "c", "h", ""), (4, "d", "h", "")]
    table, counts = _guarded(spark, str(tmp_path / "t"), [first, second, []])
    assert counts[0] == {"accepted": 2, "quarantined": 4, "null_url": 2, "null_headline": 2, "duplicate": 1, "stored": 0}
    assert counts[1] == {"accepted": 2, "quarantined": 2, "null_url": 0, "null_headline": 0, "duplicate": 1, "stored": 1}
    assert counts[2]["accepted"] == counts[2]["quarantined"] == 0
    rows = sorted((r.id, r.batch, r.n, r.url) for r in table.rows().collect())
    assert rows == [(1, 0, 3, "a"), (2, 0, 5, "b"), (3, 1, 2, "c"), (4, 1, 4, "d")]
    bad = sorted((r.batch, r.n, tuple(r.reasons)) for r in table.quarantine().collect())
    assert bad == [
        (0, 1, ("null_url",)), (0, 2, ("null_headline",)), (0, 4, ("duplicate",)), (0, 9, ("null_url", "null_headline")),
        (1, 1, ("stored",)), (1, 3, ("duplicate",)),
    ]
    with pytest.raises(ValueError):
        table.insert(spark.createDataFrame(second, SCHEMA), 1, "n")


def test_last_batch_again_gives_the_same_ids(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"u{i}", "h", "") for i in range(600)]
    table, counts = _guarded(spark, str(tmp_path / "t"), [rows, rows[:9] + [(700, "new", "h", "")]])
    assert counts[0]["accepted"] == 401 and counts[1]["accepted"] == 1
    before = sorted((r.id, r.url) for r in table.rows().collect())
    assert [i for i, _ in before] == list(range(1, 403))
    table.insert(spark.createDataFrame(rows[:9] + [(700, "new", "h", "")], SCHEMA).drop("reasons"), 1, "n")
    assert sorted((r.id, r.url) for r in table.rows().collect()) == before


def test_places_from_either_end(spark):
    rows = spark.range(0, 90).select(F.when(F.col("id") < 80, (F.col("id") / 7).cast("int")).alias("k"), (F.col("id") % 2).alias("v"))
    order = sorted((-1 if r.k is None else r.k) for r in rows.collect())
    for start, stop in ((-5, None), (-100, None), (-20, -3), (0, -80), (3, None), (70, 20_000), (-3, -3)):
        got = sorted((-1 if r.k is None else r.k) for r in filters.slice_rows(rows, "k", start, stop).collect())
        assert got == order[start:stop], (start, stop)
    assert filters.slice_rows(rows.limit(0), "k", -5, None).count() == 0
    with pytest.raises(ValueError):
        filters.slice_rows(rows, "k", 5, 4)


def test_no_task_orders_all_keys(spark):
    table = spark.range(0, 5000, numPartitions=4)
    placed = ranks.ahead(table.repartition(3), "id")
    assert [r._ahead for r in placed.orderBy("_key").collect()] == list(range(5000))
    text = ranks.ahead(table, "id", 4900, 5000)._jdf.queryExecution().executedPlan().toString()
    # Only the sums of the ranges meet in one partition.
    alone = text[text.index("Exchange SinglePartition") :]
    assert "_range" in alone and "_key" not in alone[: alone.index("HashAggregate")]


def test_sample_stores_only_candidates(spark, tmp_path, monkeypatch):
    table = spark.range(0, 20_000, numPartitions=5).withColumn("text", F.lit("x"))
    sizes, number = [], iter(range(100))
    monkeypatch.setattr(sampling, "work_dir", lambda *_: str(tmp_path / f"draw{next(number)}"))
    for seed in range(4):
        got = sampling.sample_rows(table, 100, seed)
        assert got.distinct().count() == 100 and got.columns == table.columns
    for folder in tmp_path.glob("draw*"):
        sizes.append(spark.read.parquet(str(folder)).count())
    assert len(sizes) >= 4 and sorted(sizes)[3] <= sampling.most_stored(100)
    picks = [sorted(r.id for r in sampling.sample_rows(table, 30, s).collect()) for s in (1, 1, 2)]
    assert picks[0] == picks[1] != picks[2]


def test_each_file_by_its_own_encoding(spark, tmp_path):
    page = '<meta {}charset="{}"><title>{}</title>'
    files = {
        "gbk": (page.format("", "gb2312", "三百人"), "gbk"), "big5": (page.format("", "Big5", "遊行"), "big5"),
        "latin": (page.format("http-equiv=x content='text/html; ", "ISO-8859-1", "año “x”"), "cp1252"),
        "plain": ("<title>é</title>", "utf-8"), "marked": ("\ufeff<title>é三</title>", "utf-16-le"), "bom": ("\ufeff三", "utf-8"),
        "kr": (page.format("", "euc-kr", "집회"), "euc-kr"), "empty": ("", "utf-8"),
    }
    for name, (text, encoding) in files.items():
        (tmp_path / f"{name}.html").write_bytes(text.encode(encoding))
    (tmp_path / "broken.html").write_bytes(b"<title>x\xff</title>")
    (tmp_path / "unknown.html").write_bytes(b'<meta charset="x-none">x')
    (tmp_path / "half.html").write_bytes('<meta charset="gbk">三'.encode("gbk")[:-1])
    before = [spark.conf.get(name) for name in SETTINGS]
    pages, aside = read_encoded_pages(spark, str(tmp_path))
    assert [spark.conf.get(name) for name in SETTINGS] == before
    got = {r.url.split("/")[-1][:-5]: r.html for r in pages.collect()}
    assert got == {name: text.replace("\ufeff", "") for name, (text, _) in files.items() if text}
    assert sorted(r.url.split("/")[-1] for r in aside.collect()) == ["broken.html", "half.html", "unknown.html"]


def test_bytes_of_a_table(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray("é".encode("latin-1")))], "i INT, content BINARY")
    assert [r.html for r in with_text(rows).orderBy("i").collect()] == [None, None]
    assert [(r.charset, r.html) for r in with_text(rows, default="windows-1252").orderBy("i").collect()] == [(None, None), ("windows-1252", "é")]
