"""Posts stored in several batches are read once."""

from casework.operators import posts
from casework.plans import queries
from casework.sources.stores import append_posts, current_posts, read_posts
from casework.streaming.incremental import page_stream

ROWS = [
    ("u", 1, "3", 1, "n", "p", ["b"]), ("u", 1, "1a", 2, "n", "p", None), ("u", 1, "1a", 3, "n", "q", None),
    ("v", 1, "2", 1, "n", "p", ["c"]), (None, None, "2", 1, "n", "p", None),
    # Alike only when the account names are masked.
    ("w", 1, "2", 1, "n", "@a hello", None), ("w", 1, "2", 2, "n", "@b hello", None),
]


def _table(spark, rows):
    return spark.createDataFrame(rows, posts.POST_SCHEMA)


def _read(rows):
    return sorted((str(r.url), r.post, r.layout, r.post_seq, r.batch) for r in rows.collect())


def test_first_batch_and_layout_win(spark, tmp_path):
    path = str(tmp_path / "posts")
    assert current_posts(spark, path).count() == 0
    again = [("u", 1, "1a", 0, "n", "p", None), ("x", 1, "1a", 0, "n", "new", None)]
    append_posts(_table(spark, ROWS + ROWS), path, 3, key="k")
    append_posts(_table(spark, again + ROWS * 5), path, 4, key="k")
    got = current_posts(spark, path)
    assert got.columns == read_posts(spark, path).columns
    rows = _read(got)
    assert rows == [
        ("None", "p", "2", 1, 3), ("u", "p", "1a", 2, 3), ("u", "q", "1a", 3, 3), ("v", "p", "2", 1, 3),
        ("w", "@_ hello", "2", 1, 3), ("w", "@_ hello", "2", 2, 3), ("x", "new", "1a", 0, 4),
    ]
    # A batch that is run again replaces itself.
    append_posts(_table(spark, ROWS), path, 3, key="k")
    assert _read(current_posts(spark, path)) == rows


def test_empty_batch_and_rows_without_a_digest(spark, tmp_path):
    path = str(tmp_path / "posts")
    append_posts(_table(spark, []), path, 0, raw=True)
    assert current_posts(spark, path).count() == 0
    for batch in (1, 2):
        _table(spark, ROWS).write.parquet(f"{path}/batch={batch}")
    assert _read(current_posts(spark, path)) == _read(posts.distinct_posts(_table(spark, ROWS)).selectExpr("*", "1 AS batch"))


def test_copies_are_found_on_narrow_rows_without_a_sort(spark, tmp_path):
    path = str(tmp_path / "posts")
    append_posts(_table(spark, ROWS * 2), path, 0, raw=True)
    text = current_posts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert not any("post#" in line or "images#" in line for line in text.splitlines() if "Aggregate" in line)


def test_a_post_may_hold_a_third_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "posts")
    hot = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('u', id)) AS url", "1L AS source_post_id", "'2' AS layout", "CAST(id % 5 AS INT) AS post_seq",
        "'n' AS nickname", "'p' AS post", "CAST(NULL AS ARRAY<STRING>) AS images",
    )
    append_posts(hot, path, 0, raw=True)
    rows = current_posts(spark, path)
    assert rows.count() == 2001 and rows.filter("url = 'hot'").first().post_seq == 0


def test_arriving_posts_lie_in_several_files_a_batch(spark, monkeypatch):
    """All cores write and cut a batch, however large it is."""
    found = []

    def stream(spark, path, files_per_batch):
        found.append((len(spark.read.parquet(path).inputFiles()), files_per_batch))
        return page_stream(spark, path, files_per_batch=files_per_batch)

    monkeypatch.setattr(queries, "page_stream", stream)
    queries.incremental_posts(spark, "/root/testdata/sf0.01")
    ((files, in_batch),) = found
    assert in_batch >= queries.FILES and in_batch < files <= 2 * in_batch
