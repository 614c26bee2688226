"""Every query against its SQL, and the plans that matter at scale."""

import pytest

import __spark_entry__ as entry
from casework.operators import cases, places, posts, urls
from casework.plans.oracle import all_oracles
from casework.plans import queries as q
from compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, con, name):
    ours, theirs, more, less = compare(spark, con, SF, name)
    assert ours == theirs and not more and not less
    assert ours > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) < set(entry.queries())


# Queries that read what they have written.
WRITING = {"incremental", "incremental_posts", "offline_posts", "post_append", "sample_rand"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(name for name in entry.queries() if name not in WRITING and not name.startswith(("op", "pipeline"))))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for node in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


ROW_LOCAL = [
    "url_normalise_filter", "url_post_id", "headline", "content_text", "container_nested", "token_table", "headline_date",
    "bracket_keywords", "people_arabic", "people_numeral", "people_largest", "record_guard",
    "posts_1a", "posts_1b", "posts_2", "posts_3", "post_sibling", "post_sibling_mixed", "keyword_filter", "sample_n",
]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, SF))


def test_posts_are_cut_once(spark):
    text = plan(posts.page_posts(q._pages(spark, SF, q.deco.HTML_ALL)))
    assert text.count("Scan parquet") == 1 and text.count("Generate inline") == 1
    # Nothing heavy is copied into a filter below the generator.
    assert "Filter (size(" not in text


def test_frontier_plans(spark):
    text = plan(urls.frontier(*q._candidates_done(spark, SF)))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(urls.frontier(*q._candidates_done(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Both sides are made distinct before their only shuffle, so copies of a URL never pile up in a task.
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 2 and text.count("HashAggregate") == 4
    above_join = text[: text.index("SortMergeJoin")]
    assert "Exchange" not in above_join and "HashAggregate" not in above_join


def test_upsert_shuffles_once_after_a_partial_aggregation(spark):
    new = spark.createDataFrame([], cases.CASE_SCHEMA + ", page_id BIGINT")
    text = plan(cases.upsert(new, new, "page_id"))
    assert text.count("Exchange") == 1 and "Join" not in text and "partial_max_by" in text


def test_posts_shuffle_once_without_html(spark):
    text = plan(q.posts_all(spark, SF))
    assert text.count("Exchange") == 1 and "partial_min" in text
    exchange = text[text.index("Exchange") :].splitlines()[0]
    assert "html" not in exchange and "_page" not in exchange


@pytest.mark.parametrize("name", ["case_records", "case_upsert", "constraint_check", "incremental", "place_tags", "place_tags_join"])
def test_grams_of_names_are_not_broadcast(spark, monkeypatch, name):
    """Counts of grams are far larger than the files of names, by which they would be taken as small."""
    plans, written = [], places._written
    monkeypatch.setattr(places, "_written", lambda rows, folder: plans.append(plan(rows)) or written(rows, folder))
    entry.queries()[name](spark, SF)
    joins = [line for text in plans for line in text.splitlines() if "Join [gram" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
