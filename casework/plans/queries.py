"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.functions import coding
from casework.operators import cases, elements, filters, places, posts, sampling, tokens, urls
from casework.plans import decorated as deco
from casework.sources.case_store import CaseStore
from casework.sources.encodings import all_charsets, with_text
from casework.sources.guarded import GuardedTable
from casework.sources.pages import read_table, read_urls
from casework.sources.stores import HANDLE_KEY, append_posts, current_posts, read_posts, work_dir
from casework.streaming.incremental import code_new_arriving, page_stream, store_arriving_posts

SITE, EXCLUDED = "example", "blog."
SAMPLE_SIZE, SEED = 100, 7
# Page files that arrive together.
FILES = 8
# Invented names in invented posts; real ones need a secret key.
DEMO_KEY = "demo"
# URL with a line break on every third page.
URL_BROKEN = "url || CASE WHEN page_id % 3 = 0 THEN chr(10) ELSE '' END"
# Gazetteer entries: all words of all texts of a table, with suffixes and blanks for the cleaning.
WORD_KIND = "CASE WHEN length(word) % 2 = 0 THEN 'city' ELSE 'county' END"
WORD_RAW = (
    "CASE WHEN length(word) % 5 = 0 THEN substr(word, 1, 1) || ' ' || substr(word, 2) ELSE word END "
    "|| CASE length(word) % 4 WHEN 0 THEN '市' WHEN 1 THEN '县' WHEN 2 THEN '区' ELSE '' END"
)
WORD_PLACE = "word"
# Posts: the pieces of each text between marks, some with a mention or a link.
NOISY_TEXT = "piece || CASE (turn + length(piece)) % 3 WHEN 0 THEN '@x' WHEN 1 THEN 'weibo.com' ELSE '' END"
NESTED_HTML = deco.swap(
    "html",
    ("<p><b>", "'</div><div class=\"deep\"><div>'"),
    ("<br>", "'</div>'"),
    ("<p>", "'</div><div class=\"x\">'"),
    ("</p>", "''"),
    ("<article>", "'<div class=\"wide content\"><div>'"),
    ("</article>", "'</div></div>after'"),
)
# End tags that are left out, attribute values with a bracket, and end tags that fit no element.
TREE_HTML = deco.swap(
    "html",
    ("</li>", "CASE WHEN page_id % 2 = 0 THEN '' ELSE '</li>' END"),
    ("</p>", "CASE WHEN page_id % 3 = 0 THEN '' ELSE '</p></em>' END"),
    ("<article>", "'<div title=\"a > b\"><table><tr><td>one<td>two<p>three<tr><th>four</table><article>'"),
)
# Pages that name the encoding in which they are going to be stored.
NAMED_HTML = deco.swap("html", ("utf-8", "CASE page_id % 4 WHEN 0 THEN 'gb2312' WHEN 1 THEN 'Latin1' ELSE 'utf-8' END"))

POST_TYPES = [field.strip().split(" ") for field in posts.POST_SCHEMA.split(",")]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str, html: str = "html", url: str = "url") -> DataFrame:
    return deco.pages_with(table(spark, sf_dir, "pages"), html, url)


def _gazetteer(spark: SparkSession, sf_dir: str, name: str = WORD_PLACE, of: str = "documents") -> DataFrame:
    words = table(spark, sf_dir, of).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return places.clean_gazetteer(words.select(F.expr(WORD_KIND).alias("kind"), F.expr(name).alias("name")))


def url_normalise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir, url=URL_BROKEN).select("page_id", urls.normalise(F.col("url")).alias("url"))
    return rows.filter(urls.of_site(F.col("url"), SITE, EXCLUDED))


def url_post_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir, url=deco.POST_URL)
    return rows.select("page_id", F.coalesce(urls.post_id(F.col("url")), F.lit(-1)).alias("post_id"))


def _candidates_done(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, sf_dir, url=URL_BROKEN)
    return pages.select("url"), pages.filter(F.col("page_id") % 2 == 0).select("url")


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.frontier(*_candidates_done(spark, sf_dir))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.progress(*_candidates_done(spark, sf_dir))


def gazetteer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gazetteer(spark, sf_dir, WORD_RAW)


def gazetteer_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.short_names(_gazetteer(spark, sf_dir))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", cases.headline(html).alias("headline"), cases.headline(html, unescape=True).alias("plain_headline")
    )


def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cases.page_texts(_pages(spark, sf_dir, deco.CASE_HTML))
    return texts.select("page_id", F.coalesce("content", F.lit("None")).alias("content"))


def container_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.page_texts(_pages(spark, sf_dir, NESTED_HTML), ("content",)).select("page_id", "content")


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_pages(spark, sf_dir, NESTED_HTML)).select(
        "page_id", "idx", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tag", "attrs", "text")], "div_depth"
    )


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.node_table(_pages(spark, sf_dir, TREE_HTML))
    return found.select(
        "page_id", "idx", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tag", "attrs", "text")], "parent", "depth", "child"
    )


def page_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes, each in an encoding that it names or marks; every seventh is cut off or names a wrong one."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(NAMED_HTML).alias("text"))
    with all_charsets(spark):
        way = F.col("page_id") % 4
        marked = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
        content = (
            F.when(way == 0, F.encode("text", "GB18030")).when(way == 1, F.encode("text", "windows-1252"))
            .when(way == 2, marked).otherwise(F.encode("text", "UTF-8"))
        )
        # The first byte of a character and no other.
        broken = F.when((F.col("page_id") % 7 == 0) & (way != 1), F.concat(content, F.unhex(F.lit("C3")))).otherwise(content)
        rows = pages.select("page_id", broken.alias("content"))
    read = with_text(rows)
    return read.select("page_id", "charset", F.coalesce("html", F.lit("none")).alias("html"))


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, deco.CASE_HTML).select("page_id", cases.headline(F.col("html")).alias("headline"))


def headline_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.col("headline")
    return _headlines(spark, sf_dir).select(
        "page_id",
        F.coalesce(coding.headline_date(head).cast("string"), F.lit("none")).alias("date"),
        F.coalesce(coding.headline_date_raw(head), F.lit("none")).alias("date_raw"),
    )


def bracket_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.col("headline")
    return _headlines(spark, sf_dir).select(
        "page_id",
        F.coalesce(coding.keyword1(head), F.lit("none")).alias("keyword1"),
        F.coalesce(coding.keyword2(head), F.lit("none")).alias("keyword2"),
    )


def _place_row(tagged: DataFrame) -> DataFrame:
    return tagged.select(
        "page_id",
        F.array_join("places", "|").alias("places"),
        F.coalesce("city", F.lit("none")).alias("city"),
        F.coalesce("county", F.lit("none")).alias("county"),
    )


def _case_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return cases.page_texts(_pages(spark, sf_dir, deco.CASE_HTML)), F.concat_ws("\n", "headline", "content")


def place_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer that grows with the data: every word of every document."""
    texts, text = _case_texts(spark, sf_dir)
    return _place_row(places.tag_places(texts, _gazetteer(spark, sf_dir), text))


def place_tags_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with names that were prepared before."""
    texts, text = _case_texts(spark, sf_dir)
    return _place_row(places.tag_places(texts, places.prepared_names(_gazetteer(spark, sf_dir)), text))


def place_tags_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small list of places: the words of the benchmark."""
    texts, text = _case_texts(spark, sf_dir)
    return _place_row(places.tag_places(texts, _gazetteer(spark, sf_dir, of="benchmark"), text))


def _counts(spark: SparkSession, sf_dir: str, **values) -> DataFrame:
    texts = cases.page_texts(_pages(spark, sf_dir, deco.CASE_HTML))
    return texts.select("page_id", *[F.coalesce(v(F.col("content")), F.lit(-1)).alias(k) for k, v in values.items()])


def people_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(
        spark, sf_dir, people=coding.people_arabic, people_compat=lambda t: coding.people_arabic(t, compat=True)
    )


def people_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, people=coding.people_numeral)


def people_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, people=coding.people)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, deco.CASE_HTML)
    return cases.case_records(pages, _gazetteer(spark, sf_dir), keep=("page_id",))


def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.with_sentinels(_cases(spark, sf_dir))


def case_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _cases(spark, sf_dir)
    # The stored table: every other page with an earlier, poorer record.
    pages = table(spark, sf_dir, "pages").filter(F.col("page_id") % 2 == 1)
    filled = {"url": F.col("url"), "headline": F.lit("stored"), "content": F.md5("url")}
    types = {f.name: f.dataType for f in new.schema}
    stored = pages.select(
        *[filled.get(c, F.lit(None)).cast(types[c]).alias(c) for c in cases.CASE_COLUMNS]
    )
    store = CaseStore(spark, work_dir(spark, "cases"))
    store.upsert(stored.withColumn("page_id", F.lit(0)), "page_id")
    store.upsert(new, "page_id")
    return cases.with_sentinels(store.current())


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every tenth URL twice, so that there is something to find.
    copies = F.sequence(F.lit(1), F.when(F.col("page_id") % 10 == 0, 2).otherwise(1))
    rows = _cases(spark, sf_dir).withColumn("copy", F.explode(copies))
    return cases.constraint_report(rows.drop("page_id", "copy"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    return docs.filter(filters.mentions_keyword(text, "THE", ignore_case=True)).select(
        "doc_id", filters.mentions_keyword(text, "The").alias("exact")
    )


def keyword_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(filters.mentions_keyword(F.col("text"), "the", ignore_case=True))
    return filters.slice_rows(docs, "doc_id", 12, 100).select("doc_id", "text")


def slice_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred in the order of the text, whose copies share a key."""
    return filters.slice_rows(table(spark, sf_dir, "documents").select("text"), "text", -100, None)


def guarded_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into a table with ids and constraints; every tenth page twice, every fourth again in the second."""
    texts = cases.page_texts(_pages(spark, sf_dir, deco.CASE_HTML, deco.POST_URL))
    copies = F.sequence(F.lit(0), F.when(F.col("page_id") % 10 == 0, 1).otherwise(0))
    rows = texts.withColumn("copy", F.explode(copies)).withColumn("place", F.col("page_id") * 2 + F.col("copy"))
    guarded = GuardedTable(spark, work_dir(spark, "guarded"), ("url", "headline", "content"))
    for batch, some in enumerate((F.col("page_id") % 2 == 0, (F.col("page_id") % 2 == 1) | (F.col("page_id") % 4 == 0))):
        guarded.insert(rows.filter(some).select("place", "url", "headline", "content"), batch, "place")
    kept = guarded.rows().select("batch", "id", "place", "url", F.lit("").alias("reasons"))
    out = guarded.quarantine().select("batch", F.lit(0).cast("bigint").alias("id"), "place", "url", F.array_join("reasons", ",").alias("reasons"))
    return kept.unionByName(out).withColumn("batch", F.col("batch").cast("int"))


def record_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cases.page_texts(_pages(spark, sf_dir, deco.CASE_HTML))
    return texts.filter(filters.valid_record(F.col("headline"), F.col("content"))).select("page_id")


def _post_rows(found: DataFrame) -> DataFrame:
    return found.withColumn("source_post_id", F.coalesce("source_post_id", F.lit(-1).cast("bigint"))).withColumn(
        "images", F.coalesce(F.array_join("images", ","), F.lit(""))
    )


def _layout(html: str, layout: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _pages(spark, sf_dir, html, deco.POST_URL_UNIQUE)
        return _post_rows(posts.page_posts(pages, (layout,)))

    return query


def posts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _post_rows(posts.all_posts(_pages(spark, sf_dir, deco.HTML_ALL, deco.POST_URL_UNIQUE)))


def post_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored posts: account names hashed, mentions masked."""
    path = work_dir(spark, "posts")
    found = posts.all_posts(_pages(spark, sf_dir, deco.HTML_ALL, deco.POST_URL_UNIQUE))
    append_posts(found, path, 0, key=spark.conf.get(HANDLE_KEY, DEMO_KEY))
    return _post_rows(read_posts(spark, path).drop("batch"))


def post_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two batches, as found by every layout; a third of the pages is in both."""
    path = work_dir(spark, "posts")
    pages = _pages(spark, sf_dir, deco.HTML_ALL, deco.POST_URL_UNIQUE)
    for number, some in enumerate((pages.filter(F.col("page_id") % 3 == 0), pages)):
        append_posts(posts.page_posts(some), path, number, spark.conf.get(HANDLE_KEY, DEMO_KEY))
    return _post_rows(current_posts(spark, path))


def _sibling(mixed: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _pages(spark, sf_dir, deco.HTML_SIBLING, deco.POST_URL_UNIQUE)
        found = posts.sibling_posts(pages, mixed)
        return found.select(
            "url",
            F.coalesce("source_post_id", F.lit(-1).cast("bigint")).alias("source_post_id"),
            F.coalesce("nickname", F.lit("none")).alias("nickname"),
            F.coalesce("post", F.lit("none")).alias("post"),
        )

    return query


def post_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pieces = turns.select("conv_id", "turn", F.posexplode(F.split("text", "[.,\n]")).alias("place", "piece"))
    rows = pieces.select("conv_id", "turn", "place", F.expr(NOISY_TEXT).alias("post"))
    return rows.filter(filters.worth_keeping(F.col("post")))


def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(table(spark, sf_dir, "documents"), SAMPLE_SIZE, "doc_id", SEED)


def sample_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be said of a random sample: its size, and that its rows are different rows of the table."""
    docs = table(spark, sf_dir, "documents")
    drawn = sampling.sample_rows(docs, SAMPLE_SIZE, SEED)
    found = drawn.join(docs.select(*[F.col(c).alias(f"of_{c}") for c in docs.columns]), F.col("doc_id") == F.col("of_doc_id"))
    whole = F.count_if(F.forall(F.array(*[F.col(c).cast("string").eqNullSafe(F.col(f"of_{c}").cast("string")) for c in docs.columns]), lambda x: x))
    return found.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), whole.alias("whole_rows"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive in three batches, some of them in each; a URL is coded once."""
    path = work_dir(spark, "arriving")
    pages = _pages(spark, sf_dir, deco.CASE_HTML, "url")
    for batch in range(3):
        # A batch of several files is coded by several tasks.
        some = pages.filter((F.col("page_id") % 5 == 0) | (F.col("page_id") % 3 == batch))
        some.repartition(FILES).write.mode("append").parquet(path)
    store = CaseStore(spark, work_dir(spark, "cases"))
    code_new_arriving(page_stream(spark, path, files_per_batch=FILES), _gazetteer(spark, sf_dir), store, work_dir(spark, "progress")).awaitTermination()
    return cases.with_sentinels(store.current())


def incremental_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URLs are in no stored post arrive in batches and become posts."""
    path = work_dir(spark, "posts")
    pages = _pages(spark, sf_dir, deco.HTML_ALL, deco.POST_URL_UNIQUE)
    first = pages.filter(F.col("page_id") % 3 == 0)
    key = spark.conf.get(HANDLE_KEY, DEMO_KEY)
    # Number 0 of a stream that went before; the new one stores under its own folder.
    append_posts(posts.all_posts(first), f"{path}/old", 0, key)
    todo = urls.frontier(pages.select("url"), read_urls(spark, f"{path}/old"))
    arriving = work_dir(spark, "arriving")
    # Two batches; each is several files, so that all cores write and cut it.
    files = max(FILES, spark.sparkContext.defaultParallelism)
    pages.join(todo, "url", "left_semi").select("page_id", "url", "html").repartitionByRange(2 * files, "page_id").write.parquet(arriving)
    stream = page_stream(spark, arriving, files_per_batch=files)
    store_arriving_posts(stream, f"{path}/new", work_dir(spark, "progress"), key).awaitTermination()
    return _post_rows(read_posts(spark, f"{path}/old").unionByName(read_posts(spark, f"{path}/new")).drop("batch"))


def offline_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline pipeline in one plan: keyword filter, slice, one post per page, protected sink."""
    pages = _pages(spark, sf_dir, deco.HTML_SIBLING, deco.POST_URL_UNIQUE)
    some = filters.slice_rows(pages.filter(filters.mentions_keyword(F.col("html"), filters.PLATFORM)), "page_id", 12, 100)
    path = work_dir(spark, "offline")
    found = posts.sibling_posts(some).filter("nickname IS NOT NULL AND post IS NOT NULL")
    found = found.select(*[F.col(c) if c in found.columns else F.lit(None).cast(kind).alias(c) for c, kind in POST_TYPES])
    append_posts(found, path, 0, spark.conf.get(HANDLE_KEY, DEMO_KEY))
    return read_posts(spark, path).select("url", F.coalesce("source_post_id", F.lit(-1).cast("bigint")).alias("source_post_id"), "nickname", "post")


def all_queries() -> dict[str, Query]:
    return {
        "url_normalise_filter": url_normalise_filter,
        "url_post_id": url_post_id,
        "frontier": frontier,
        "progress": progress,
        "gazetteer_clean": gazetteer_clean,
        "gazetteer_short": gazetteer_short,
        "headline": headline,
        "content_text": content_text,
        "container_nested": container_nested,
        "token_table": token_table,
        "node_table": node_table,
        "page_encodings": page_encodings,
        "headline_date": headline_date,
        "bracket_keywords": bracket_keywords,
        "place_tags": place_tags,
        "place_tags_join": place_tags_join,
        "place_tags_inline": place_tags_inline,
        "people_arabic": people_arabic,
        "people_numeral": people_numeral,
        "people_largest": people_largest,
        "case_records": case_records,
        "case_upsert": case_upsert,
        "constraint_check": constraint_check,
        "record_guard": record_guard,
        "keyword_filter": keyword_filter,
        "keyword_slice": keyword_slice,
        "slice_last": slice_last,
        "guarded_insert": guarded_insert,
        "posts_1a": _layout(deco.HTML_1A, "1a"),
        "posts_1b": _layout(deco.HTML_1B, "1b"),
        "posts_2": _layout(deco.HTML_2, "2"),
        "posts_3": _layout(deco.HTML_3, "3"),
        "posts_all": posts_all,
        "post_append": post_append,
        "post_batches": post_batches,
        "post_sibling": _sibling(False),
        "post_sibling_mixed": _sibling(True),
        "post_noise": post_noise,
        "sample_n": sample_n,
        "sample_rand": sample_rand,
        "incremental": incremental,
        "incremental_posts": incremental_posts,
        "offline_posts": offline_posts,
    }
