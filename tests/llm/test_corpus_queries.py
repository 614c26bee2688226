"""Registered queries: SQL where there is some, native plans, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from casework.llm import jaccard_join, language_id, mixing, oracle, queries
from compare import DATA, compare, connect
from test_corpus_operators import brute_components, brute_targets

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.all_oracles()))
def test_query_equals_sql(spark, name):
    ours, theirs, more, less = compare(spark, connect(SF), SF, name)
    assert ours == theirs > 0 and not more and not less


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op8_line_dedup", "op9_chat_formatting"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"):
        assert node not in plan


def test_queries_return_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_token_counts", "op6_sentencepiece"):
        rows = queries.all_queries()[name](spark, SF)
        assert rows.count() == docs
        if "round_trip" in rows.columns:
            assert rows.filter("NOT round_trip").count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    odd = [(10**6, None, None, "src1", 0), (10**6 + 1, "1234 !!", None, None, 7), (10**6 + 2, docs.first().text, "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()

    kept = stages["language_id"](spark, docs, SF).cache()
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and lost == {10**6, 10**6 + 1}

    once = stages["exact_dedup"](spark, kept, SF).cache()
    least = {}
    for r in kept.collect():
        key = " ".join(r.text.split())
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(least.values())

    near = stages["ngram_jaccard_join"](spark, once, SF).cache()
    groups = brute_components([(r.doc_id, r.text) for r in once.collect()])
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted({g[2] for g in groups})

    mix = stages["source_mixing"](spark, near, SF).cache()
    sizes, taken = {}, {}
    for rows, out in ((near, sizes), (mix, taken)):
        for r in rows.collect():
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    targets = brute_targets(sizes)
    assert mix.columns == docs.columns and all(abs(taken.get(s, 0) - t) <= 100 for s, t in targets.items())

    last = stages["sentencepiece"](spark, mix, SF)
    assert last.count() == mix.count() and last.filter("NOT round_trip OR n_pieces <> size(ids)").count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and language_id.UNKNOWN == "und" and jaccard_join.PERCENT == 80 and mixing.MOST == 3
