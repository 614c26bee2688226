"""Registered queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.llm import (
    centroids,
    chat_tools,
    collocations,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    pieces,
    quality_rules,
    sentencepiece_codec,
    suffix_dedup,
    token_counts,
    warc_derivatives,
)

#: Folder of the public tokenizer files; a session may name another.
TOKENIZERS = "spark.casework.tokenizers"
MODEL = "piece_bpe_32k.model"

#: Date of the stored pages, which have none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"
#: Tools of the derived calls: properties with their type, and whether they are required.
TOOLS = {
    "search": {"text": ("string", True), "limit": ("integer", True)},
    "lookup": {"text": ("string", True), "limit": ("integer", False)},
    "count": {"text": ("string", True)},
}

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model(spark: SparkSession) -> bytes:
    return pieces.read_model(f"{spark.conf.get(TOKENIZERS, '/opt/tokenizers')}/{MODEL}")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), piece_model(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    _, found = language_id.learn_and_predict(docs)
    return found.select("doc_id", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_documents(spark, sf_dir)).drop("repeat_chars", "longest_repeat")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text that they give back."""
    rows = sentencepiece_codec.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), piece_model(spark))
    return rows.select(
        "doc_id",
        "n_pieces",
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "round_trip",
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_shared_lines(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from conversations, which hold none: an assistant turn calls, the user turn after it answers.

    By the turn, calls have good arguments, one of a wrong type, one missing, or no object.
    """
    turn, previous = F.col("turn"), F.col("turn") - 2
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (turn % 3 + 1).cast("int"))
    good = F.to_json(F.struct("text", F.length("text").alias("limit")))
    arguments = (
        F.when(turn % 8 == 5, F.to_json(F.struct("text", F.lit("many").alias("limit"))))
        .when(turn % 8 == 2, F.to_json(F.struct(F.length("text").alias("limit"))))
        .when(turn % 8 == 4, F.to_json(F.array("text")))
        .otherwise(good)
    )
    after = F.when((turn > 2) & (turn % 8 > 2), F.array(F.concat(F.lit("call_"), previous.cast("string")))).otherwise(F.array().cast("array<string>"))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call_"), turn.cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), after.alias("after")
    )
    results = turns.filter("role = 'user' AND turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("call_"), (turn - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_tools.calls_and_results(*calls_and_results(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return rows.withColumn("problems", F.array_join("problems", " "))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_derivatives.derive(warc_derivatives.responses(pages, PAGE_DATE))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.without_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language_id": op2_language_id,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_source_mixing": op7_source_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_warc_derivatives": op10_warc_derivatives,
        "op11_collocations": op11_collocations,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_centroid_clustering": op13_centroid_clustering,
    }
