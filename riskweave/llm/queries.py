"""The queries of this subpackage by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from riskweave.llm import forest, mixing, recompress, sketch, suffix
from riskweave.llm.common import table
from riskweave.llm.langid import held_out, predict, train
from riskweave.llm.packing import pack
from riskweave.llm.search import top_k
from riskweave.llm.secrets import secret_spans
from riskweave.llm.urls import judge


def tokenizer_path() -> str:
    """The byte-level vocabulary's file; RISKWEAVE_TOKENIZER names another."""
    if own := os.environ.get("RISKWEAVE_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicate(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_target_mixing": op7_target_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}
