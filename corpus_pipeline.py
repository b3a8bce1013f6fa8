"""A training corpus from documents: five of the operators, each on what the one before kept.

Language ID drops documents without a recognisable language; near-dedup keeps one document
of each group of 0.8 similarity or more; the secret scan masks what it finds; mixing thins
or repeats documents to the target weights; packing gives the token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import langid, mixing, packing, secrets, sketch
from riskweave.llm.common import table, written
from riskweave.llm.queries import tokenizer_path

SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; und (null text, or no letter in it) goes.

    Empty texts are und; long ones are read whole. Where no row teaches a language, all texts with a letter stay.
    """
    model = langid.train(docs, F.col("lang").isNotNull())
    if not model.langs:
        return docs.filter(langid.has_letter())
    return langid.predict(docs, model).filter(F.col("lang_pred") != "und").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, of the smallest doc_id.

    Rows without a doc_id, and those without words, link with nothing and stay. So do texts of
    one doc_id that aren't alike: they are told apart by their text, not by the id.
    """
    return sketch.deduplicated(docs, SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars of the masked text; null and empty texts stay as they are."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates to the target weights of the labelled domains.

    Rows come as often as their rate says, and rows alike in id and text alike. Null and empty
    texts have no tokens and the prior's rate; texts of any length are read whole; without a
    usable label, or without rows, everything stays as it is.
    """
    return mixing.resampled(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a null or empty text is one separator, a long one many pieces, an empty table none."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("best_fit_packing", pack),
]
#: Classifiers, sketches and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
