"""From documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which ``run`` writes to the shared folder and reads again for the next one.  All stages
but the last return the columns of documents.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapescreen.llm import exact_dedup, language_id, ngram_join, packing, pii
from shapescreen.llm.queries import tokenizer_definition
from shapescreen.session import ship_package
from shapescreen.sources.store import stage


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (``und``: no text, or no letter in it) go.

    The model learns from the labelled documents of the input.
    """
    ship_package(spark)
    return language_id.keep_known(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space count as one space) the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.8 on five-word shingles the smallest doc_id stays."""
    ship_package(spark)
    return ngram_join.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows the text."""
    ship_package(spark)
    return pii.redact(docs, pii.train(docs), length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, in the columns of op5."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_definition("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("language id", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

# Language models, statistical tagging and token packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
