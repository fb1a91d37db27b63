"""Registered queries: each operator over its whole table, in the columns that were agreed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapescreen.llm import batches, bpe, exact_dedup, language_id, merkle, mixing, ngram_join, packing, pii, secrets, sharding, topk, toxicity, variants
from shapescreen.llm.oracle import oracle_sql
from shapescreen.session import ship_package

__all__ = ["queries", "oracle_sql"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_definition(name: str) -> str:
    """The JSON of a public tokenizer, read at the driver."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = batches.remainder("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.scan(docs, pii.train(docs))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_definition("byte_bpe_50k.json"), 2048, 0)


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), 5, 50)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = batches.remainder("doc_id", 5) == 0
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").filter(~held_out)
    model = toxicity.train(labelled)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), tokenizer_definition("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.cluster(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixing.taken_words(found).withColumnRenamed("key", "doc_id")


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    without_breaks = F.when(batches.remainder("doc_id", 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = merkle.manifest(table(spark, folder, "documents"), {"text": without_breaks})
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
