"""Exact duplicates, with frequent texts taken out before the shuffle.

A text is known by the SHA-256 of its normalised form.  A Misra-Gries summary of all digests
(``freqItems``) names every digest that holds more than ``support`` of the rows, and perhaps some
others; one exact count verifies them.  The winners, at most ``1 / support`` rows, are broadcast and
their copies are settled where they lie.  All other digests hold at most ``support`` of the rows
each, so grouping them by an ordinary shuffle stays even.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm import drops
from shapescreen.llm.batches import free_names
from shapescreen.sources.store import stage

SPACE = "[\\x20\\x09-\\x0D]+"


def digest(text) -> F.Column:
    """SHA-256 (32 bytes) of a text with white-space runs replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, digest``.

    The row with the smallest key stays.  A null key ranks last.  Of rows that repeat both key and
    text exactly one stays; which one is not defined, as they are equal.  Null text is empty text,
    and empty texts form a group like any other.  An empty table gives no rows.
    ``support`` bounds the broadcast (``1 / support`` digests) and decides only the route of a row,
    never the result.
    """
    rows = stage(
        docs.select(
            F.col(key).alias("key"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")
        ),
        "digests",
    )
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("first")
    counted = (first, F.count("*").alias("size"))

    # The summary compares values by equality, which byte arrays lack: it takes their hex form.
    names = rows.select(F.hex("digest").alias("name")).stat.freqItems(["name"], support)
    named = names.select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest"))
    least = support * rows.count()
    winners = stage(
        rows.join(F.broadcast(named), "digest").groupBy("digest").agg(*counted).filter(F.col("size") > least),
        "frequent-digests",
    )
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    settled_rest = rest.join(rest.groupBy("digest").agg(*counted), "digest")
    return settled.unionByName(settled_rest).select(
        F.col("key").alias(key),
        F.col("first.key").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.001) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names.

    Rows are dropped by key and text; of rows that repeat both one stays.  Texts are shuffled only of
    rows that share a key, or its bit, with a dropped one.
    """
    own, other_key, other = free_names(docs, "digest", "other_key", "other_digest")
    lots = (
        groups(docs, key, text, support)
        .groupBy(F.col(key).alias(other_key), F.col("digest").alias(other))
        .agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
        .filter(~F.col("stays") | (F.col("times") > 1))
    )
    lots = stage(lots, "copies")
    clean, rest = drops.split(docs, key, lots, other_key)
    rest = rest.withColumn(own, digest(F.col(text)))
    same = F.col(key).eqNullSafe(F.col(other_key)) & (F.col(own) == F.col(other))
    left = rest.join(lots.select(other_key, other), same, "left_anti")
    repeated = lots.filter("stays").select(other_key, other)
    if not repeated.isEmpty():
        left = left.unionByName(rest.join(repeated, same, "left_semi").dropDuplicates([key, own]))
    return clean.unionByName(left.drop(own))
