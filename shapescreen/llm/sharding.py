"""Contiguous shards of nearly equal bytes, from prefix sums.

Rows are put in key order by one range shuffle of narrow rows (key, size, checksum).  Every range
partition is totalled; the totals, one row per partition, give each partition the bytes and rows
that lie before it.  Inside a partition a running sum completes the global prefix sum, and equal
targets of the total cut it into shards.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.sources.store import stage


def byte_shards(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """One row per input row: ``key, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text (null: 0) plus ``overhead``.  A row belongs to the
    shard in which the middle of its bytes falls, so a shard differs from an equal share by at most
    one row at either end.  ``slot`` counts the rows of a shard from 0 in key order (null keys
    first; rows of equal key by checksum and size).  Rows alike in all three are interchangeable.
    With fewer rows than shards some shards stay empty; an empty table gives no rows.
    """
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    order = ["key", "text_crc32", "size", "row"]
    # The partition number is stored with the rows: a later recomputation can't deal them anew.
    rows = stage(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(text_bytes) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text_bytes).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id()),
        "sized-rows",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("total"),
        )
    )
    running = Window.partitionBy("part").orderBy(*order)
    upto = F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        rows.withColumns({"upto": upto, "nth": F.row_number().over(running)})
        .join(F.broadcast(starts), "part")
        .withColumn("twice", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .select(
            "key",
            "size",
            "text_crc32",
            # The middle of the row is below the total, hence the shard below the count.
            F.expr(f"int((twice * {int(shards)}L) div (2 * total))").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("position"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
