"""Drop a few rows of a table by key without shuffling the rest.

A bitmap of the hashed keys to drop, of bounded size, is broadcast in pieces of 4 KB.  Rows whose key
misses it stay where they lie; only those that hit it, the rows to drop and a few others, have to be
looked at exactly.  With more keys than the bitmap has room for, more rows hit it; the result is the
same.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import free_names

#: Bits for each key to drop, and the least and greatest number of bits (as powers of two: 64 MB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 20, 29
#: Bits of one piece, fixed by bitmap_construct_agg.
PIECE = 32_768


def split(docs: DataFrame, key: str, gone: DataFrame, gone_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among the keys of ``gone``, and the others; null is a key too."""
    bits = min(max((BITS_PER_KEY * max(gone.count(), 1)).bit_length(), LEAST_BITS), MOST_BITS)
    place = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))).bitwiseAND((1 << bits) - 1)
    piece_name, bits_name, place_name = free_names(docs, "piece", "bits", "place")
    pieces = (
        gone.select(place(gone_key).alias("at"))
        .groupBy(F.floor(F.col("at") / PIECE).alias(piece_name))
        .agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias(bits_name))
    )
    at = F.col(place_name) % PIECE
    byte = F.conv(F.hex(F.substring(bits_name, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (
        docs.withColumn(place_name, place(key))
        .withColumn(piece_name, F.floor(F.col(place_name) / PIECE))
        .join(F.broadcast(pieces), piece_name, "left")
    )
    hit: Column = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), at % 8).cast("int")) != 0, F.lit(False))
    back = lambda rows: rows.select(*(F.col(f"`{c}`") for c in docs.columns))
    return back(marked.filter(~hit)), back(marked.filter(hit))
