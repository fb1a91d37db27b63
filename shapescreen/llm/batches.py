"""Helpers for work on texts inside tasks: bounded slices, code points, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many UTF-8 bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

#: Spark's defaults for "no bound on a batch's bytes".
UNBOUNDED = ("-1", "2147483647", "9223372036854775807")


def remainder(key, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % F.lit(modulus)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch as well as its rows, unless the session does already."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, *UNBOUNDED):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * SLICE_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table bears them."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice stay near SLICE_BYTES."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(texts.fill_null("").cast(pa.large_binary()).to_numpy(zero_copy_only=False), object)
        upto = np.cumsum([len(x) for x in sizes], dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the n + 1 offsets of the texts in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), offsets


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring offsets (empty ranges: 0)."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def map_texts(docs: DataFrame, work: Callable, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``work(texts) -> {column: values}`` to slices of whole texts; the key is carried along.

    ``schema`` lists the columns after the key.  Texts may be None.
    """
    kind = docs.schema[key].dataType.simpleString()

    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found = work(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({key: batch.column(0), **found})

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {schema}")
