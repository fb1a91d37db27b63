"""Exact top-k search by distributed histogram selection.

Vectors are packed into chunks and queries into blocks, each a bounded matrix; every block meets
every chunk once a pass, over an equi-join on (block, lane), and a task holds one pair at a time.
A pass scores all pairs and counts scores in bins.  Global sums of the counts locate the bin of
each query's kth score; the next pass splits that bin, until bins are one wide and the kth score is
known.  The last pass keeps what reaches it and breaks ties by identifier.

A chunk reports its bins only from the top down to its own kth score: the kth score of all rows is
never lower, so no count that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches
from shapescreen.sources.store import stage

#: Rows of a chunk or block, fewer if they would exceed CHUNK_BYTES.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
#: Queries scored at once against a chunk.
STRIP = 256
#: Bins of a pass.
BINS = 4096
PACKED = "first long, rows int, width int, ids binary, matrix binary, norm double"
SCHEMA = pa.schema(
    [
        ("first", pa.int64()),
        ("rows", pa.int32()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("matrix", pa.binary()),
        ("norm", pa.float64()),
    ]
)
OWN = SCHEMA.append(pa.field("own", pa.binary()))


def pack(ids: np.ndarray, matrix: np.ndarray, first: int) -> dict:
    """A matrix of integers as one row, in two bytes a component where they suffice."""
    norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
    kind = "<i2" if np.abs(matrix).max(initial=0) <= 32767 else "<i8"
    return {
        "first": first,
        "rows": len(ids),
        "width": matrix.shape[1],
        "ids": ids.astype("<i8").tobytes(),
        "matrix": matrix.astype(kind).tobytes(),
        "norm": norm,
    }


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and matrix of a packed row."""
    kind = "<i2" if len(row["matrix"]) == 2 * row["rows"] * row["width"] else "<i8"
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["matrix"], kind).reshape(row["rows"], row["width"])


def quantised(vectors: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """Rows that take part, as ``key, v array<long>``."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(key).cast("long").alias("key"),
        F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
    )


def chunks(rows: DataFrame) -> DataFrame:
    """Pack rows; ``first`` numbers them apart from those of any other chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            width = int(lengths.max(initial=0))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(ids), width), np.int64)  # a missing component counts as 0
            matrix[np.arange(width) < lengths[:, None]] = flat
            step = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(1, width))))
            for a in range(0, len(ids), step):
                yield pa.RecordBatch.from_pylist([pack(ids[a : a + step], matrix[a : a + step], number)], SCHEMA)
                number += step

    return rows.mapInArrow(run, PACKED)


def query_blocks(packed: DataFrame, every: int) -> DataFrame:
    """The query rows of all chunks, packed anew as ``block``, with their row numbers (``own``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = unpack(row)
                chosen = np.flatnonzero(ids % every == 0)
                if len(chosen):
                    found = pack(ids[chosen], matrix[chosen], row["first"])
                    found["own"] = (row["first"] + chosen).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_pylist([found], OWN)

    fields = "first long, rows int, width int, ids binary, matrix binary, norm double, own binary"
    picked = stage(packed.select("first", "rows", "width", "ids", "matrix").mapInArrow(run, fields), "query-rows")
    total = picked.agg(F.sum("rows")).first()[0] or 0

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                full = sum(r["rows"] for r in waiting) + row["rows"] > CHUNK_ROWS
                heavy = sum(len(r["matrix"]) for r in waiting) + len(row["matrix"]) > CHUNK_BYTES
                if waiting and (full or heavy):
                    yield _merged(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield _merged(waiting)

    few = picked.repartition(-(-total // CHUNK_ROWS) or 1)
    return stage(few.mapInArrow(merge, fields).withColumn("block", F.monotonically_increasing_id()), "query-blocks")


def _merged(rows: list[dict]) -> pa.RecordBatch:
    parts = [unpack(r) for r in rows]
    width = max(m.shape[1] for _, m in parts)
    matrix = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])
    found = pack(np.concatenate([i for i, _ in parts]), matrix, rows[0]["first"])
    found["own"] = b"".join(r["own"] for r in rows)
    return pa.RecordBatch.from_pylist([found], OWN)


def scores(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strips of a block against a chunk: query numbers, their scores, chunk's identifiers.

    A query's own row scores lowest of all, below any bin.
    """
    _, queries = unpack({k: row[f"q_{k}"] for k in ("ids", "matrix", "rows", "width")})
    ids, matrix = unpack(row)
    own = np.frombuffer(row["q_own"], "<i8") - row["first"]
    width = min(queries.shape[1], matrix.shape[1])
    # Sums below 2^53 are exact in floating point, whatever their order.
    kind = np.float64 if row["q_norm"] * row["norm"] < 2**52 else np.int64
    columns = matrix[:, :width].T.astype(kind)
    for a in range(0, len(queries), STRIP):
        part = np.arange(a, min(len(queries), a + STRIP))
        found = (queries[part, :width].astype(kind) @ columns).astype(np.int64)
        mine = own[part]
        inside = np.flatnonzero((mine >= 0) & (mine < len(ids)))
        found[inside, mine[inside]] = np.iinfo(np.int64).min
        yield part, found, ids


def pairs(packed: DataFrame, blocks: DataFrame, lows: DataFrame, lanes: int) -> DataFrame:
    """Every block with every chunk: an equi-join in which blocks are copied to the lanes and chunks
    to the blocks; chunks are even, so no key is hot."""
    numbers = F.lit([r[0] for r in blocks.select("block").collect()])  # one number per 4096 queries
    left = packed.withColumn("lane", F.pmod(F.xxhash64("first"), F.lit(lanes))).withColumn("block", F.explode(numbers))
    right = (
        blocks.join(lows, "block")
        .select("block", "low", *(F.col(c).alias(f"q_{c}") for c in ("ids", "matrix", "rows", "width", "norm", "own")))
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    )
    return left.join(right, ["block", "lane"]).drop("lane", "q_first")


def histogram(joined: DataFrame, k: int, step: int) -> DataFrame:
    """Counts of scores by query and bin; a chunk's bins end with its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = np.array(row["low"], np.int64)
                for part, found, _ in scores(row):
                    top = np.partition(found, max(0, found.shape[1] - k), axis=1)[:, -k:]
                    bins = np.minimum((top - low[part, None]) // step, BINS)
                    rows, columns = np.nonzero(top >= low[part, None])
                    key, counts = np.unique(part[rows] * (BINS + 1) + bins[rows, columns], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": np.full(len(key), row["block"], np.int64),
                            "query": key // (BINS + 1),
                            "bin": key % (BINS + 1),
                            "count": counts.astype(np.int64),
                        }
                    )

    return joined.mapInArrow(run, "block long, query long, bin long, count long")


def best_rows(joined: DataFrame, k: int) -> DataFrame:
    """Rows that reach their query's kth score; of a chunk at most its first k by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = np.array(row["low"], np.int64)
                query_ids = np.frombuffer(row["q_ids"], "<i8")
                for part, found, ids in scores(row):
                    rows, columns = np.nonzero(found >= low[part, None])
                    values = found[rows, columns]
                    order = np.lexsort((columns, ids[columns], -values, rows))
                    rows, columns, values = rows[order], columns[order], values[order]
                    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    kept = nth < k
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": np.full(int(kept.sum()), row["block"], np.int64),
                            "query": part[rows[kept]],
                            "query_id": query_ids[part[rows[kept]]],
                            "vec_id": ids[columns[kept]],
                            "score": values[kept],
                            "row": row["first"] + columns[kept],
                        }
                    )

    return joined.mapInArrow(
        run, "block long, query long, query_id long, vec_id long, score long, row long"
    )


def located(counts: DataFrame, lows: DataFrame, k: int, step: int) -> DataFrame:
    """New lower ends, packed by block: the bin in which the count from the top reaches k."""
    down = Window.partitionBy("block", "query").orderBy(F.desc("bin"))
    reached = (
        counts.groupBy("block", "query", "bin")
        .agg(F.sum("count").alias("count"))
        .withColumn("upto", F.sum("count").over(down))
        .filter(F.col("upto") >= k)
        .groupBy("block", "query")
        .agg(F.max("bin").alias("bin"))
    )
    old = lows.select("block", F.posexplode("low").alias("query", "old"))
    # Fewer than k rows in all: everything is kept.
    low = F.col("old") + F.coalesce(F.col("bin"), F.lit(0)) * F.lit(step)
    return (
        old.join(reached, ["block", "query"], "left")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("query", low.alias("low")))).alias("pairs"))
        .select("block", F.col("pairs.low").alias("low"))
    )


def search(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose key is divisible by ``every``.

    Components become ``floor(scale * x)``; the score is the integer inner product.  Vectors that
    are null or hold null or non-finite components, and rows without a key, take no part; a vector
    shorter than another counts as padded with zeros.  A query is a row, and only that row is left
    out of its candidates: of rows that repeat a key each is a candidate, and each is a query of its
    own.  Ties go to the smaller key.  A query with fewer candidates gets all of them; an empty
    table gives no rows.  Scores must stay below 2^62.
    """
    bound_batches(vectors.sparkSession)
    packed = stage(chunks(quantised(vectors, scale, key, vector)), "vector-chunks")
    blocks = query_blocks(packed, every)
    lanes, norm = packed.agg(F.count("*"), F.max("norm")).first()
    bound = int((norm or 0.0) ** 2 * 1.0001) + 1
    if bound >= 1 << 62:
        raise ValueError("scores exceed 64-bit integers; use a smaller scale")
    lows = blocks.select("block", F.array_repeat(F.lit(-bound).cast("long"), F.col("rows")).alias("low"))
    span = 2 * bound + 1
    while span > 1:
        step = -(-span // BINS)
        counts = histogram(pairs(packed, blocks, lows, lanes), k, step)
        lows = stage(located(counts, lows, k, step), "lower-ends")
        span = step
    found = best_rows(pairs(packed, blocks, lows, lanes), k)
    ranked = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
