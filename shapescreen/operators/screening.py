"""Score every candidate molecule of a target against every template of that target.

The result has one row per template and candidate, which is what the rank
measures need.  Conformer pairs never become rows: each task reduces them inside
NumPy blocks.  Two layouts give the same rows:

* few templates (size measured first): every task gets them, candidates stay
  where they are and nothing is shuffled;
* more templates: both sides are packed into bounded chunks and joined on target
  and salt, so that a large target is spread over many tasks;
* where the copies for the salts, or the templates of a target that meet in a task,
  grow large: chunks of both sides are stored once, and each task reads a few of
  either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shapescreen.functions.packed import Packed, by_key, pack
from shapescreen.functions.similarity import best_shape_match
from shapescreen.operators.molecules import lowest_energy, union_frames
from shapescreen.session import bound_batches
from shapescreen.sources.store import stage

Kernel = Callable[[Packed, Packed], np.ndarray]

MAX_BROADCAST_TEMPLATES = 20_000
MAX_BROADCAST_BYTES = 64 << 20
_TEMPLATES_PER_CHUNK = 1024
_CANDIDATES_PER_CHUNK = 1024
# Bytes of a chunk of either side, about.
_CHUNK_BYTES = 4 << 20
# Pairs of molecules that share a salt, and pairs of a task, about.
_SALT_PAIRS, _TASK_PAIRS = 4 << 20, 16 << 20
# Bytes of unfinished chunks in a task.
_HELD_BYTES = 64 << 20
#: Bytes of templates, copied for all salts, and of a data set's templates, above which tasks read both sides; data
#: sets of one screening that are laid out so, at most (each is a branch of the plan).
COPIED_BYTES, KEPT_BYTES, _MOST_CROSSED = 1 << 30, 16 << 20, 64
# Result rows per Arrow batch.
_ROWS_OUT = 100_000


def screen(
    molecules: DataFrame,
    template_conformers: str = "all",
    kernel: Kernel = best_shape_match,
    max_broadcast: int = MAX_BROADCAST_TEMPLATES,
    keys: tuple[str, ...] = ("target",),
) -> DataFrame:
    """Use every active as a template for all molecules of its target, itself included.

    ``template_conformers`` is "all" or "lec" (lowest-energy conformer only).
    ``keys`` name the columns that separate data sets, such as target and portion.
    """
    actives = molecules.filter(F.col("active"))
    if template_conformers == "lec":
        actives = lowest_energy(actives)
    elif template_conformers != "all":
        raise ValueError("template_conformers is 'all' or 'lec'")
    features = F.col("conformers.features").alias("rows")
    return score_pairs(
        actives.select(*keys, F.col("mol_id").alias("template_id"), features),
        molecules.select(*keys, "mol_id", F.col("active").alias("truth"), features),
        kernel,
        max_broadcast,
        keys,
    )


def score_pairs(
    templates: DataFrame,
    candidates: DataFrame,
    kernel: Kernel,
    max_broadcast: int = MAX_BROADCAST_TEMPLATES,
    keys: tuple[str, ...] = ("target",),
) -> DataFrame:
    """Apply a block kernel to all template and candidate molecules of equal keys.

    ``templates(*keys, template_id, rows)``, ``candidates(*keys, mol_id, truth,
    rows)``; ``rows`` is ``array<array<double>>``.  The kernel receives two packed
    groups and returns a templates-by-candidates matrix.
    """
    return _laid_out(
        templates,
        candidates,
        max_broadcast,
        list(keys),
        lambda shared, own: _against_all(shared, kernel, own),
        lambda own: _chunk_by_chunk(kernel, own),
    )


def _values():
    """Numbers in a molecule's rows."""
    return F.aggregate("rows", F.lit(0), lambda n, row: n + F.size(row))


def _laid_out(templates, candidates, max_broadcast, keys, against_all, chunk_by_chunk) -> DataFrame:
    """Bring templates and candidates together in one of the two layouts, as template and candidate rows."""
    schema = T.StructType(
        [
            *[candidates.schema[k] for k in keys],
            templates.schema["template_id"],
            candidates.schema["mol_id"],
            T.StructField("score", T.DoubleType()),
            candidates.schema["truth"],
        ]
    )
    measured = templates.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_values()), F.lit(0)).alias("values")
    ).first()
    if measured["n"] <= max_broadcast and 8 * measured["values"] <= MAX_BROADCAST_BYTES:
        few = pack(templates.toArrow(), keys, "template_id", "rows")
        shared = candidates.sparkSession.sparkContext.broadcast(few)
        return candidates.mapInArrow(against_all(shared, keys), schema)
    run, frames = chunk_by_chunk(keys), []
    crossed, rest = _crossed(templates, candidates, keys)
    if crossed:
        frames = [joined.mapInArrow(run, schema) for joined in _read_by_tasks(templates, candidates, keys, crossed)]
        templates = _of(crossed, templates, keys, "left_anti")
    if rest:
        frames.append(_chunked(templates, candidates, keys).mapInArrow(run, schema))
    return union_frames(*frames)


def _emit(labels: dict, templates: Packed, candidates: Packed, truth: pa.Array, kernel: Kernel):
    """Score matrix as Arrow batches of bounded size; ``labels`` are one-value arrays of the keys."""
    per_batch = max(1, _ROWS_OUT // len(templates))
    for lo in range(0, len(candidates), per_batch):
        piece = candidates.piece(lo, min(lo + per_batch, len(candidates)))
        scores = kernel(templates, piece)
        n_t, n_c = scores.shape
        t = pa.array(np.repeat(np.arange(n_t), n_c))
        c = pa.array(np.tile(np.arange(n_c), n_t))
        same = pa.array(np.zeros(n_t * n_c, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                *[value.take(same) for value in labels.values()],
                templates.ids.take(t),
                piece.ids.take(c),
                pa.array(scores.ravel()),
                truth.slice(lo, n_c).take(c),
            ],
            [*labels, "template_id", "mol_id", "score", "truth"],
        )


def _against_all(shared, kernel: Kernel, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = batch.filter(pc.greater(batch.column("rows").value_lengths(), 0))
            groups = pack(filled, keys, "mol_id", "rows")
            for key, index in by_key(filled, keys):
                templates = shared.value.get(key)
                if templates is not None:
                    labels = {k: filled.column(k).slice(int(index[0]), 1) for k in keys}
                    truth = filled.column("truth").take(pa.array(index))
                    yield from _emit(labels, templates, groups[key], truth, kernel)

    return run


def _sizes(molecules: DataFrame, keys: list[str]) -> DataFrame:
    return molecules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (8 * F.sum(_values())).alias("bytes"))


def _chunks_of_largest(molecules: DataFrame, keys: list[str], per_chunk: int) -> int:
    """Chunks in which a data set has at most about ``per_chunk`` molecules and _CHUNK_BYTES.

    Every data set is cut on its own: counted over all of them, a chunk would hold few molecules of
    each, and every chunk meets all chunks of the other side.
    """
    n, size = (v or 0 for v in _sizes(molecules, keys).agg(F.max("n"), F.max("bytes")).first())
    return max(1, -(-n // per_chunk), -(-size // _CHUNK_BYTES))


def _pairs(templates: DataFrame, candidates: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Pairs of molecules of the largest data set and of all of them."""
    left = _sizes(templates, keys).select(*keys, F.col("n").alias("t"))
    both = _sizes(candidates, keys).select(*keys, F.col("n").alias("c")).join(left, keys)
    pairs = (F.col("t") * F.col("c")).cast("decimal(38,0)")
    return tuple(int(v or 0) for v in both.agg(F.max(pairs), F.sum(pairs)).first())


def _chunked(templates: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, template chunk, candidate chunk) of bounded size, spread by salt.

    What a task takes follows from its pairs, not from the bytes that it reads: salts and partitions are as
    many as the pairs ask for.  Partitions of a number that is asked for are not put together by adaptive
    execution, and the join takes both sides as they are dealt (it would deal floating keys anew).
    """
    spark = candidates.sparkSession
    bound_batches(spark)
    t_chunks = _chunks_of_largest(templates, keys, _TEMPLATES_PER_CHUNK)
    c_chunks = _chunks_of_largest(candidates, keys, _CANDIDATES_PER_CHUNK)
    largest, every = _pairs(templates, candidates, keys)
    salts = min(c_chunks, max(1, -(-largest // _SALT_PAIRS)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // _TASK_PAIRS))
    chunk = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    floating = lambda k: isinstance(candidates.schema[k].dataType, T.FractionalType)
    names = [f"key_{i}" for i in range(len(keys))]
    meet = [((F.col(k) + 0).cast("string") if floating(k) else F.col(k)).alias(n) for k, n in zip(keys, names)]
    left = (
        templates.filter(F.size("rows") > 0)
        .groupBy(*keys, chunk("template_id", t_chunks).alias("t_chunk"))
        .agg(F.collect_list(F.struct("template_id", "rows")).alias("templates"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select(*meet, F.col("salt").cast("bigint").alias("salt"), "templates")
        .repartition(tasks, *names, "salt")
    )
    right = (
        candidates.filter(F.size("rows") > 0)
        .groupBy(*keys, chunk("mol_id", c_chunks).alias("c_chunk"))
        .agg(F.collect_list(F.struct("mol_id", "truth", "rows")).alias("candidates"))
        .withColumn("salt", F.pmod(F.col("c_chunk"), F.lit(salts)))
        .select(*keys, *meet, "salt", "candidates")
        .repartition(tasks, *names, "salt")
    )
    joined = right.join(left.hint("merge"), [*names, "salt"])
    return joined.select(*keys, "templates", "candidates")


@dataclass
class Grid:
    """A data set whose chunks of templates lie in ``across`` partitions, and those of candidates in ``down``."""

    set: int
    keys: tuple
    across: int
    down: int


def _crossed(templates: DataFrame, candidates: DataFrame, keys: list[str]) -> tuple[list[Grid], bool]:
    """Data sets whose sides tasks read, largest first, and whether there are others."""
    left = _sizes(templates, keys).select(*keys, F.col("n").alias("t"), F.col("bytes").alias("t_bytes"))
    both = _sizes(candidates, keys).join(left, keys).collect()
    chunks = lambda n, size: max(1, -(-n // _CANDIDATES_PER_CHUNK), -(-(size or 0) // _CHUNK_BYTES))
    largest = max((r["t"] * r["n"] for r in both), default=0)
    salts = min(max((chunks(r["n"], r["bytes"]) for r in both), default=1), max(1, -(-largest // _SALT_PAIRS)))
    copied = salts * sum(r["t_bytes"] or 0 for r in both)
    large = [
        r
        for r in both
        if r["t"] * r["n"] > _TASK_PAIRS and (copied > COPIED_BYTES or (r["t_bytes"] or 0) > KEPT_BYTES)
    ]
    grids = []
    for i, r in enumerate(sorted(large, key=lambda r: -r["t"] * r["n"])[:_MOST_CROSSED]):
        # Chunks are dealt at random: small tasks even that out.
        tasks = -(-4 * r["t"] * r["n"] // _TASK_PAIRS)
        across = -(-(r["t_bytes"] or 1) // KEPT_BYTES)
        down = min(chunks(r["n"], r["bytes"]), -(-tasks // across))
        across = max(across, min(chunks(r["t"], r["t_bytes"]), -(-tasks // down)))
        grids.append(Grid(i, tuple(r[k] for k in keys), across, down))
    return grids, len(grids) < len(both) or not both


def _of(grids: list[Grid], rows: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of those data sets, with their ``set``, or of the others (``left_anti``)."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("set", T.IntegerType())])
    table = rows.sparkSession.createDataFrame([(*g.keys, g.set) for g in grids], schema)
    return rows.join(F.broadcast(table), keys, how)


def _read_by_tasks(templates: DataFrame, candidates: DataFrame, keys: list[str], grids: list[Grid]) -> list[DataFrame]:
    """For each of these data sets, rows ``(*keys, templates, candidates)`` of chunks that meet.

    Chunks of candidates are made where the molecules lie; both are stored once.  A task keeps its templates, at most about
    KEPT_BYTES, while its candidates stream past.
    """
    bound_batches(candidates.sparkSession)

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return stage(chunk_rows(rows, "set", name), name, "set")

    filled = lambda rows: _of(grids, rows.filter(F.size("rows") > 0), keys)
    # Candidates meet all chunks of templates, which are therefore filled: templates are dealt first.
    tasks = sum(g.across for g in grids)
    part = F.pmod(F.xxhash64("template_id"), F.lit(max(g.across for g in grids)))
    left = stored(filled(templates).select("set", "template_id", "rows").repartition(tasks, "set", part), "templates")
    right = stored(filled(candidates).select("set", "mol_id", "truth", "rows"), "candidates")
    made = []
    for g in grids:
        kept = left.filter(F.col("set") == g.set).select("templates").repartition(g.across)
        streamed = right.filter(F.col("set") == g.set).select("candidates").repartition(g.down)
        labels = [F.lit(v).cast(candidates.schema[k].dataType).alias(k) for k, v in zip(keys, g.keys)]
        made.append(streamed.hint("shuffle_replicate_nl").crossJoin(kept).select(*labels, "templates", "candidates"))
    return made


def chunk_rows(molecules: DataFrame, by: str, name: str) -> DataFrame:
    """Rows of molecules as rows ``(by, name)`` with chunks of bounded size, made where the rows lie.

    A task holds at most a chunk for each value of ``by``, and _HELD_BYTES of them.
    """
    fields = [f for f in molecules.schema.fields if f.name != by]
    schema = T.StructType([molecules.schema[by], T.StructField(name, T.ArrayType(T.StructType(fields)))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def chunk(key) -> pa.RecordBatch:
            parts = held.pop(key)[0]
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0].to_struct_array()
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            made = [pa.array([key], kinds.field(by).type), lists.cast(kinds.field(name).type)]
            return pa.RecordBatch.from_arrays(made, schema=kinds)

        for batch in batches:
            for (key,), index in by_key(batch, [by]):
                own = batch.take(pa.array(index)).drop_columns([by])
                step = min(_CANDIDATES_PER_CHUNK, max(1, own.num_rows * _CHUNK_BYTES // max(1, own.nbytes)))
                for lo in range(0, own.num_rows, step):
                    part = own.slice(lo, step)
                    # Of its own, as a slice would hold all rows.
                    part = part.take(pa.array(np.arange(part.num_rows)))
                    parts, n, size = held.get(key, ([], 0, 0))
                    held[key] = [*parts, part], n + part.num_rows, size + part.nbytes
                    if held[key][1] >= _CANDIDATES_PER_CHUNK or held[key][2] >= _CHUNK_BYTES:
                        yield chunk(key)
            while sum(size for _, _, size in held.values()) > _HELD_BYTES:
                yield chunk(max(held, key=lambda k: held[k][2]))
        for key in list(held):
            yield chunk(key)

    return molecules.mapInArrow(run, schema)


def unpacked(column: pa.ListArray, row: int, identifier: str):
    """A chunk's molecules, packed, and its table."""
    table = pa.RecordBatch.from_struct_array(column.slice(row, 1).flatten())
    one = table.append_column("one", pa.array(np.zeros(table.num_rows, dtype=np.int8)))
    return pack(one, ["one"], identifier, "rows")[(0,)], table


def _chunk_by_chunk(kernel: Kernel, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                templates, _ = unpacked(batch.column("templates"), row, "template_id")
                candidates, table = unpacked(batch.column("candidates"), row, "mol_id")
                labels = {k: batch.column(k).slice(row, 1) for k in keys}
                yield from _emit(labels, templates, candidates, table.column("truth"), kernel)

    return run
