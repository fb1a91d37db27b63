"""Training and scoring of many models in shared Spark jobs.

A model belongs to ``(target, portion, param, fold)``.  Fold -1 trains on all
rows of its data set, fold f on all rows outside fold f.  :mod:`training` says how
models learn; here are the grid of models, passes over data sets too large for a
task, the stored model tables, and scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapescreen.functions.packed import by_key, matrix, pack
from shapescreen.operators.molecules import lowest_energy
from shapescreen.session import bound_batches
from shapescreen.sources.store import StagedTable

# Parameters sent to the tasks at once.
WAVE_BYTES = 64 << 20
# Partial sums the driver adds up itself; beyond it they are added in Spark.
_DIRECT_BYTES = 64 << 20
_FAN_IN = 64
# Training data per task; a pass costs much more per byte than a scan.
_TASK_BYTES = 1 << 20
# How the scores of a molecule's conformers become one.
REDUCTIONS = {"max": np.maximum, "min": np.minimum, "mean": np.add}
# Score reported for a regression target.
ACTIVE_VALUE = 100.0


@dataclass
class Model:
    target: object
    portion: float
    param: int
    fold: int
    n_rows: int
    width: int = 0
    state: dict = field(default_factory=dict)

    @property
    def nbytes(self) -> int:
        return sum(np.asarray(v).nbytes for v in self.state.values())

    def fail(self) -> None:
        """Training broke down numerically: keep the row, drop the parameters."""
        self.state = {"status": "failed"}

    @property
    def failed(self) -> bool:
        return self.state.get("status") == "failed"


def trains(fold, held_out: int):
    """Rows, by their fold, that a model with this held-out fold learns from."""
    return (fold != held_out) | (held_out < 0)


def training_rows(dataset: DataFrame, actives_only: bool = True, train_mode: str = "all") -> DataFrame:
    """Rows a model learns from: actives only or both labels, all conformers or the lowest-energy one."""
    rows = dataset.filter(F.col("active")) if actives_only else dataset
    return lowest_energy(rows) if train_mode == "lec" else rows


def row_counts(rows: DataFrame) -> pd.DataFrame:
    """Conformers and feature width per (target, portion, fold): a few rows per target."""
    width = F.size(F.get("conformers", F.lit(0))["features"])
    return (
        rows.groupBy("target", "portion", "fold")
        .agg(F.sum(F.size("conformers")).alias("n"), F.max(width).alias("width"))
        .toPandas()
    )


def model_grid(
    counts: pd.DataFrame, params: Iterable[int], folds: Iterable[int], chosen: dict | None = None
) -> list[Model]:
    """One model per data set, parameter and fold, with its training rows and feature width.

    ``chosen`` maps (target, portion) to the only parameter wanted there.
    """
    params, folds = list(params), list(folds)
    out = []
    for (target, portion), part in counts.groupby(["target", "portion"]):
        target = target.item() if isinstance(target, np.generic) else target
        if chosen is not None:
            if (target, float(portion)) not in chosen:
                continue
            params = [chosen[target, float(portion)]]
        width = int(part["width"].max())
        for fold in folds:
            n = int(part.loc[trains(part["fold"], fold), "n"].sum())
            out += [Model(target, float(portion), int(p), int(fold), n, width) for p in params]
    return out


def waves(models: list[Model], size: Callable[[Model], int], limit: int = WAVE_BYTES):
    """Split models, kept in order of data set, into groups of bounded size."""
    wave, used = [], 0
    for model in models:
        need = size(model)
        if wave and used + need > limit:
            yield wave
            wave, used = [], 0
        wave.append(model)
        used += need
    if wave:
        yield wave


# ---- training data -----------------------------------------------------------------

_BLOCKS = T.StructType(
    [
        T.StructField("portion", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("x", T.BinaryType()),
        T.StructField("y", T.BinaryType()),
        T.StructField("fold", T.BinaryType()),
        T.StructField("key", T.BinaryType()),
    ]
)


def blocks(rows: DataFrame, counts: pd.DataFrame) -> DataFrame:
    """Training conformers as matrices: one row per data set and Arrow batch.

    Training rows are usually a small part of a table and are passed over many
    times, so they are once spread evenly over as many tasks as their size asks
    for, at most the session's number of shuffle partitions.
    ``key`` is a hash of each conformer's identity, a random number that does not
    depend on where the row lies.
    """
    schema = T.StructType([rows.schema["target"], *_BLOCKS.fields])
    size = 8 * int((counts["n"] * counts["width"]).sum())
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(1, -(-size // _TASK_BYTES)), most)
    flat = rows.repartition(tasks, "target", "portion", "mol_id").select(
        "target",
        F.col("portion").cast("double").alias("portion"),
        F.col("fold").cast("int").alias("fold"),
        F.col("active").cast("double").alias("y"),
        F.col("conformers.features").alias("rows"),
        F.transform("conformers", lambda c: F.xxhash64("target", "mol_id", c["conf_id"])).alias("keys"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (target, portion), index in by_key(batch, ["target", "portion"]):
                part = batch.take(pa.array(index))
                x, counts = matrix(part.column("rows"))
                keys = part.column("keys").flatten().to_numpy(zero_copy_only=False)
                per_molecule = lambda name: np.repeat(
                    part.column(name).to_numpy(zero_copy_only=False), counts
                )
                row = {
                    "target": pa.array([target], batch.schema.field("target").type),
                    "portion": pa.array([portion]),
                    "width": pa.array([x.shape[1]], pa.int32()),
                    "x": [np.ascontiguousarray(x, dtype=np.float64).tobytes()],
                    "y": [(per_molecule("y") * ACTIVE_VALUE).tobytes()],
                    "fold": [per_molecule("fold").astype(np.int32).tobytes()],
                    "key": [keys.astype(np.int64).tobytes()],
                }
                yield pa.RecordBatch.from_pydict(row)

    return flat.mapInArrow(run, schema)


def each_block(batches: Iterator[pa.RecordBatch]):
    """Decode block rows: ((target, portion), x, y, fold, key)."""
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["x"]).reshape(-1, row["width"])
            yield (
                (row["target"], row["portion"]),
                x,
                np.frombuffer(row["y"]),
                np.frombuffer(row["fold"], dtype=np.int32),
                np.frombuffer(row["key"], dtype=np.int64),
            )


# ---- one training pass -------------------------------------------------------------

Step = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def accumulate(data: DataFrame, models: list[Model], step: Step) -> list[np.ndarray]:
    """Sum ``step(state, x, y, key)`` over the training rows of every model."""
    spark = data.sparkSession
    by_dataset: dict[tuple, list] = {}
    for i, m in enumerate(models):
        by_dataset.setdefault((m.target, m.portion), []).append((i, m.fold, m.state))
    shared = spark.sparkContext.broadcast(by_dataset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dataset, x, y, fold, key in each_block(batches):
            for i, held_out, state in shared.value.get(dataset, ()):
                use = trains(fold, held_out)
                part = step(state, x[use], y[use], key[use])
                sums[i] = sums[i] + part if i in sums else part
        part_id = TaskContext.get().partitionId()
        for i, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "model": pa.array([i], pa.int32()),
                    "part": pa.array([part_id], pa.int32()),
                    "sums": pa.array([total.astype(np.float64).tobytes()], pa.binary()),
                }
            )

    partial = data.mapInArrow(run, "model int, part int, sums binary")
    parts = data.rdd.getNumPartitions()
    expected = 3 * sum(m.nbytes for m in models) * parts
    while parts > 1 and expected > _DIRECT_BYTES:
        # Rounds of bounded groups instead of one group of all partial sums.
        parts = -(-parts // _FAN_IN)
        partial = (
            partial.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
            .groupBy("model", "part")
            .applyInPandas(_add_up, "model int, part int, sums binary")
        )
    out: list[np.ndarray | None] = [None] * len(models)
    for row in partial.collect():
        values = np.frombuffer(row["sums"])
        out[row["model"]] = values if out[row["model"]] is None else out[row["model"]] + values
    shared.unpersist()
    return out


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(s) for s in group["sums"])
    return pd.DataFrame(
        {"model": group["model"][:1], "part": group["part"][:1], "sums": [total.tobytes()]}
    )


# ---- model tables ------------------------------------------------------------------


def model_schema(target: T.StructField) -> T.StructType:
    return T.StructType(
        [
            target,
            T.StructField("portion", T.DoubleType()),
            T.StructField("param", T.IntegerType()),
            T.StructField("fold", T.IntegerType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("n_iter", T.IntegerType()),
            T.StructField("objective", T.DoubleType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )


def model_row(m: Model, payload: bytes | None) -> tuple:
    """A model as a row of its table."""
    status = m.state.get("status", "skipped") if payload is None else "ok"
    objective = float(m.state.get("objective", float("nan")))
    return (m.target, m.portion, m.param, m.fold, m.n_rows, status, int(m.state.get("n_iter", 0)), objective, payload)


class ModelTable:
    """Collects trained models wave by wave in a stored table."""

    def __init__(self, data: DataFrame, name: str):
        self.spark: SparkSession = data.sparkSession
        self.schema = model_schema(data.schema["target"])
        self.table = StagedTable(self.spark, name)

    def append(self, models: list[Model], payload: Callable[[Model], bytes | None]) -> None:
        rows = [model_row(m, payload(m)) for m in models]
        if rows:
            self.table.append(self.spark.createDataFrame(rows, self.schema).coalesce(1))

    def read(self) -> DataFrame:
        if self.table.schema is None:
            return self.spark.createDataFrame([], self.schema)
        return self.table.read()


# ---- scoring -----------------------------------------------------------------------

#: Bytes of candidates scored together, and of a model that a task holds at once.
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Decoded models a task keeps.
_DECODED = 8


@dataclass
class Pieces:
    """How a model is scored in parts.

    ``cut`` divides a payload into payloads of at most so many bytes; ``part`` gives an array for the
    rows from one of them, perhaps with more numbers behind; ``merge`` joins the arrays of all parts
    and ``finish`` makes scores of the result.
    """

    cut: Callable[[bytes, int], list[bytes]]
    part: Callable[[object, np.ndarray], np.ndarray]
    merge: Callable[[list[np.ndarray]], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def score_molecules(
    dataset: DataFrame,
    models: DataFrame,
    decode: Callable[[bytes], object],
    row_scores: Callable[[object, np.ndarray], np.ndarray],
    reduce: str = "max",
    pieces: Pieces | None = None,
) -> DataFrame:
    """Score each molecule with the models of its target, portion and fold.

    A molecule's score is the ``max``, ``min`` or ``mean`` of its conformers' scores.  Molecules are
    packed into chunks of bounded size.  Models of at most WAVE_BYTES together are broadcast to chunks made
    where the molecules lie, in one scan.  Otherwise each chunk costs a copy of its models, so molecules
    of a data set first meet in pieces of about CHUNK_BYTES, and models are joined by data set and
    piece.  Models of more than SHARD_BYTES are cut; the parts of a chunk's scores meet by chunk.
    """
    if reduce not in REDUCTIONS:
        raise ValueError(f"reduce is one of {', '.join(REDUCTIONS)}")
    bound_batches(dataset.sparkSession)
    key = ["target", "portion", "fold"]
    trained = models.filter(F.col("status") == "ok").select(*key, "param", "payload")
    total, largest = (n or 0 for n in trained.agg(F.sum(F.length("payload")), F.max(F.length("payload"))).first())
    candidates = _candidates(dataset)
    sizes = None if total <= WAVE_BYTES else _piece_counts(candidates, key)
    on = key if sizes is None else [*key, "piece"]
    chunks = _chunks(candidates, key, sizes)
    schema = T.StructType(
        [
            chunks.schema["target"],
            T.StructField("portion", T.DoubleType()),
            T.StructField("param", T.IntegerType()),
            T.StructField("fold", T.IntegerType()),
            T.StructField("mol_id", chunks.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
            T.StructField("truth", T.BooleanType()),
        ]
    )

    def placed(models: DataFrame) -> DataFrame:
        """Models where their chunks are: everywhere, or once for each piece of their data set."""
        if sizes is None:
            return F.broadcast(models)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
        return models.join(F.broadcast(sizes), key).withColumn("piece", every).drop("pieces")

    if not pieces or largest <= SHARD_BYTES:
        return chunks.join(placed(trained), on).mapInArrow(_scorer(decode, row_scores, reduce), schema)
    parts = T.StructType(
        [
            *(f for f in chunks.schema.fields if f.name not in ("values", "width")),
            T.StructField("param", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("part", T.BinaryType()),
        ]
    )
    shards = trained.mapInArrow(
        _cutter(pieces.cut, SHARD_BYTES),
        T.StructType([*trained.schema.fields, T.StructField("shard", T.IntegerType())]),
    )
    scored = chunks.join(placed(shards), on).mapInArrow(_part_scorer(decode, pieces.part, parts.names), parts)
    return scored.groupBy(*key, "param", "chunk").applyInArrow(_merger(pieces, reduce, schema.names), schema)


def _candidates(dataset: DataFrame) -> DataFrame:
    """Molecules with conformers, as they are scored."""
    return dataset.select(
        "target",
        F.col("portion").cast("double").alias("portion"),
        F.col("fold").cast("int").alias("fold"),
        "mol_id",
        F.col("active").alias("truth"),
        F.col("conformers.features").alias("rows"),
    ).filter(F.size("rows") > 0)


def _piece_counts(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Pieces of about CHUNK_BYTES of each data set, as a small table that is made once."""
    values = F.aggregate("rows", F.lit(0), lambda n, row: n + F.size(row))
    pieces = F.greatest(F.lit(1), F.ceil(8 * F.sum(values) / F.lit(CHUNK_BYTES))).cast("long").alias("pieces")
    counts = candidates.groupBy(*key).agg(pieces)
    return candidates.sparkSession.createDataFrame(counts.collect(), counts.schema)


def _chunks(candidates: DataFrame, key: list[str], sizes: DataFrame | None) -> DataFrame:
    """Molecules packed: one row per chunk of a target, portion and fold, and of a ``piece`` of them where
    ``sizes`` says how many there are."""
    whole = list(key)
    if sizes is not None:
        own = F.pmod(F.xxhash64("mol_id"), F.col("pieces")).alias("piece")
        candidates = candidates.join(F.broadcast(sizes), key).select(*candidates.columns, own)
        whole.append("piece")
        candidates = candidates.repartition(*whole).sortWithinPartitions(*whole)
    schema = T.StructType(
        [
            *(candidates.schema[c] for c in whole),
            T.StructField("chunk", T.LongType()),
            T.StructField("ids", T.ArrayType(candidates.schema["mol_id"].dataType)),
            T.StructField("truth", T.ArrayType(T.BooleanType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("width", T.IntegerType()),
            T.StructField("values", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            groups = pack(batch, whole, "mol_id", "rows")
            for name, index in by_key(batch, whole):
                group, truth, at = groups[name], batch.column("truth").take(pa.array(index)), 0
                for piece in group.pieces(max(1, CHUNK_BYTES // (8 * max(1, group.values.shape[1])))):
                    n = len(piece)
                    counts = np.diff(np.append(piece.starts, len(piece.values)))
                    one = [
                        *([x] for x in name),
                        [chunk],
                        [piece.ids.to_pylist()],
                        [truth.slice(at, n).to_pylist()],
                        [counts.astype(np.int32)],
                        [piece.values.shape[1]],
                        [np.ascontiguousarray(piece.values, np.float64).tobytes()],
                    ]
                    kinds = [*(batch.schema.field(c).type for c in whole), pa.int64()]
                    kinds += [pa.list_(batch.schema.field("mol_id").type), pa.list_(pa.bool_()), pa.list_(pa.int32())]
                    kinds += [pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)], schema.names)
                    chunk, at = chunk + 1, at + n

    return candidates.mapInArrow(run, schema)


def _rows_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["values"]).reshape(-1, row["width"])


def _decoder(decode: Callable[[bytes], object]):
    """Decode with a few models kept; equal payloads are one model."""
    held: dict[bytes, object] = {}

    def get(payload: bytes):
        if payload not in held:
            while len(held) >= _DECODED:
                held.pop(next(iter(held)))
            held[payload] = decode(payload)
        return held[payload]

    return get


def _per_molecule(scores: np.ndarray, counts: np.ndarray, reduce: str) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    found = REDUCTIONS[reduce].reduceat(scores, starts)
    return found / counts if reduce == "mean" else found


def _result(row: dict, scores: np.ndarray, reduce: str, names: list[str], id_type: pa.DataType, target_type: pa.DataType):
    n = len(row["ids"])
    same = lambda c, kind: pa.array([row[c]] * n, kind)
    per_molecule = _per_molecule(scores, np.array(row["counts"]), reduce)
    return [
        same("target", target_type),
        same("portion", pa.float64()),
        same("param", pa.int32()),
        same("fold", pa.int32()),
        pa.array(row["ids"], id_type),
        pa.array(per_molecule),
        pa.array(row["truth"], pa.bool_()),
    ]


def _types(schema: pa.Schema) -> tuple[pa.DataType, pa.DataType]:
    return schema.field("ids").type.value_type, schema.field("target").type


def _scorer(decode, row_scores, reduce):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _decoder(decode)
        names = ["target", "portion", "param", "fold", "mol_id", "score", "truth"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                scores = row_scores(get(row["payload"]), _rows_of(row))
                yield pa.RecordBatch.from_arrays(_result(row, scores, reduce, names, *_types(batch.schema)), names)

    return run


def _cutter(cut, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("payload")
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                for shard, payload in enumerate(cut(one.column(place)[0].as_py(), limit)):
                    columns = [pa.array([payload], c.type) if k == place else c for k, c in enumerate(one.columns)]
                    columns.append(pa.array([shard], pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard"])

    return run


def _part_scorer(decode, part, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _decoder(decode)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                found = part(get(row["payload"]), _rows_of(row)).astype(np.float64).tobytes()
                columns = {c: one.column(c) for c in names if c != "part"} | {"part": pa.array([found], pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return run


def _merger(pieces: Pieces, reduce: str, names: list[str]):
    def run(group: pa.Table) -> pa.Table:
        shards = group.sort_by("shard")
        parts = [np.frombuffer(p) for p in shards.column("part").to_pylist()]
        row = group.slice(0, 1).drop(["part"]).to_pylist()[0]
        return pa.table(_result(row, pieces.finish(pieces.merge(parts)), reduce, names, *_types(group.schema)), names=names)

    return run


def as_dataset(molecules: DataFrame, portion: float = 1.0, fold: int = -1) -> DataFrame:
    """Treat whole molecules as one data set per target."""
    return molecules.withColumn("portion", F.lit(float(portion))).withColumn("fold", F.lit(fold))
