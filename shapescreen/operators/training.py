"""Training of many models where their data are.

A data set is the training rows of one target and portion.  One that fits a task is brought to tasks
as a whole, and its models train there from start to end: a single job for any number of targets,
parameters and folds, and neither parameters nor sums ever reach the driver.  The models of a data
set are dealt to as many slots as their cost asks for; each slot gets a copy of its rows.

Larger data sets stay spread over tasks.  Each step is a pass that adds up sums per model, for waves of
models of bounded size (:func:`models.accumulate`).

Both ways take the same steps from the same start, so they give the same models but for the order of
additions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shapescreen.functions.packed import matrix
from shapescreen.operators.models import (
    ACTIVE_VALUE,
    Model,
    ModelTable,
    accumulate,
    blocks,
    each_block,
    model_grid,
    model_row,
    row_counts,
    trains,
    waves,
)

#: Bytes of training rows that one task trains on, and multiplications that one slot is given.
TASK_DATA, SLOT_COST = 32 << 20, 1 << 31
#: Rows that a step looks at together.
_PIECE = 1 << 13


@dataclass
class Trainer:
    """How a kind of model learns.  ``name`` names its stored table.

    ``start(model, sample, moments)`` sets the model's first state; ``step`` gives the sums of a state
    over some rows; ``update(model, sums, iteration)`` takes one step and says whether it was the
    last; ``encode`` stores the state.
    """

    name: str
    start: Callable[[Model, np.ndarray | None, np.ndarray | None], None]
    step: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    update: Callable[[Model, np.ndarray, int], bool]
    encode: Callable[[Model], bytes]
    #: Bytes of a model's parameters.
    size: Callable[[Model], int]
    iterations: range
    #: Sums over all rows that the start needs.
    moments: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    #: Random rows of each fold that the start needs.
    sample: Callable[[Model], int] | None = None
    seed: int = 0
    #: Models that can't be trained on so few rows.
    skips: Callable[[Model], bool] = lambda m: m.n_rows == 0


def drawn(key: np.ndarray, seed: int) -> np.ndarray:
    """A seeded random number for each row, of its key."""
    with np.errstate(over="ignore"):
        # Odd constants of a public 64-bit mixing function.
        z = key.astype(np.int64).view(np.uint64) ^ (np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def first_rows(order: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    """Of each fold the ``size`` rows of lowest order, as row numbers in that order."""
    by = np.lexsort((order, fold))
    starts = np.flatnonzero(np.append(True, np.diff(fold[by]) != 0)) if len(by) else np.zeros(0, int)
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    kept = by[nth < size]
    return kept[np.argsort(order[kept], kind="stable")]


def train_here(model: Model, trainer: Trainer, x: np.ndarray, y: np.ndarray, fold: np.ndarray, key: np.ndarray) -> None:
    """Train one model on rows at hand, from start to end."""
    use = np.flatnonzero(trains(fold, model.fold))
    sample = None
    if trainer.sample:
        order = drawn(key[use], trainer.seed)
        sample = x[use[first_rows(order, fold[use], trainer.sample(model))]]
    x, y, key = x[use], y[use], key[use]

    def summed(step, state):
        parts = (step(state, x[i : i + _PIECE], y[i : i + _PIECE], key[i : i + _PIECE]) for i in range(0, len(x), _PIECE))
        return sum(parts)

    with np.errstate(all="ignore"):
        try:
            trainer.start(model, sample, summed(trainer.moments, {}) if trainer.moments else None)
        except np.linalg.LinAlgError:
            model.fail()
        for iteration in trainer.iterations:
            if model.failed or trainer.update(model, summed(trainer.step, model.state), iteration):
                break


def fits_a_task(counts, limit: int) -> dict[tuple, bool]:
    """Whether the rows of each (target, portion) are at most ``limit`` bytes."""
    sizes = counts.assign(size=8 * counts["n"] * counts["width"]).groupby(["target", "portion"])["size"].sum()
    return {name: size <= limit for name, size in sizes.items()}


def train(
    rows: DataFrame, params, folds, trainer: Trainer, chosen: dict | None = None, task_data: int | None = None
) -> DataFrame:
    """Models for all targets, portions, parameters and folds of training ``rows``, as a stored table."""
    limit = TASK_DATA if task_data is None else task_data
    counts = row_counts(rows)
    grid = model_grid(counts, params, folds, chosen)
    table = ModelTable(rows, trainer.name)
    table.append([m for m in grid if trainer.skips(m)], lambda m: None)
    todo = [m for m in grid if not trainer.skips(m)]
    fits = fits_a_task(counts, limit)
    small = [m for m in todo if fits[m.target, m.portion]]
    large = [m for m in todo if not fits[m.target, m.portion]]
    if small:
        table.table.append(_in_tasks(rows, small, trainer, table.schema))
    if large:
        _in_passes(rows, counts, large, trainer, table)
    return table.read()


# ---- data sets that fit a task ---------------------------------------------------------

_JOBS = "array<struct<param:int,fold:int,n_rows:bigint,width:int>>"


def _slots(models: list[Model], trainer: Trainer) -> list[tuple]:
    """``(target, portion, slot, jobs)``: each data set's models, dearest first, dealt to slots in turn."""
    by: dict[tuple, list[Model]] = {}
    for m in models:
        by.setdefault((m.target, m.portion), []).append(m)
    # Parameters stand for the work per row.
    cost = lambda m: m.n_rows * (trainer.size(m) // 8 + 1) * len(trainer.iterations)
    slots = []
    for (target, portion), own in by.items():
        own.sort(key=cost, reverse=True)
        many = min(len(own), max(1, -(-sum(map(cost, own)) // SLOT_COST)))
        for i in range(many):
            jobs = [(m.param, m.fold, m.n_rows, m.width) for m in own[i::many]]
            slots.append((target, portion, len(slots), jobs))
    return slots


def in_slots(rows: DataFrame, slots: list[tuple], jobs: str) -> DataFrame:
    """Rows of the data sets of ``slots`` (target, portion, slot number, jobs), a copy for each slot, one
    partition per slot: ``y, fold, rows, keys`` with the slot's ``target, portion, jobs``."""
    spark, portion = rows.sparkSession, F.col("portion").cast("double").alias("portion")
    names = [rows.schema["target"], T.StructField("portion", T.DoubleType()), T.StructField("slot", T.LongType())]
    table = spark.createDataFrame(slots, T.StructType([*names, T.StructField("jobs", T._parse_datatype_string(jobs))]))
    return (
        rows.select(
            "target",
            portion,
            F.col("fold").cast("int").alias("fold"),
            F.col("active").cast("double").alias("y"),
            F.col("conformers.features").alias("rows"),
            F.transform("conformers", lambda c: F.xxhash64("target", "mol_id", c["conf_id"])).alias("keys"),
        )
        .join(table, ["target", "portion"])
        .repartitionById(max(1, len(slots)), F.col("slot").cast("int"))
    )


def rows_in_order(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``x, y, fold, key`` of a slot's rows, in an order that doesn't depend on how they came."""
    x, counts = matrix(group.column("rows").combine_chunks())
    key = group.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    repeated = lambda name: np.repeat(group.column(name).to_numpy(), counts)
    y, fold = repeated("y") * ACTIVE_VALUE, repeated("fold")
    order = np.lexsort((*x.T[::-1], key))
    return np.ascontiguousarray(x[order], np.float64), y[order], fold[order], key[order]


def _in_tasks(rows: DataFrame, models: list[Model], trainer: Trainer, schema: T.StructType) -> DataFrame:
    data = in_slots(rows, _slots(models, trainer), _JOBS)

    def run(group: pa.Table) -> pa.Table:
        x, y, fold, key = rows_in_order(group)
        target, portion = group.column("target")[0].as_py(), group.column("portion")[0].as_py()
        out = []
        for job in group.column("jobs")[0].as_py():
            m = Model(target, portion, job["param"], job["fold"], job["n_rows"], job["width"])
            train_here(m, trainer, x, y, fold, key)
            out.append(model_row(m, None if m.failed else trainer.encode(m)))
        columns = [pa.array(values) for values in zip(*out)]
        kinds = [group.schema.field("target").type, *(pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.string())]
        kinds += [pa.int32(), pa.float64(), pa.binary()]
        return pa.table([c.cast(k) for c, k in zip(columns, kinds)], names=schema.names)

    return data.groupBy("slot").applyInArrow(run, schema)


# ---- larger data sets -------------------------------------------------------------------


def _in_passes(rows: DataFrame, counts, models: list[Model], trainer: Trainer, table: ModelTable) -> None:
    names = rows.sparkSession.createDataFrame(
        list({(m.target, m.portion) for m in models}), T.StructType(table.schema.fields[:2])
    )
    data = blocks(rows.join(names, ["target", "portion"], "left_semi"), counts).persist()
    try:
        for wave in waves(models, trainer.size):
            _start(data, wave, trainer)
            live = [m for m in wave if not m.failed]
            for iteration in trainer.iterations:
                if not live:
                    break
                sums = accumulate(data, live, trainer.step)
                live = [m for m, s in zip(live, sums) if not trainer.update(m, s, iteration) and not m.failed]
            table.append(wave, lambda m: None if m.failed else trainer.encode(m))
    finally:
        data.unpersist()


def _start(data: DataFrame, wave: list[Model], trainer: Trainer) -> None:
    moments = accumulate(data, wave, trainer.moments) if trainer.moments else [None] * len(wave)
    samples = _samples(data, wave, trainer) if trainer.sample else None
    for i, (m, s) in enumerate(zip(wave, moments)):
        if samples is None:
            trainer.start(m, None, s)
        elif i in samples:
            m.state = samples[i]
        else:
            m.fail()


def _samples(data: DataFrame, wave: list[Model], trainer: Trainer) -> dict[int, dict]:
    """Starting states from bounded samples, one group for each model."""
    wanted: dict[tuple, list] = {}
    for i, m in enumerate(wave):
        wanted.setdefault((m.target, m.portion), []).append((i, m))
    most = {name: max(trainer.sample(m) for _, m in own) for name, own in wanted.items()}
    target, portion = data.schema["target"], data.schema["portion"]
    schema = T.StructType(
        [
            target,
            portion,
            T.StructField("fold", T.IntegerType()),
            T.StructField("drawn", T.LongType()),
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("models", T.ArrayType(T.IntegerType())),
            T.StructField("most", T.IntegerType()),
        ]
    )

    kind = to_arrow_type(target.dataType)

    def pick(batches):
        for name, x, _, fold, key in each_block(batches):
            if name not in wanted:
                continue
            order = drawn(key, trainer.seed)
            kept = first_rows(order, fold, most[name])
            n = len(kept)
            yield pa.RecordBatch.from_pydict(
                {
                    "target": pa.array([name[0]] * n, kind),
                    "portion": pa.array([name[1]] * n),
                    "fold": pa.array(fold[kept]),
                    "drawn": pa.array(order[kept]),
                    "x": pa.array(list(x[kept]), pa.list_(pa.float64())),
                    "models": pa.array([[i for i, _ in wanted[name]]] * n, pa.list_(pa.int32())),
                    "most": pa.array([most[name]] * n, pa.int32()),
                }
            )

    nth = F.row_number().over(Window.partitionBy("target", "portion", "fold").orderBy("drawn"))
    sample = data.mapInArrow(pick, schema).withColumn("nth", nth).filter("nth <= most")

    def begin(group: pa.Table) -> pa.Table:
        i = group.column("model")[0].as_py()
        m = wave[i]
        fold, order = group.column("fold").to_numpy(), group.column("drawn").to_numpy()
        x = np.array(group.column("x").to_pylist())
        use = np.flatnonzero(trains(fold, m.fold))
        try:
            trainer.start(m, x[use[first_rows(order[use], fold[use], trainer.sample(m))]], None)
        except np.linalg.LinAlgError:
            return pa.table({"model": pa.array([], pa.int32()), "state": pa.array([], pa.binary())})
        return pa.table({"model": pa.array([i], pa.int32()), "state": [packed_state(m.state)]})

    started = (
        sample.select("fold", "drawn", "x", F.explode("models").alias("model"))
        .groupBy("model")
        .applyInArrow(begin, "model int, state binary")
    )
    return {row["model"]: unpacked_state(bytes(row["state"])) for row in started.collect()}


def packed_state(state: dict) -> bytes:
    """A state of arrays and numbers as bytes."""
    out = pa.BufferOutputStream()
    arrays = {k: np.asarray(v, np.float64) for k, v in state.items()}
    table = pa.table(
        {
            "name": list(arrays),
            "shape": [list(v.shape) for v in arrays.values()],
            "values": [v.ravel().tolist() for v in arrays.values()],
        }
    )
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked_state(raw: bytes) -> dict:
    rows = pa.ipc.open_stream(raw).read_all().to_pylist()
    found = {r["name"]: np.array(r["values"], np.float64).reshape(r["shape"]) for r in rows}
    return {k: v if v.ndim else float(v) for k, v in found.items()}
