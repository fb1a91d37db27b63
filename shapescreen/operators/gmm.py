"""Gaussian mixtures: one per target and data set, or one per molecule.

Expectation-maximisation works on sums of responsibilities, weighted rows and weighted products,
inside a task or over all tasks that hold rows of a data set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapescreen.functions.packed import matrix, nested
from shapescreen.operators.models import Model, Pieces, score_molecules
from shapescreen.operators.training import Trainer, train

# The component grid and the solver defaults of the measured models.
COMPONENTS = (1, 10, 50, 100, 1000)
TOLERANCE = 1e-3
MAX_ITER = 100
REG_COVAR = 1e-6

# Conformers of each fold that a mixture starts from, at least; four per component if more.
START_ROWS = 2048

_KMEANS_STEPS = 10
_CELLS = 1 << 22
# Rows times components up to which components are taken one by one, and what the rounding of a
# quadratic form may come to.
_FEW_CELLS, _ROUNDING = 1 << 10, 1e-6


# ---- numeric core, on one block or one molecule --------------------------------------


def _finish(weights, means, spread):
    """Precision factors of a mixture: ``full`` covariances are (k, d, d), ``diag`` variances (k, d)."""
    if spread.ndim == 2:
        return {"w": weights, "mu": means, "s": spread, "root": 1.0 / np.sqrt(spread)}
    chol = np.linalg.cholesky(spread)
    eye = np.broadcast_to(np.eye(spread.shape[-1]), spread.shape)
    return {"w": weights, "mu": means, "s": spread, "root": np.swapaxes(np.linalg.solve(chol, eye), 1, 2)}


def log_density(mix: dict, x: np.ndarray) -> np.ndarray:
    """Log of weight times density, rows by components."""
    root, mu = mix["root"], mix["mu"]
    d = mu.shape[1]
    diagonal = root if root.ndim == 2 else np.diagonal(root, axis1=1, axis2=2)
    with np.errstate(divide="ignore"):
        level = np.log(diagonal).sum(1) - 0.5 * d * np.log(2 * np.pi) + np.log(mix["w"])
    out = _expanded_forms(root, mu, x) if len(x) * len(mu) > _FEW_CELLS else None
    if out is None:
        out = np.empty((len(x), len(mu)))
        for j in range(len(mu)):
            scaled = (x - mu[j]) * root[j] if root.ndim == 2 else (x - mu[j]) @ root[j]
            out[:, j] = (scaled**2).sum(1)
    out *= -0.5
    out += level
    return out


def _expanded_forms(root: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Quadratic forms of all rows and components as one matrix product of squares and factors.

    None if terms that cancel are so large that rounding could show.
    """
    middle = mu.mean(0)
    x, mu = x - middle, mu - middle
    if root.ndim == 2:
        precision = root * root
        squares, second, first = x * x, precision, precision * mu
    else:
        i, j = np.triu_indices(mu.shape[1])
        precision = root @ np.swapaxes(root, 1, 2)
        squares, second = x[:, i] * x[:, j], precision[:, i, j] * np.where(i == j, 1.0, 2.0)
        first = np.einsum("kde,ke->kd", precision, mu)
    rest = (first * mu).sum(1)
    terms, factors = np.concatenate([squares, x], axis=1), np.concatenate([second, -2.0 * first], axis=1)
    length = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v).max())
    if not np.finfo(float).eps * (length(terms) * length(factors) + rest.max()) <= _ROUNDING:
        return None
    out = terms @ factors.T
    out += rest
    return np.maximum(out, 0.0, out=out)


def row_log_likelihood(mix: dict, x: np.ndarray) -> np.ndarray:
    """Log density of each row, computed in pieces of bounded memory."""
    out = np.empty(len(x))
    step = _rows_at_once(*mix["mu"].shape)
    for lo in range(0, len(x), step):
        logs = log_density(mix, x[lo : lo + step])
        top = logs.max(1)
        logs -= top[:, None]
        out[lo : lo + step] = top + np.log(np.exp(logs, out=logs).sum(1))
    return out


def _rows_at_once(k: int, d: int) -> int:
    """Rows whose densities, and products of features, have about _CELLS numbers."""
    return max(1, _CELLS // max(k, d * (d + 3) // 2))


def _statistics(resp: np.ndarray, x: np.ndarray, full: bool):
    first = resp.T @ x
    if full and resp.size > _FEW_CELLS:
        i, j = np.triu_indices(x.shape[1])
        half = resp.T @ (x[:, i] * x[:, j])
        second = np.empty((resp.shape[1], x.shape[1], x.shape[1]))
        second[:, i, j] = second[:, j, i] = half
    elif full:
        second = np.stack([(x * resp[:, j : j + 1]).T @ x for j in range(resp.shape[1])])
    else:
        second = resp.T @ (x * x)
    return resp.sum(0), first, second


def _maximise(weight_sums, first, second):
    """New parameters from sums over rows."""
    sums = weight_sums + 10 * np.finfo(float).eps
    means = first / sums[:, None]
    if second.ndim == 3:
        spread = second / sums[:, None, None] - means[:, :, None] * means[:, None, :]
        spread = (spread + np.swapaxes(spread, 1, 2)) / 2
        idx = np.arange(spread.shape[1])
        spread[:, idx, idx] = np.maximum(spread[:, idx, idx], 0) + REG_COVAR
    else:
        spread = np.maximum(second / sums[:, None] - means**2, 0) + REG_COVAR
    return sums / sums.sum(), means, spread


def _start(x: np.ndarray, k: int, full: bool, seed: int) -> dict:
    """Starting mixture: seeded distance-weighted centres, a few k-means steps, one maximisation."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None].copy()
    nearest = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = nearest.sum()
        pick = rng.choice(len(x), p=nearest / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
        nearest = np.minimum(nearest, ((x - x[pick]) ** 2).sum(1))
    label = np.zeros(len(x), dtype=int)
    for _ in range(_KMEANS_STEPS):
        gap = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]
        label = gap.argmin(1)
        for j in np.unique(label):
            centres[j] = x[label == j].mean(0)
    resp = np.zeros((len(x), k))
    resp[np.arange(len(x)), label] = 1.0
    shift = x.mean(0)
    w, mu, s = _maximise(*_statistics(resp, x - shift, full))
    return _finish(w, mu + shift, s) | {"shift": shift}


def _encode(mix: dict) -> bytes:
    k, d = mix["mu"].shape
    head = np.array([k, d, mix["s"].ndim], dtype=np.float64)
    return np.concatenate([head, mix["w"], mix["mu"].ravel(), mix["s"].ravel()]).tobytes()


def decode(payload: bytes) -> dict:
    flat = np.frombuffer(payload)
    k, d, dims = (int(v) for v in flat[:3])
    w, rest = flat[3 : 3 + k], flat[3 + k :]
    mu, s = rest[: k * d].reshape(k, d), rest[k * d :]
    return _finish(w, mu, s.reshape((k, d, d) if dims == 3 else (k, d)))


# ---- one model per data set -----------------------------------------------------------


def fit(
    rows: DataFrame,
    components=COMPONENTS,
    folds=(-1,),
    covariance: str = "full",
    tol: float = TOLERANCE,
    max_iter: int = MAX_ITER,
    seed: int = 0,
    chosen: dict | None = None,
    start_rows: int = START_ROWS,
    task_data: int | None = None,
) -> DataFrame:
    """Fit mixtures for all targets, portions, component counts and folds of training ``rows``.

    A mixture starts from ``max(start_rows, 4 * components)`` random conformers of each fold; all
    conformers take part in every step after that.  The start of a model depends on nothing but
    its own data, components and seed.  A model with no more rows than components is listed as skipped, one whose
    covariance breaks down as failed.  ``task_data``: bytes of rows up to which a data set is trained
    on inside a task (:mod:`training`).
    """
    trainer = mixture_trainer(covariance, tol, max_iter, seed, start_rows)
    return train(rows, components, folds, trainer, chosen, task_data)


def mixture_trainer(
    covariance: str = "full",
    tol: float = TOLERANCE,
    max_iter: int = MAX_ITER,
    seed: int = 0,
    start_rows: int = START_ROWS,
) -> Trainer:
    full = covariance == "full"
    per_component = lambda width: 8 * (2 * width * width if full else 2 * width) + 8 * (width + 1)

    def start(model: Model, sample: np.ndarray, _) -> None:
        mix = _start(sample, model.param, full, seed + 1)
        if not np.isfinite(mix["root"]).all():
            raise np.linalg.LinAlgError("a start that is not finite")
        model.state = mix | {"objective": -np.inf, "n_iter": 0}

    return Trainer(
        "gmm",
        start,
        _expectation,
        lambda model, sums, iteration: _update(model, sums, full, tol, iteration),
        lambda model: _encode(model.state),
        lambda model: model.param * per_component(model.width),
        range(1, max_iter + 1),
        sample=lambda model: max(start_rows, 4 * model.param),
        seed=seed,
        skips=lambda model: model.n_rows <= model.param,
    )


def _expectation(state: dict, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    k, d = state["mu"].shape
    full = state["s"].ndim == 3
    total = np.zeros(k + k * d + k * d * (d if full else 1) + 2)
    step = _rows_at_once(k, d)
    for lo in range(0, len(x), step):
        piece = x[lo : lo + step]
        resp = log_density(state, piece)
        top = resp.max(1)
        resp -= top[:, None]
        whole = np.exp(resp, out=resp).sum(1)
        likelihood = top + np.log(whole)
        resp /= whole[:, None]
        n, first, second = _statistics(resp, piece - state["shift"], full)
        total += np.concatenate([n, first.ravel(), second.ravel(), [likelihood.sum(), len(piece)]])
    return total


def _update(model: Model, sums: np.ndarray, full: bool, tol: float, iteration: int) -> bool:
    """Maximisation step; true when the mean log likelihood gains less than ``tol`` or it failed."""
    if not np.isfinite(sums).all():
        model.fail()
        return True
    k, d = model.state["mu"].shape
    n, first, second = sums[:k], sums[k : k + k * d], sums[k + k * d : -2]
    likelihood = sums[-2] / sums[-1]
    w, mu, s = _maximise(
        n, first.reshape(k, d), second.reshape((k, d, d) if full else (k, d))
    )
    shift, before = model.state["shift"], model.state["objective"]
    try:
        mix = _finish(w, mu + shift, s)
    except np.linalg.LinAlgError:
        model.fail()
        return True
    model.state = mix | {
        "shift": shift,
        "objective": likelihood,
        "n_iter": iteration,
    }
    return abs(likelihood - before) < tol


def _cut(payload: bytes, limit: int) -> list[bytes]:
    """Ranges of components, with their weights in the whole mixture."""
    flat = np.frombuffer(payload)
    k, d, dims = (int(v) for v in flat[:3])
    w, mu, s = flat[3 : 3 + k], flat[3 + k : 3 + k + k * d].reshape(k, d), flat[3 + k + k * d :].reshape(k, -1)
    step = max(1, limit * k // len(payload))
    ranges = (slice(i, i + step) for i in range(0, k, step))
    shape = lambda v: v.reshape((-1, d, d) if dims == 3 else (-1, d))
    return [_encode({"w": w[r], "mu": mu[r], "s": shape(s[r])}) for r in ranges]


# Densities of parts of a mixture add up.
_PIECES = Pieces(_cut, row_log_likelihood, lambda parts: np.logaddexp.reduce(parts), lambda whole: whole)


def score(dataset: DataFrame, models: DataFrame) -> DataFrame:
    """Mean log density of each molecule's conformers."""
    return score_molecules(dataset, models, decode, row_log_likelihood, "mean", _PIECES)


def components(models: DataFrame) -> DataFrame:
    """Trained mixtures as rows: weight, mean and covariance per component."""
    keys = ["target", "portion", "param", "fold"]
    schema = T.StructType(
        [
            *[models.schema[c] for c in keys],
            T.StructField("comp", T.IntegerType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("cov", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                mix = decode(row.payload)
                for j in range(len(mix["w"])):
                    cov = mix["s"][j] if mix["s"].ndim == 3 else np.diag(mix["s"][j])
                    yield pd.DataFrame(
                        [[*[getattr(row, c) for c in keys], j, mix["w"][j], mix["mu"][j].tolist(), cov.tolist()]],
                        columns=schema.names,
                    )

    trained = models.filter(F.col("status") == "ok").select(*keys, "payload")
    return trained.mapInPandas(run, schema)


# ---- one small mixture per molecule -----------------------------------------------------


def component_rule(n_rot: Column) -> Column:
    """Components of a molecule's own mixture: four per rotatable bond, at least four."""
    return F.greatest(n_rot, F.lit(1)) * 4


def fit_molecule(x: np.ndarray, k: int, full: bool, seed: int = 0) -> dict:
    """Mixture of one molecule; with fewer conformers than components one component each."""
    mix = _start(x, min(k, len(x)), full, seed)
    shift, before = mix["shift"], -np.inf
    for _ in range(MAX_ITER):
        logs = log_density(mix, x)
        top = logs.max(1)
        likelihood = top + np.log(np.exp(logs - top[:, None]).sum(1))
        resp = np.exp(logs - likelihood[:, None])
        w, mu, s = _maximise(*_statistics(resp, x - shift, full))
        mix = _finish(w, mu + shift, s)
        now = likelihood.mean()
        if abs(now - before) < TOLERANCE:
            break
        before = now
    return mix


def mixture_status(molecules: DataFrame, k: Column | None = None) -> DataFrame:
    """Components that each molecule's mixture asks for, its conformers, and whether they suffice:
    ``ok``, ``short`` or ``empty``."""
    wanted = component_rule(F.col("n_rot")) if k is None else k
    return molecules.select(
        "target", "mol_id", wanted.cast("int").alias("k"), F.size("conformers").alias("conformers")
    ).withColumn(
        "status",
        F.when(F.col("conformers") < 1, "empty").when(F.col("conformers") < F.col("k"), "short").otherwise("ok"),
    )


def molecule_mixtures(
    molecules: DataFrame, covariance: str = "full", k: Column | None = None, short: str = "shrink"
) -> DataFrame:
    """Replace conformers by ``rows``: one packed row per mixture component.

    Fits are independent, one molecule per row, so there is no shuffle.  ``short`` says what becomes
    of molecules with fewer conformers than components (:func:`mixture_status` lists them):
    ``shrink`` gives them one component per conformer, ``reject`` leaves them out.
    """
    if short not in ("shrink", "reject"):
        raise ValueError("short is 'shrink' or 'reject'")
    full = covariance == "full"
    k = component_rule(F.col("n_rot")) if k is None else k
    plain = molecules.select(
        "target", "mol_id", "active", k.cast("int").alias("k"), F.col("conformers.features").alias("x")
    ).filter(F.size("x") > 0)
    if short == "reject":
        plain = plain.filter(F.size("x") >= F.col("k"))
    schema = T.StructType(
        [
            *[plain.schema[c] for c in ("target", "mol_id", "active")],
            T.StructField("rows", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, last, mix = None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values, counts = matrix(batch.column("x"))
            packed, sizes = [], []
            for x, k in zip(np.split(values, np.cumsum(counts)[:-1]), batch.column("k").to_pylist()):
                # A molecule's rows for its targets follow each other and have one mixture.
                if k != last or not np.array_equal(x, fitted):
                    mix, fitted, last = fit_molecule(x, k, full), x, k
                sizes.append(len(mix["w"]))
                parts = [mix["w"][:, None], mix["mu"], mix["s"].reshape(sizes[-1], -1)]
                packed.append(np.concatenate(parts, axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("target"),
                    batch.column("mol_id"),
                    batch.column("active"),
                    nested(np.concatenate(packed), np.array(sizes)),
                ],
                ["target", "mol_id", "active", "rows"],
            )

    return plain.mapInArrow(run, schema)


def screen_mixtures(
    mixtures: DataFrame, kernel, max_broadcast: int | None = None
) -> DataFrame:
    """Score all molecules against the active ones of their target by a mixture kernel.

    ``mixtures`` comes from :func:`molecule_mixtures`; store it first, as it is read twice.
    """
    from shapescreen.operators.screening import MAX_BROADCAST_TEMPLATES, score_pairs

    return score_pairs(
        mixtures.filter(F.col("active")).select("target", F.col("mol_id").alias("template_id"), "rows"),
        mixtures.select("target", "mol_id", F.col("active").alias("truth"), "rows"),
        kernel,
        MAX_BROADCAST_TEMPLATES if max_broadcast is None else max_broadcast,
    )
