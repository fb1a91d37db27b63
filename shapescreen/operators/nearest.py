"""The best candidates of every template, without the whole matrix.

Candidates of a task are cut into cells of neighbouring conformers, each with a centre and a radius.  By the
triangle inequality no conformer of a cell is nearer to a template than the centre's distance less
the radius, which bounds the similarity from above.  A task keeps the k best of each template so
far and passes over a cell for those templates whose kth best it cannot reach.  Distances to the others are
first taken between small integers, many to a machine word, which bounds them from below; only pairs that
may still enter are scored.  At most k rows per template leave a task; Spark ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.functions.packed import Packed, by_key, pack
from shapescreen.functions.similarity import best_shape_match
from shapescreen.operators.molecules import lowest_energy
from shapescreen.operators.ranking import top_k
from shapescreen.operators.screening import _ROWS_OUT, MAX_BROADCAST_TEMPLATES, _laid_out, unpacked

# Molecules of a cell, and pivots that cells gather around.
_CELL, _PIVOTS = 64, 32
# What rounding may add to a similarity.
_SLACK = 1e-8
# Largest grid distance, shares of values below the ends of the grid, and distances worked out together.
_MOST, _GRID = (1 << 15) - 1, (0.001, 0.999)
_BLOCK = 1 << 17


def screen_top(
    molecules: DataFrame,
    k: int,
    template_conformers: str = "all",
    digits: int = 9,
    keys: tuple[str, ...] = ("target",),
    max_broadcast: int = MAX_BROADCAST_TEMPLATES,
    pairs=None,
    skipped=None,
) -> DataFrame:
    """The k most similar molecules of each active of a target, with their ``position``.

    Scores are rounded to ``digits`` first; ties go to the smaller identifier.  ``pairs`` and
    ``skipped`` are accumulators that count all pairs and those that were passed over.
    """
    actives = molecules.filter(F.col("active"))
    if template_conformers == "lec":
        actives = lowest_energy(actives)
    features = F.col("conformers.features").alias("rows")
    best = _laid_out(
        actives.select(*keys, F.col("mol_id").alias("template_id"), features),
        molecules.select(*keys, "mol_id", F.col("active").alias("truth"), features),
        max_broadcast,
        list(keys),
        lambda shared, own: _against_all(shared, own, k, digits, pairs, skipped),
        lambda own: _chunk_by_chunk(own, k, digits, pairs, skipped),
    )
    return top_k(best, [*keys, "template_id"], k)


def cells(points: np.ndarray) -> Iterator[np.ndarray]:
    """Places of neighbouring points, at most _CELL together: each point belongs to the nearest of a few
    pivots that lie far apart, and those of one pivot are cut by their distance to it."""
    pivots = min(_PIVOTS, max(1, len(points) // 16))
    nearest, distance = np.zeros(len(points), int), np.abs(points - points[0]).sum(1)
    for p in range(1, pivots):
        gap = np.abs(points - points[distance.argmax()]).sum(1)
        closer = gap < distance
        nearest[closer], distance[closer] = p, gap[closer]
    for p in range(pivots):
        own = np.flatnonzero(nearest == p)
        own = own[np.argsort(distance[own], kind="stable")]
        yield from (own[i : i + _CELL] for i in range(0, len(own), _CELL))


class Coarse:
    """Vectors on a grid of small integers, whose distances bound the true ones from below.

    Values beyond the grid are moved to its border, which makes no distance larger; rounding adds at
    most a step per feature.
    """

    def __init__(self, values: np.ndarray):
        width = max(1, values.shape[1])
        self.low, self.high = np.quantile(values, _GRID, axis=0)
        self.step = float((self.high - self.low).max(initial=0.0)) / (_MOST // width) or 1.0
        self.off = width + 1

    def points(self, values: np.ndarray) -> np.ndarray:
        """One row per feature."""
        return np.rint((np.clip(values, self.low, self.high) - self.low) / self.step).astype(np.int16).T.copy()

    def limits(self, distances: np.ndarray) -> np.ndarray:
        """Grid distances that no smaller true distance exceeds."""
        return np.minimum(np.floor(distances / self.step) + self.off, _MOST).astype(np.int16)


def within(left: np.ndarray, right: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a column of ``left`` and one of ``right`` whose distance is at most the left one's limit."""
    found = []
    together = max(1, _BLOCK // max(1, left.shape[1]))
    for lo in range(0, right.shape[1], together):
        block = right[:, lo : lo + together]
        distance = np.zeros((block.shape[1], left.shape[1]), np.int16)
        gap = np.empty_like(distance)
        for own, other in zip(left, block):
            np.subtract(own[None], other[:, None], out=gap)
            np.abs(gap, out=gap)
            distance += gap
        at = np.flatnonzero(distance <= limits)
        found.append((at % left.shape[1], at // left.shape[1] + lo))
    return tuple(np.concatenate(v) for v in zip(*found))


def _by_identifier(ids: np.ndarray) -> np.ndarray:
    """Ascending order, nulls first."""
    if ids.dtype != object:
        return np.argsort(ids, kind="stable")
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), int)


def _names(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    names = np.empty(len(ids), object)
    names[:] = ids.to_pylist()
    return names


class Found:
    """The k best candidates so far of the templates of one chunk."""

    def __init__(self, templates: Packed, k: int, coarse: Coarse | None):
        self.coarse = coarse
        self.points = coarse.points(templates.values) if coarse else None
        self.scores = np.full((len(templates), k), -1.0)
        self.ids = np.zeros((len(templates), k), np.int64)
        self.truth = np.zeros((len(templates), k), object)

    def add(self, template: np.ndarray, scores: np.ndarray, ids: np.ndarray, truth: np.ndarray) -> None:
        """Take in scored pairs; ties go to the smaller identifier."""
        if not len(template):
            return
        k = self.scores.shape[1]
        if ids.dtype != self.ids.dtype:
            self.ids, ids = self.ids.astype(object), ids.astype(object)
            self.ids[self.scores < 0] = None
        some = np.unique(template)
        of = np.concatenate([np.repeat(some, k), template])
        scores = np.concatenate([self.scores[some].ravel(), scores])
        ids = np.concatenate([self.ids[some].ravel(), ids])
        truth = np.concatenate([self.truth[some].ravel(), truth])
        order = _by_identifier(ids)
        order = order[np.lexsort((-scores[order], of[order]))]
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        best = order[starts[:, None] + np.arange(k)]
        self.scores[some], self.ids[some], self.truth[some] = scores[best], ids[best], truth[best]


class Best:
    """The k best candidates of each template that a task has seen."""

    def __init__(self, k: int, digits: int, pairs=None, skipped=None):
        self.k, self.digits, self.pairs, self.skipped = k, digits, pairs, skipped
        self.found: dict[tuple, Found] = {}

    def see(self, key: tuple, templates: Packed, candidates: Packed, truth: np.ndarray) -> None:
        """Score the candidates against the templates of their key where they can still enter."""
        name = (key, tuple(templates.ids.to_pylist()))
        if name not in self.found:
            both = np.concatenate([templates.values, candidates.values])
            coarse = Coarse(both) if np.isfinite(both).all() else None
            self.found[name] = Found(templates, self.k, coarse)
        found, names = self.found[name], _names(candidates.ids)
        counts = np.diff(np.append(templates.starts, len(templates.values)))
        for index in cells(candidates.values[candidates.starts]):
            cell = candidates.take(index)
            near = np.flatnonzero(~(self.bound(templates, cell) + _SLACK < found.scores[:, -1]))
            scored = 0
            if len(near):
                all_near = len(near) == len(templates)
                some = templates if all_near else templates.take(near)
                full = (found.scores[near, -1] >= 0).all()
                if full and found.coarse and np.isfinite(cell.values).all():
                    rows = slice(None) if all_near else np.repeat(np.isin(np.arange(len(counts)), near), counts)
                    t, c, scores = self._close(found, near, some, found.points[:, rows], cell)
                else:
                    scores = best_shape_match(some, cell)
                    t, c = (v.ravel() for v in np.indices(scores.shape))
                    scores = scores.ravel()
                scored = len(scores)
                scores = np.round(scores, self.digits)
                use = scores >= found.scores[near[t], -1]
                of = index[c[use]]
                found.add(near[t[use]], scores[use], names[of], truth[of])
            self.count(len(templates) * len(cell), len(templates) * len(cell) - scored)

    def _close(self, found: Found, near: np.ndarray, some: Packed, points: np.ndarray, cell: Packed):
        """Templates, candidates and scores of the pairs that may reach the templates' kth best."""
        width = cell.values.shape[1]
        floor = found.scores[near, -1] - _SLACK
        with np.errstate(divide="ignore"):
            far = np.where(floor > 0, width * (1.0 / floor - 1.0), np.inf)
        template, candidate = (
            np.repeat(np.arange(len(p)), np.diff(np.append(p.starts, len(p.values)))) for p in (some, cell)
        )
        t, c = within(points, found.coarse.points(cell.values), found.coarse.limits(far)[template])
        # In the order of features, as best_shape_match adds them.
        distance = np.zeros(len(t))
        for i in range(width):
            distance += np.abs(some.values[t, i] - cell.values[c, i])
        pair = template[t] * len(cell) + candidate[c]
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        pair = pair[order][starts]
        nearest = np.minimum.reduceat(distance[order], starts) if len(starts) else distance
        return pair // len(cell), pair % len(cell), 1.0 / (1.0 + nearest / width)

    def bound(self, templates: Packed, cell: Packed) -> np.ndarray:
        """No molecule of the cell is more similar to a template than this."""
        centre = cell.values.mean(0)
        radius = np.abs(cell.values - centre).sum(1).max()
        apart = np.minimum.reduceat(np.abs(templates.values - centre).sum(1), templates.starts)
        return 1.0 / (1.0 + np.maximum(apart - radius, 0.0) / cell.values.shape[1])

    def count(self, pairs: int, skipped: int) -> None:
        if self.pairs is not None:
            self.pairs.add(pairs)
        if self.skipped is not None:
            self.skipped.add(skipped)

    def rows(self, keys: list[str], schema: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        for (key, templates), found in self.found.items():
            step = max(1, _ROWS_OUT // self.k)
            for lo in range(0, len(templates), step):
                t, place = np.nonzero(found.scores[lo : lo + step] >= 0)
                t += lo
                values = {**dict(zip(keys, ([v] * len(t) for v in key)))}
                values |= {"template_id": [templates[i] for i in t.tolist()], "mol_id": found.ids[t, place].tolist()}
                values |= {"score": found.scores[t, place], "truth": found.truth[t, place].tolist()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, schema[c]) for c, v in values.items()})


def _kinds(keys: list[str], fields: pa.Schema, template: pa.DataType, molecule: pa.DataType) -> dict[str, pa.DataType]:
    own = {k: fields.field(k).type for k in keys}
    return own | {"template_id": template, "mol_id": molecule, "score": pa.float64(), "truth": pa.bool_()}


def _against_all(shared, keys: list[str], *options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = Best(*options), None
        for batch in batches:
            filled = batch.filter(pc.greater(batch.column("rows").value_lengths(), 0))
            groups = pack(filled, keys, "mol_id", "rows")
            for key, index in by_key(filled, keys):
                templates = shared.value.get(key)
                if templates is not None and len(templates):
                    kinds = _kinds(keys, batch.schema, templates.ids.type, batch.schema.field("mol_id").type)
                    truth = filled.column("truth").take(pa.array(index)).to_numpy(zero_copy_only=False)
                    best.see(key, templates, groups[key], truth)
        if kinds:
            yield from best.rows(keys, kinds)

    return run


def _chunk_by_chunk(keys: list[str], *options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = Best(*options), None
        for batch in batches:
            for row in range(batch.num_rows):
                templates, _ = unpacked(batch.column("templates"), row, "template_id")
                candidates, table = unpacked(batch.column("candidates"), row, "mol_id")
                key = tuple(batch.column(k)[row].as_py() for k in keys)
                kinds = _kinds(keys, batch.schema, templates.ids.type, candidates.ids.type)
                best.see(key, templates, candidates, table.column("truth").to_numpy(zero_copy_only=False))
        if kinds:
            yield from best.rows(keys, kinds)

    return run
