"""Packed groups of rows: many molecules' vectors as one matrix plus offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Packed:
    """``values`` holds the rows of all molecules; ``starts[i]`` is where molecule i begins."""

    values: np.ndarray
    starts: np.ndarray
    ids: pa.Array

    def __len__(self) -> int:
        return len(self.starts)

    def piece(self, lo: int, hi: int) -> "Packed":
        begin = self.starts[lo]
        end = self.starts[hi] if hi < len(self.starts) else len(self.values)
        return Packed(self.values[begin:end], self.starts[lo:hi] - begin, self.ids.slice(lo, hi - lo))

    def take(self, index: np.ndarray) -> "Packed":
        """The molecules of the given places, in that order."""
        counts = np.diff(np.append(self.starts, len(self.values)))[index]
        starts = np.cumsum(counts) - counts
        rows = np.repeat(self.starts[index] - starts, counts) + np.arange(counts.sum())
        return Packed(self.values[rows], starts.astype(np.int64), self.ids.take(pa.array(index)))

    def pieces(self, max_rows: int):
        """Consecutive pieces of whole molecules with about ``max_rows`` rows each."""
        lo = 0
        while lo < len(self.starts):
            hi = int(np.searchsorted(self.starts, self.starts[lo] + max_rows, side="left"))
            hi = min(max(hi, lo + 1), len(self.starts))
            yield self.piece(lo, hi)
            lo = hi


def over_blocks(templates: Packed, candidates: Packed, rows: tuple[int, int], block) -> np.ndarray:
    """Molecule-by-molecule matrix, computed for pieces of at most about ``rows`` rows a side."""
    columns = [
        np.concatenate([block(t, c) for t in templates.pieces(rows[0])], axis=0)
        for c in candidates.pieces(rows[1])
    ]
    return np.concatenate(columns, axis=1)


def matrix(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and per-molecule row counts of an ``array<array<double>>`` column."""
    counts = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = rows.flatten()
    widths = inner.value_lengths().to_numpy(zero_copy_only=False)
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("feature vectors of different lengths in one table")
    width = int(widths[0]) if len(widths) else 0
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(widths), width), counts


def nested(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The reverse: an ``array<array<double>>`` column of per-molecule rows."""
    inner = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    rows = pa.ListArray.from_arrays(pa.array(inner), pa.array(values.ravel()))
    outer = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), rows)


def by_key(table, keys: list[str]):
    """Split an Arrow batch or table by its key columns: (key tuple, row indices) pairs."""
    frame = table.select(keys).to_pandas()
    for key, index in frame.groupby(keys, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), index


def pack(table, keys: list[str], identifier: str, rows: str) -> dict[tuple, Packed]:
    """One ``Packed`` per key of an Arrow batch or table."""
    out = {}
    for key, index in by_key(table, keys):
        part = table.take(pa.array(index))
        column = part.column(rows)
        ids = part.column(identifier)
        if isinstance(column, pa.ChunkedArray):
            column, ids = column.combine_chunks(), ids.combine_chunks()
        values, counts = matrix(column)
        keep = counts > 0
        ids = ids.filter(pa.array(keep))
        counts = counts[keep]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        out[key] = Packed(values, starts[: len(counts)], ids)
    return out
