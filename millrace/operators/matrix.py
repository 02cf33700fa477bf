"""Matrices within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import IndexError_

#: Bytes of a matrix that a task holds at a time; larger ones are sent in slices of it, one after another.
SLICE_BYTES = 64 << 20
#: Numbers of a product that are formed at a time.
PRODUCT = 1 << 22
#: Numbers of a product in single precision that are formed at a time, so that they stay in the processor's cache.
SCREEN = 1 << 19


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; all lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if not len(column) or len(flat) % len(column) or len(np.unique(np.diff(column.offsets.to_numpy()))) > 1:
        if len(column):
            raise IndexError_("vectors differ in length")
        return np.zeros((0, 0))
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Slices:
    """A matrix that is sent to the tasks in slices of rows. A task drops a slice when it goes on to the next."""

    def __init__(self, spark: SparkSession, matrix: np.ndarray, slice_bytes: int | None = None):
        step = max(1, (slice_bytes or SLICE_BYTES) // max(1, matrix[:1].nbytes))
        self.parts = [(i, spark.sparkContext.broadcast(matrix[i : i + step])) for i in range(0, len(matrix), step)]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for start, held in self.parts:
            yield start, held.value
            if len(self.parts) > 1 and hasattr(held, "_value"):
                del held._value


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """What a scalar product of rows of ``a`` and ``b`` in single precision may differ from the exact one by; infinite where single
    precision won't do."""
    if not len(a) or not len(b):
        return 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max())
    return (a.shape[1] + 8) * 2.0**-23 * float(most) + 1e-30 if most < 1e30 else np.inf


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The scalar products of rows ``i`` of ``a`` with rows ``j`` of ``b``, pair by pair."""
    out, step = np.empty(len(i)), max(1, PRODUCT // 4 // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]])
    return out


def nearest(x: np.ndarray, c: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest scalar product of each row of ``x`` with the rows of ``c``, rounded, and the first row that has it.

    Products in single precision tell which rows can have it; only these are multiplied in double precision.
    """
    most, at = np.empty(len(x)), np.empty(len(x), np.int64)
    margin = 2 * slack(x, c) + 2 * 10.0**-places
    single = np.isfinite(margin)
    y, step = (np.ascontiguousarray(c.T, np.float32) if single else c.T), max(1, SCREEN // len(c))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        rows = np.arange(len(part))
        if not single:
            p = np.round(part @ y, places)
            at[s : s + step] = np.argmax(p, axis=1)
            most[s : s + step] = p[rows, at[s : s + step]]
            continue
        p = part.astype(np.float32) @ y
        j = np.argmax(p, axis=1)
        first = p[rows, j]
        value = np.round(products(part, rows, c, j), places)
        p[rows, j] = -np.inf
        close = np.flatnonzero(p.max(axis=1) >= first - margin)
        if len(close):
            p[rows, j] = first
            i, other = np.nonzero(p[close] >= (first[close] - margin)[:, None])
            v = np.round(products(part, close[i], c, other), places)
            order = np.lexsort((other, -v, i))
            best = order[np.concatenate(([0], np.flatnonzero(np.diff(i[order])) + 1))]
            j[close], value[close] = other[best], v[best]
        most[s : s + step], at[s : s + step] = value, j
    return most, at


def top(scores: np.ndarray, names: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` best scores of each row and the names of their columns; equal scores go by the least name.
    ``names`` has one row for all or one for each row. What stands in ``more`` at the same places comes along."""
    names = np.broadcast_to(names, scores.shape)
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(scores, at, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((scores >= last).sum(axis=1) > k)
        for i in tied.tolist():  # only where equal scores cross the cut
            at[i] = np.lexsort((names[i], -scores[i]))[:k]
        scores, names, *more = (np.take_along_axis(x, at, 1) for x in (scores, names, *more))
    order = np.lexsort((names, -scores), axis=1)
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, names, *more))
