"""Spherical k-means with evenly spaced seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written
from ..errors import IndexError_
from ..functions.vector import normalize
from .matrix import Slices, nearest, rows_of

SCHEMA = "doc_id long, vector array<double>, cluster_id int"


def positions(vectors: DataFrame) -> DataFrame:
    """``vectors(doc_id, vector)`` with ``pos``, its place from 0 in the order of doc_id.

    A range partitioning is written once; then only the partitions' counts are summed.
    """
    ordered = vectors.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_part", F.spark_partition_id())
    ordered = written(ordered.withColumn("_row", F.monotonically_increasing_id() % (1 << 33)), "positions")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row a partition
    at, start = {}, 0
    for part, n in sorted(counts):
        at[part], start = start, start + n
    if not at:
        return ordered.select("doc_id", "vector", F.col("_row").alias("pos"))
    base = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    return ordered.select("doc_id", "vector", (F.element_at(base, F.col("_part")) + F.col("_row")).cast("long").alias("pos"))


def seeds(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with their places, and the seeds: rows ``i * (n // k)``."""
    placed = positions(vectors)
    n = placed.count()
    if not n:
        raise IndexError_("no vectors")
    if not 0 < k <= n:
        raise IndexError_(f"k must be between 1 and {n}")
    step = n // k
    rows = placed.where((F.col("pos") % step == 0) & (F.col("pos") < k * step)).select("pos", "vector").toArrow().sort_by("pos")  # k rows
    return placed, rows_of(rows.column("vector"))


def _nearest(x: np.ndarray, held: Slices) -> np.ndarray:
    """The row of the greatest scalar product, the first of equal ones, slice by slice."""
    most, at = np.full(len(x), -np.inf), np.zeros(len(x), np.int32)
    for start, c in held:
        # products are rounded, so that the order of summation can't decide between equal ones
        value, j = nearest(x, c, 12)
        better = value > most
        most[better], at[better] = value[better], (start + j[better]).astype(np.int32)
    return at


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors(doc_id, vector)`` with the cluster of the greatest scalar product, the least id of equal ones.

    The centroids are sent to the tasks in slices, so that any number of them is compared as matrix products, without a join.
    """
    held = Slices(vectors.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_nearest(rows_of(batch.column(1)), held))], names=["doc_id", "vector", "cluster_id"])

    return _vectors(vectors).mapInArrow(run, SCHEMA)


def update(vectors: DataFrame, old: np.ndarray) -> np.ndarray:
    """The means, at unit length, of the vectors that ``assign`` would give each cluster; an empty cluster keeps its centroid.

    One scan: tasks assign their vectors and sum them, so that at most k rows a task are shuffled; these are
    summed by cluster, and k rows come to the driver.
    """
    held = Slices(vectors.sparkSession, old)
    schema = "cluster_id int, total array<double>, n long"

    def packed(used: np.ndarray, total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[used].ravel()))
        return pa.record_batch([pa.array(used.astype(np.int32)), flat, pa.array(count[used])], names=["cluster_id", "total", "n"])

    def summed(batches: Iterator[pa.RecordBatch], own: Callable) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(old), np.zeros(len(old), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, at, n = own(batch)
                order = np.argsort(at, kind="stable")
                first = np.concatenate(([0], np.flatnonzero(np.diff(at[order])) + 1))
                total[at[order][first]] += np.add.reduceat(x[order], first, axis=0)
                count[at[order][first]] += np.add.reduceat(n[order], first)
        yield packed(np.flatnonzero(count), total, count)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(batch):
            x = rows_of(batch.column(1))
            return x, _nearest(x, held), np.ones(len(x), np.int64)

        return summed(batches, own)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(batches, lambda b: (rows_of(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()))

    sums = _vectors(vectors).mapInArrow(partial, schema).repartition("cluster_id").mapInArrow(merge, schema).toArrow()  # k rows
    new = old.copy()
    if sums.num_rows:
        at = sums.column("cluster_id").to_numpy()
        mean = rows_of(sums.column("total")) / sums.column("n").to_numpy()[:, None]
        new[at] = mean / np.maximum(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-12)
    return new


def train(vectors: DataFrame, k: int, iters: int = 8) -> tuple[np.ndarray, DataFrame]:
    """Centroids and assigned vectors after ``iters`` rounds, over ``vectors(doc_id, vector)`` at unit length.

    The assignment returned is the one from before the last update; without rounds all are in cluster 0.
    """
    placed, centroids = seeds(vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector")), k)
    rows = placed.select("doc_id", "vector")
    before = None
    for _ in range(iters):
        before, centroids = centroids, update(rows, centroids)
    return centroids, rows.withColumn("cluster_id", F.lit(0)) if before is None else assign(rows, before)


def sizes(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster_id, n) for all k clusters, empty ones too."""
    held = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(held, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def unit_vectors(df: DataFrame, doc_id: str, vector: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), normalize(F.col(vector)).alias("vector"))
